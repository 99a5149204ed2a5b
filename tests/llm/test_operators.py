"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, rows
from tests.llm.brute import base_spans, components_of, mixed, sets_of, shingles, spark_hash, words
from textloom.llm import embedding_dedup, fingerprints, jaccard_join, language_id, mixing, personal_data, pieces, quality, queries, substring_dedup, url_filter
from textloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, n string, u string"


def corpus():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("ee", "o", "ér", "Ing", "st")]
    texts = [None, "", " \n\t ", "word", "a b c d", "Über 🙂  zwei\tdrei\x1ffour\u00a0five\x85six"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    for k in range(60):
        t = rng.choices(vocabulary, k=rng.randint(5, 120))
        if k % 3 == 0:
            t[2:2] = passage.split()
        texts.append(" ".join(t))
        if k % 4 == 0:
            near = list(t)
            near[rng.randrange(len(near))] = "edited"
            texts += [" ".join(near), " ".join(t).upper() if k % 8 == 0 else " ".join(t)]
    texts.append(" ".join(rng.choices(vocabulary, k=60_000)))
    texts.append("same " * 3000)
    texts += [texts[20]] * 5
    return [(i * 3 + 1, t, None if i % 11 == 0 else ("en", "fr")[i % 2], None if i % 7 == 0 else f"s{i % 5}", i, "x", 0.5, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_substring_dedup(spark, docs, none):
    texts = {d[0]: words(d[1]) for d in corpus()}
    least = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 12):
            least.setdefault(tuple(texts[i][k : k + 13]), i)
    want = {}
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect()} == want
    assert any(n for _, n, _ in want.values())
    assert substring_dedup.dedup(none).count() == 0
    lost = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in substring_dedup.dedup(lost).collect()) == [("1", 0, ""), ("None", 2, "a b")]


def test_reference_spans(spark):
    run = [f"w{k}" for k in range(20)]
    docs = spark.createDataFrame([(1, "x " + " ".join(run[3:17]) + " y"), (2, " ".join(run[:12])), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_reference(docs, [" ".join(run)]).collect()}
    assert got == {1: "x y", 2: " ".join(run[:12]), 3: None}


def test_suffix_automaton_against_search():
    rng = random.Random(2)
    for _ in range(60):
        lists = [[rng.choice("ab") for _ in range(rng.randint(0, 25))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for k, w in enumerate(lists):
            automaton.add(w, k)
        automaton.finish()
        query = [rng.choice("abc") for _ in range(30)]
        for end, owner in enumerate(automaton.matches(query, 4)):
            run = query[max(0, end - 3) : end + 1]
            holds = [k for k, w in enumerate(lists) if len(run) == 4 and any(w[i : i + 4] == run for i in range(len(w)))]
            assert owner == (min(holds) if holds else None)


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs).toPandas()
    given = [(d[0], len(words(d[1])), d[3]) for d in corpus()]
    got["source"] = got.source.astype(object).where(got.source.notna(), None)
    found = {r.doc_id: r for r in got.itertuples()}
    assert len(found) == len(given)
    for (i, size, source), (target, rate) in mixed(given):
        r = found[i]
        assert (r.size, r.source, r.source_size) == (size, source, sum(n for _, n, s in given if s == source)) and 0 <= r.copies <= 2
        assert math.isclose(r.target, target, rel_tol=1e-9) and abs(r.rate - rate) < 1e-6 and abs(r.copies - rate) < 1 + 1e-6
    assert got.groupby(got.source.fillna("")).rate.nunique().max() > 5
    again = mixing.mix_sources(docs.repartition(2)).toPandas()
    assert dict(zip(again.doc_id, again.copies, strict=True)) == dict(zip(got.doc_id, got.copies, strict=True))
    assert mixing.mix_sources(none).count() == 0


def test_mixing_of_odd_tables(spark):
    twice = spark.createDataFrame([(1, "a b c", "x")] * 4 + [(None, "d", None), (2, None, "y"), (2, "", "y")], "doc_id long, text string, source string")
    got = mixing.mix_sources(twice).collect()
    assert len(got) == 7 and {(r.size, r.source_size) for r in got} == {(3, 12), (1, 1), (0, 0)} and all(r.copies * r.size <= 2 * r.size for r in got)
    assert mixing.mix_sources(twice.where("size(split(coalesce(text, ''), ' ')) = 0 OR text IS NULL")).first().copies == 0


@pytest.mark.parametrize("share,weights", [(0.02, (1,)), (0.4, (9, 1)), (1.0, (1, 1, 1)), (1.9, (1, 7)), (2.5, (3, 1))])
def test_mixing_against_bisection(spark, share, weights):
    rng = random.Random(3)
    given = [(i, rng.choice((1, 2, 5, 40, 300, 4000)), "abcde"[i % 5]) for i in range(400)]
    frame = spark.createDataFrame([(i, "w " * n, s) for i, n, s in given], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(frame, weights, share).collect()}
    for (i, _, _), (target, rate) in mixed(given, weights, share):
        assert math.isclose(got[i].target, target, rel_tol=1e-9) and abs(got[i].rate - rate) < 1e-6


def test_mixing_comes_near_targets(spark):
    rng = random.Random(9)
    rows_ = [(i, "w " * rng.randint(1, 300), "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows_, "doc_id long, text string, source string")).toPandas()
    taken = (got.copies * got["size"]).groupby(got.source).sum()
    assert ((taken - got.groupby("source").target.first()).abs() / taken).max() < 0.005


def test_pieces(spark, docs, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    coder = pieces.coder(pieces.default_model())
    rng = random.Random(6)
    texts = ["", " ", "\n\n", "a  b", " " * 40 + "x", "▁a▁▁", "<0x41> </s>", "\0", "日本語🙂"] + ["".join(rng.choices("abcdeinort  \n▁.,é🙂-=_", k=rng.randint(1, 50))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t, add_eos=True)
        assert coder.encode(t) == ids and coder.decode(ids) == own.decode(ids)
    got = {r.doc_id: r for r in pieces.digests(docs, pieces.default_model()).collect()}
    for d in corpus():
        ids = own.encode(d[1] or "", add_eos=True)
        r = got[d[0]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())
    back = pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model())
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert pieces.digests(none, pieces.default_model()).count() == 0


def test_language(spark, docs, none):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language_id.learn(held.where(language_id.fold("doc_id", 5) != 0))
    assert set(dictionaries) == {"en", "fr", "de", "es"}
    got = language_id.identify(held.where(language_id.fold("doc_id", 5) == 0), dictionaries)
    assert got.where("lang = lang_pred").count() > 0.95 * got.count()
    edges = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "12 $%", 0.1), (4, "the " * 50_000, 0.1)], "doc_id long, text string, score double")
    found = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.identify(edges, dictionaries).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0, True) and found[4][0] in dictionaries
    assert language_id.identify(none, dictionaries).count() == 0
    assert language_id.learn(none) == {} and {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in fingerprints.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    ids = sorted(got)
    texts = {d[0]: d[1] or "" for d in corpus()}
    assert all(got[a].next_text == texts[b] and got[a].next_sketch == got[b].sketch for a, b in zip(ids, ids[1:] + ids[:1], strict=True))

    measured = spark.createDataFrame([(a, texts[a], texts[b]) for a, b in zip(ids, ids[2:], strict=False)], "k long, a string, b string")
    s = measured.select("k", fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    s = s.select("k", fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("d"))
    for r in s.collect():
        a, b = shingles(texts[r.k]), shingles(texts[ids[ids.index(r.k) + 2]])
        exact = len(a | b) < fingerprints.K
        assert abs(r.j - (len(a & b) / len(a | b) if a | b else 1)) < (1e-9 if exact else 0.15)
        assert abs(r.c - (len(a & b) / len(a) if a else 1)) < (1e-9 if exact else 0.25)
        assert abs(r.d - len(a)) <= (0 if len(a) < fingerprints.K else 0.3 * len(a))
    whole = docs.select(F.lit(1).alias("g"), fingerprints.sketch(F.col("text")).alias("s"))
    merged = fingerprints.merge_groups(whole, ["g"], "s").first().s
    every = sorted({h for r in whole.collect() for h in r.s})[: fingerprints.K]
    assert merged == every
    alone = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert fingerprints.with_next(alone).first().next_text == "a b"
    assert fingerprints.with_next(none.select("doc_id", "text")).count() == 0


def test_fingerprints_of_query(spark, tmp_path):
    rng = random.Random(10)
    texts = ["", "a b", "é🙂 x", None] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 400))) for _ in range(60)]
    texts += [texts[9]] * 9 + [texts[9] + " more"]
    ids = [None if k == 3 else 7 if 20 <= k < 40 else k * 5 for k in range(len(texts))]
    spark.createDataFrame([(i, t, 1.0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, sketch double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op5_fingerprints"](spark, str(tmp_path)).collect()
    order = sorted(((i is None, i or 0, spark_hash((t or "").encode())), t or "") for i, t in zip(ids, texts, strict=True))
    want = []

    def like(a, b):
        a, b = shingles(a), shingles(b)
        return round(len(a & b) / len(a | b), 9) if a | b else 1.0, len(a | b) <= fingerprints.K

    for k, ((none, i, _), t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append(((None if none else i, len(t), hashlib.sha256(edited.encode()).hexdigest()), like(t, edited), like(t, after)))
    found = [((r.doc_id, r.n_chars, r.edited_sha256), r.near_edited, r.near_next) for r in got]
    exact = 0
    for f, w in zip(sorted(found, key=lambda x: repr(x[0])), sorted(want, key=lambda x: repr(x[0])), strict=True):
        assert f[0] == w[0]
        for value, (true, small) in zip(f[1:], w[1:], strict=True):
            assert abs(value - true) < (1e-8 if small else 0.15)
            exact += small
    assert exact > 40
    pairs = spark.createDataFrame([(r.fingerprint,) for r in got], "f string").select(fingerprints.packed(fingerprints.unpacked(F.col("f"))).alias("g"), "f")
    assert pairs.where("f <> g").count() == 0 and len({r.fingerprint for r in got if r.n_chars == len(texts[9]) }) >= 1
    a, b = fingerprints.sketch(F.lit(texts[9])), fingerprints.sketch(F.lit(texts[9] + " more"))
    one = spark.range(1).select(fingerprints.merge(fingerprints.unpacked(fingerprints.packed(a)), fingerprints.unpacked(fingerprints.packed(b))).alias("m"), fingerprints.merge(a, b).alias("n")).first()
    assert one.m == one.n


def test_ranges_of_a_hot_id(spark):
    """Rows of one id, or of none, are dealt to several ranges, and order holds across them."""
    rows_ = [(5, f"text {k}") for k in range(400)] + [(None, f"none {k}") for k in range(300)] + [(k, f"other {k}") for k in range(10, 60)]
    got = fingerprints.with_next(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert got.select(F.spark_partition_id()).distinct().count() >= 3
    order = [t for _, t in sorted(((i is None, i or 0, spark_hash(t.encode())), t) for i, t in rows_)]
    assert {r.text: r.next_text for r in got.collect()} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 16))
    vectors = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(120):
        v = base[k % 40] + rng.normal(scale=0.04, size=16)
        vectors.append((100 + k, v.tolist(), (k % 40) % 3))
    vectors += [(300 + k, base[0].tolist(), 0) for k in range(300)]
    vectors += [(700, None, 1), (701, [0.0] * 16, 1), (702, [math.nan] + [1.0] * 15, 1), (703, [None] + [1.0] * 15, 1), (704, [math.inf] + [1.0] * 15, 1), (705, base[1].tolist(), None), (706, [], 1), (707, [1.0, 2.0], 1), (708, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    good = [(i, np.array(v), label) for i, v, label in vectors if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[k + 1 :] if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = components_of([v[0] for v in vectors], links)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.98 * 2 * len(links) and all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.component_id == least[i] for i, r in got.items()) >= 0.98 * len(vectors)
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and all(got[i].n_links == 0 for i in range(700, 707)) and got[707].n_links == 1
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_with_a_common_component(spark):
    rng = np.random.default_rng(4)
    a = embedding_dedup.unit(rng.normal(size=(1500, 64)) / 8 * 0.31 + 0.95 * np.eye(64)[0])
    z = rng.normal(size=a.shape)
    z = embedding_dedup.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    x = np.vstack([a, 0.982 * a + math.sqrt(1 - 0.982**2) * z])
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    hit = embedding_dedup.unit(x) @ embedding_dedup.unit(x).T >= 0.98
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(frame).collect())
    assert hit.sum() - len(x) >= 3000 and 0.99 * (hit.sum() - len(x)) <= found <= hit.sum() - len(x)


def test_jaccard_join(spark, docs, none):
    sets = {d[0]: sets_of(d[1]) for d in corpus()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = components_of(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in ids} and len(links) > 20
    assert jaccard_join.components(none).count() == 0


def test_jaccard_join_of_large_groups(spark):
    rng = random.Random(8)
    first = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(300):
        w = list(first)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [sets_of(t) for t in texts]
    links = [(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = components_of(range(300), links)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(frame).collect()} == least


def test_parities_bound_intersections():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        a = np.unique(a)
        bits = [np.frombuffer(jaccard_join._parities(x, np.array([len(x)]))[0].as_py(), dtype=np.uint8) for x in (a, b)]
        assert jaccard_join.most_shared(len(a), len(b), *bits) >= len(np.intersect1d(a, b))


def test_language_of_query(spark):
    """The registered query against dictionaries made anew and the library's sizes."""
    from tests.llm.test_pipeline import learned, told

    rows_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows_}
    dictionaries = learned([(r.text, r.lang) for r in rows_ if fold[r.doc_id]])
    got = {r.doc_id: r for r in queries.queries()["op4_language_id"](spark, SF).collect()}
    assert len(got) == len(rows_)
    for r in rows_:
        lang, sizes = told(r.text, dictionaries)
        score = 1 - 0.5 * math.exp(-(sorted(sizes)[1] / sorted(sizes)[0] - 1) / language_id.SCALE) if sizes else 0.0
        assert got[r.doc_id].held_out == (fold[r.doc_id] == 0) and got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-12


def test_language_of_copies(spark):
    rows_ = [(1, "the and of that with", "en")] * 4000 + [(2, "le la les des une", "fr")] * 10 + [(3, "12 34", "xx"), (4, None, "yy")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    assert set(language_id.learn(frame)) == {"en", "fr"}


def plain_statistics(text):
    text = text or ""
    raw, w = text.encode(), words(text)
    size = len(raw)

    def share(n, of):
        return math.log((n + 0.125) / (max(of - n, 0) + 0.125))

    def of(chars):
        return share(sum(b in chars for b in raw), size)

    lines = [words(x) for x in text.split("\n")]
    lines = [tuple(x) for x in lines if x]
    pairs = list(zip(w, w[1:], strict=False))
    most = max((w.count(x) for x in set(w)), default=0)
    return [
        math.log1p(len(w)), math.log1p(sum(len(x.encode()) for x in w) / max(len(w), 1)), of(range(65, 91)), of(range(48, 58)), of(b".?"), of(b",;:"), of(b"*#$%&@^~=+<>{}[]\\/"), of(b"|"), of(b"!"), of(range(128, 256)),
        math.log1p(len(w) / max(raw.count(b"\n") + 1, 1)), math.log((len(set(w)) + 1) / (len(w) + 1)), math.log((len(set(lines)) + 1) / (len(lines) + 1)), math.log((len(set(pairs)) + 1) / max(len(w), 1)), share(most, len(w)),
    ]


def test_quality_of_query(spark):
    """The registered query against statistics by loops, explicit inverses and determinants, and a line by gradient steps on the same loss."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in texts}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None and fold[r.doc_id] != 2 and r.doc_id in texts]
    stats = {i: plain_statistics(t) for i, t in texts.items()}
    x, y = np.array([stats[i] for i, _ in labels]), np.array([q for _, q in labels])
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / spread
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
    model = []
    for k in (0, 1):
        cov = (1 - quality.TO_POOLED) * own[k] + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_SPHERE) * cov + quality.TO_SPHERE * np.trace(cov) / len(cov) * np.eye(len(cov))
        model.append((z[y == k].mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log((y == k).mean())))

    def difference(v):
        v = (np.array(v) - centre) / spread
        dens = [p - 0.5 * log - 0.5 * (v - m) @ inverse @ (v - m) for m, inverse, log, p in model]
        return math.copysign(math.log1p(abs(dens[1] - dens[0])), dens[1] - dens[0])

    t = np.array([difference(v) for v in x])
    a, b = 1.0, 0.0
    for _ in range(100_000):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -30, 30)))
        da, db = ((p - y) * t).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b
        a, b = a - 0.002 * da, b - 0.002 * db
    got = {r.doc_id: r for r in queries.queries()["op8_quality"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i in texts:
        want = 1 / (1 + math.exp(-min(30, max(-30, a * difference(stats[i]) + b))))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == (fold[i] == 2)


def test_quality(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learn(d, labels.where(language_id.fold("doc_id", 4) != 2))
    got = quality.score(d, model).join(labels.where(language_id.fold("doc_id", 4) == 2), "doc_id")
    assert got.where("cast(score >= 0.7 as int) = quality").count() > 0.9 * got.count()
    own = quality.score(docs, model)
    assert own.where("score between 0 and 1").count() == docs.count()
    assert len({r.score for r in own.where("text is null or text = ''").collect()}) == 1
    assert quality.score(none, model).count() == 0 and quality.learn(none, labels) is None and quality.score(docs, None).where("score = 0.5").count() == docs.count()


def test_personal_data(spark, none):
    rng = random.Random(5)
    parts = [*"aZ09..@@+-- ()%_", "1", "2", "5", ".c", "+1 ", "4111 1111 1111 1111", "10.0.0.", "é🙂"]
    texts = {k: "".join(rng.choices(parts, k=rng.randint(0, 60))) for k in range(1500)}
    texts |= {5000: "a" * 50_000 + "@b.c", 5001: "1 " * 30_000, 5002: "+1" * 10_000, 5003: "a@b.c%x@d.e a@b.c.", 5004: "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255", 5005: None, 5006: ""}
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, email string, kind int")
    got = {r.doc_id: r for r in personal_data.personal_spans(frame).collect()}
    for k, t in texts.items():
        assert [(s.start, s.rank, s.kind, s.end) for s in got[k].base] == base_spans(t or "")
        assert {tuple(s) for s in got[k].base} <= {tuple(s) for s in got[k].spans}
    assert personal_data.personal_spans(none).count() == 0


def test_cards_with_separated_digits(spark):
    digits = ["4111111111111111", "0" * 14, "0" * 19, "4111111111111112", "0" * 13, "0" * 20]
    texts = [f"x {sep.join(d)} y" for d in digits for sep in (" ", "-", "")] + ["4-1 1-1 1-1 1-1 1-1 1-1 1-1 1-1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_spans(frame).collect()}
    assert [len(got[k].card) for k in range(len(texts))] == [1] * 9 + [0] * 9 + [1]
    assert [[(s.start, s.rank, s.kind, s.end) for s in got[k].base] for k in range(len(texts))] == [base_spans(t) for t in texts]
    j = frame.where("doc_id = 0").join(personal_data.personal_spans(frame).select("doc_id", "spans"), "doc_id")
    assert j.select(personal_data.masked(F.col("text"), F.col("spans"))).first()[0] == "x [CARD] y"


def test_patterns_find_more(spark):
    rows_ = [(k, f"w{k} please call +1 415 555 {1000 + k} now") for k in range(12)] + [(20, "x please call 4155551234 here"), (21, "x never say 4155551234 here"), (None, "ref 99887766 please call 4155551234 there")]
    rows_ += [(30 + k, f"id:user{k}@mail.org is seen") for k in range(4)] + [(40, "id:someone77 is not seen"), (41, "call a call b call c call d call e call f call g call h call 77665544 then")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal_data.personal_spans(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got[20] == [("phone", 14, 24)] and got[21] == [] and len(got[3]) == 1
    assert got[None] == [("phone", 25, 35)]  # the words before it reach over another token
    assert got[40] == [("email", 3, 12)] and got[41] == []  # "call" goes with plain words too
    plain = [(k, f"w{k} the +1 415 555 {1000 + k} word") for k in range(12)] + [(50, "the one the other the 88776655 the end " * 3)]
    assert {r.doc_id: len(r.spans) for r in personal_data.personal_spans(spark.createDataFrame(plain, "doc_id long, text string")).collect()}[50] == 0


def test_patterns_against_counting(spark):
    """All of the method on a small corpus, by loops."""
    rng = random.Random(7)
    texts = []
    for k in range(60):
        w = []
        for _ in range(rng.randint(3, 12)):
            w += [rng.choice(["call", "mail", "see", "to", "and"]), rng.choice(["at", "me", "now"])] if rng.random() < 0.7 else []
            w.append(rng.choice([f"u{rng.randrange(40)}@x.org", f"10.0.0.{rng.randrange(40)}", f"{rng.randrange(1000, 1040)}", "plain", "word"]))
        texts.append(" ".join(w))
    seeds = re.compile(r"u\d+@x\.org|10\.0\.0\.\d+")
    edges, seen, place = {}, defaultdict(int), []
    for d, text in enumerate(texts):
        w = text.split()
        kind = [0 if "@" in x else 1 if seeds.fullmatch(x) else -1 if x[0].isdigit() else None for x in w]
        shown = [x if k in (None, -1) else personal_data.MARKS[k] for x, k in zip(w, kind, strict=True)]
        for i, x in enumerate(w):
            if i:
                seen["1 " + w[i - 1]] += 1
                seen["3 " + x] += 1
                seen[f"2 {w[i - 1]} {x}"] += i + 1 < len(w)
            if kind[i] is not None:
                mine = (["1 " + shown[i - 1]] if i else []) + ([f"2 {shown[i - 2]} {shown[i - 1]}"] if i > 1 else []) + (["3 " + shown[i + 1]] if i + 1 < len(w) else [])
                for p in mine:
                    edges.setdefault(p, {}).setdefault(x, [kind[i], 0])[1] += 1
                if kind[i] < 0:
                    place.append((d, sum(map(len, w[:i])) + i, len(x), mine, x))
    edges = {p: e for p, e in edges.items() if sum(k >= 0 for k, _ in e.values()) >= personal_data.MIN_SEEDS}
    every = {p: len(e) + max(0, seen[p] - sum(n for _, n in e.values())) + 1 for p, e in edges.items()}
    score = {x: 0.0 for e in edges.values() for x, (k, _) in e.items() if k < 0}
    for k in range(personal_data.ROUNDS + 1):
        conf = {p: sum(1.0 if kind >= 0 else score[x] for x, (kind, _) in e.items()) / every[p] for p, e in edges.items()}
        if k < personal_data.ROUNDS:
            for x in score:
                score[x] = 1 - math.prod(1 - conf[p] for p, e in edges.items() if x in e)
    want = {(d, at, at + n) for d, at, n, mine, _ in place if any(conf.get(p, 0) >= personal_data.MIN_SCORE for p in mine)}
    rows_ = personal_data.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc_id, s.start, s.end) for r in rows_ for s in set(map(tuple, r.spans)) - set(map(tuple, r.base)) for s in [personal_data_span(s)]}
    assert got == want and want


def personal_data_span(s):
    import collections

    return collections.namedtuple("Span", "start rank kind end")(*s)


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"u{k}@x{k}.org call 55{k}" for k in range(20_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    r = frame.join(personal_data.personal_spans(frame), "doc_id").select(F.size("spans").alias("n"), personal_data.masked(F.col("text"), F.col("spans")).alias("m")).first()
    assert r.n == 20_000 and r.m == " ".join(f"[EMAIL] call 55{k}" for k in range(20_000)) and time.time() - start < 60


def test_masks(spark):
    frame = spark.createDataFrame([(1, "é a@b.co or 10.0.0.1!"), (2, "none"), (3, None)], "doc_id long, text string")
    j = frame.join(personal_data.personal_spans(frame).select("doc_id", "spans"), "doc_id")
    assert {r.doc_id: r.m for r in j.select("doc_id", personal_data.masked(F.col("text"), F.col("spans")).alias("m")).collect()} == {1: "é [EMAIL] or [IP]!", 2: "none", 3: None}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM", "http://example.com/en/x", "http://www.example.com/en/", "https://sub.www.example.com/en/a?b#c", "ftp://x.net/es/", "http://x.net/es", "http://net/fr/q", "http://xnet/fr/", "http://a.com?x", "http://a.com/#y", "a://b://c.com/", "http://..com/en/"] * 3
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = re.match(r"[^/?#]*", rest)[0]
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in cut), re.match(r"[^?#]*", rest[len(cut) :])[0]
        fits = [(len(h + p), h + p, k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, url_filter.RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(frame.limit(0), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(frame, []).collect()} == {"allow"}


def test_url_filter_of_many_rules(spark):
    rng = random.Random(6)
    rules = [(rng.choice(("allow", "block")), f"h{rng.randrange(40)}.org", "/" + "x" * rng.randrange(60)) for _ in range(150)]
    rules = list({r[1:]: r for r in rules}.values())
    urls = [f"http://{rng.choice(('', 'a.', 'b.c.'))}h{rng.randrange(80)}.org/{'x' * rng.randrange(70)}y" for _ in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, otherwise="block").collect()}
    for i, url in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [(len(h + p), h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[1], max(fits)[2]) if fits else (None, "block"))


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    listed = np.array([r.key % 2**64 for r in spark.range(0, 20_000, 40).select(F.xxhash64("id").alias("key")).collect()], dtype=np.uint64)
    levels = url_filter.build([listed], universe)[0]
    keys = np.array([r.key % 2**64 for r in universe.collect()], dtype=np.uint64)
    assert (url_filter.contains(levels, keys) == np.isin(keys, listed)).all() and len(levels) > 1
    assert sum(x.n_bits for x in levels) < 16 * len(listed)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    least = components_of({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == c for n, c in least.items())


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()) == [("1", 2, 1), ("None", 0, None), ("None", 2, None)]
    vectors = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((str(r.vec_id), r.n_links) for r in embedding_dedup.near_duplicates(vectors).collect()) == [("1", 1), ("2", 1), ("None", 0)]
    assert fingerprints.with_next(docs.withColumn('text', F.coalesce('text', F.lit('')))).count() == 3 and mixing.mix_sources(docs.withColumn("source", F.lit("s"))).count() == 3
    assert pieces.digests(docs, pieces.default_model()).count() == 3 and personal_data.personal_spans(docs).count() == 3
