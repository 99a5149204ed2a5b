"""Each stage of the pipeline against brute force, on the rows that the stage before has kept."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from tests.llm.brute import base_spans, components_of, mixed, sets_of, spark_hash, words
from textloom.llm import language_id, pieces, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, spans string, copies int"
VOICES = {"en": "the and of that with on is are ing ed tion er re", "fr": "le la les des une pour dans que qui est ment eau", "es": "el los de en con para una ción mente ado que y"}


def corpus():
    rng = random.Random(12)
    rows = []
    for k in range(90):
        lang = ("en", "fr", "es")[k % 3]
        text = " ".join(rng.choices(VOICES[lang].split(), k=rng.randint(12, 120)))
        if k % 9 == 0:
            text += f" é user{k}@mail.example.org, 10.0.0.{k} and +1 (017) 555-77{k:02d} or 4111 1111 1111 1111."
        rows.append((k, text, lang if k % 5 else None, None if k % 7 == 0 else f"s{k % 4}"))
        if k % 10 == 0:
            rows.append((200 + k, text + " once", lang, "s1"))
            rows += [(300 + k, text.upper(), lang, "s2")] * 2
    rows += [(None, rows[3][1], "en", "s0"), (None, "the of and is on re", "en", "s0"), (5, rows[9][1], "fr", "s3"), (5, " ".join(VOICES["en"].split()[::-1]), "en", "s3")]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "12 $$", "en", "s0"), (403, " ".join(rng.choices(VOICES["en"].split(), k=60_000)), "en", "s1")]
    return [(i, t, lang, source, len(t or ""), "x", "y", 7) for i, t, lang, source in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage by its name, and the last output."""
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    out = {}
    for name, stage in P.STAGES:
        rows = stage(spark, docs, "")
        kept = spark.createDataFrame(rows.collect(), rows.schema)
        out[name] = ([tuple(r) for r in docs.select(*P.COLUMNS).collect()], [tuple(r) for r in kept.collect()], kept.columns)
        docs = kept
    return out


def test_names():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.queries()}
    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "encoding"]


def test_columns(stages):
    assert all(columns == P.COLUMNS for name, (_, _, columns) in stages.items() if name != "encoding")


def learned(rows):
    """Dictionaries of (text, lang), made anew: the texts least by hash, a stretch of each."""
    texts = {}
    counts = {}
    for text, lang in rows:
        if lang is not None and text is not None and re.search(r"[^\W\d_]", text):
            texts.setdefault(lang, {})[spark_hash(text.encode())] = text
            counts[lang] = counts.get(lang, 0) + 1
    out = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        parts = []
        for o in sorted(texts[lang])[: language_id.SAMPLE_DOCS]:
            text = texts[lang][o]
            at = spark_hash(o) % max(1, len(text) - language_id.STRETCH + 1)
            parts.append(language_id.plain(text[at : at + language_id.STRETCH]))
        if joined := " ".join(p for p in parts if p):
            out[lang] = (" " + joined).encode()
    return out


def told(text, dictionaries):
    """(language, sizes) by compressing the text once for each language."""
    plain = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not plain:
        return "und", []
    sizes = []
    for content in dictionaries.values():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=language_id.LEVEL)
        sizes.append(len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(f" {plain} ".encode())))
    return list(dictionaries)[int(np.argmin(sizes))], sizes


def test_language(stages):
    given, kept, _ = stages["language"]
    dictionaries = learned([(r[1], r[2]) for r in given])
    want = []
    for r in given:
        lang, sizes = told(r[1], dictionaries)
        if sizes and sorted(sizes)[1] / sorted(sizes)[0] - 1 >= language_id.MIN_MARGIN:
            want.append((r[0], r[1], lang, r[3], r[4]))
    assert sorted(map(repr, kept)) == sorted(map(repr, want)) and len(want) > 80


def test_near_duplicates(stages):
    given, kept, _ = stages["near_duplicates"]
    order = sorted(range(len(given)), key=lambda k: (given[k][0] is None, given[k][0] or 0))
    sets = {n: sets_of(given[k][1]) for n, k in enumerate(order)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = components_of(sets, links)
    sizes = {}
    for n, c in least.items():
        sizes.setdefault(c, []).append(given[order[n]])
    assert len(kept) == len(sizes) < len(given)
    for rows in sizes.values():
        best = min((r[0] is None, r[0] or 0) for r in rows)
        assert sum(rows.count(r) > 0 and (r[0] is None, r[0] or 0) == best for r in kept) >= 1
    assert len({repr(r) for r in kept}) == len(kept)


def test_personal_data(stages):
    given, kept, _ = stages["personal_data"]
    want = []
    for i, text, lang, source, _ in given:
        out, at = "", 0
        for start, _, kind, end in base_spans(text):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        out += text[at:]
        want.append((i, out, lang, source, len(out)))
    assert sorted(map(repr, kept)) == sorted(map(repr, want)) and any("[PHONE]" in r[1] for r in kept)


def test_mixing(stages):
    given, kept, _ = stages["mixing"]
    copies = mixed([(r[0], len(words(r[1])), r[3]) for r in given])
    taken, due = {}, {}
    for r in kept:
        taken[r[3]] = taken.get(r[3], 0) + len(words(r[1]))
    for (_, size, source), (target, rate) in copies:
        due[source] = target
        assert 0 <= rate <= 2
    for source, target in due.items():
        sizes = [len(words(r[1])) for r in given if r[3] == source]
        # A document is taken whole or not at all, so one that is most of its source leaves half its words open.
        assert abs(taken.get(source, 0) - target) <= max(min(sizes), 0.02 * target, max(sizes) / 2 if max(sizes) > target / 2 else 0)
    assert all(kept.count(r) <= 2 * given.count(r) for r in kept) and {r[1] for r in kept} <= {r[1] for r in given}


def test_encoding(stages):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    given, kept, columns = stages["encoding"]
    want = []
    for i, text, lang, source, _ in given:
        ids = own.encode(text, add_eos=True)
        want.append((i, lang, source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    assert columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def test_run(spark, tmp_path):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    frame.write.parquet(f"{tmp_path}/a/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    rows = P.run(spark, f"{tmp_path}/a")
    assert rows.where("n_tokens > 0").count() == rows.count() > 60 and rows.where(F.col("lang").isNull()).count() == 0
    assert P.run(spark, f"{tmp_path}/b").count() == 0
