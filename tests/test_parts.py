import numpy as np
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.graph import fiedler, modularity, normalised
from textloom.operators.history import _ks, changepoints
from textloom.operators.overlap import similar_pairs
from textloom.plans.components import components
from textloom.sources.tables import changed_only, text_files, unchanged
from textloom.streaming import events


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_shingles(spark):
    words = F.split("t", " ")
    assert one(spark, "a b c d e f", T.shingles(words, 5)) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b", T.shingles(words, 5)) == ["a b"]
    assert one(spark, "x", T.shingles(F.array().cast("array<string>"), 5)) == []


def test_comments_and_complexity(spark):
    assert one(spark, "a // b\nc /* d\n e */ f /* open", T.strip_comments(F.col("t"))) == "a \nc  f "
    assert one(spark, "", T.cyclomatic(F.col("t"))) == 1
    assert one(spark, "if (a && b) {}", T.cyclomatic(F.col("t"))) == 3


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(30):
        base = [f"w{k}" for k in rng.integers(0, 300, 40)]
        for cut in range(4):
            texts.append(" ".join(base[: 40 - cut * 2]))
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert {(r.left_id, r.right_id) for r in similar_pairs(docs, 4, 5).collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(20, 21), (22, 21), (30, 30)], "a long, b long")
    assert {r.node: r.component for r in components(edges, "a", "b").collect()} == {**dict.fromkeys(range(11), 0), 20: 20, 21: 20, 22: 20}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 2)], "a long, b long, w long")
    n = normalised(e)
    assert sorted(map(tuple, n.collect())) == [(1, 2, 2), (3, 4, 2)]
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "node long, g long")
    assert modularity(n, groups).first().modularity == 0.5
    assert fiedler(1, []) == 0.0 and fiedler(2, [(0, 1, 1.0)]) == 2.0


def test_statistics():
    assert _ks(np.array([]), np.array([1.0])) == (1.0, 1.0)
    assert _ks(np.arange(50.0), np.arange(50.0))[0] == 0.0
    assert _ks(np.arange(50.0), np.arange(100.0, 150.0)) == (1.0, 0.0)
    assert changepoints(np.array([])) == [] and changepoints(np.ones(30)) == []
    step = np.concatenate([np.random.default_rng(0).normal(0, 1, 60), np.random.default_rng(1).normal(12, 1, 60)])
    assert any(58 <= k <= 63 for k in changepoints(step))


def test_files(spark, tmp_path):
    for name, text in (("a.ts", "x"), ("a", "same name"), ("b", "bare"), ("node_modules.ts", "skip")):
        (tmp_path / name).write_text(text)
    found = text_files(spark, str(tmp_path), exclude="node_modules")
    assert sorted(r.text for r in found.collect()) == ["bare", "x"]
    changed = found.where("text = 'x'").select("path")
    assert changed_only(found, changed).count() == 1
    cached = found.select("path", F.sha2("text", 256).alias("content_sha256"))
    assert unchanged(found, cached).count() == 2


def test_streams_agree_with_batch(spark, tmp_path):
    from tests.conftest import SF
    from textloom.operators.history import event_tumbling

    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").write_bytes(open(f"{SF}/events.parquet", "rb").read())
    query = events.once(events.tumbling(events.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = event_tumbling(spark, SF)
    joined = got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", F.col("n").alias("m")).join(want, ["start", "event_type"])
    # Windows that the watermark hasn't passed are still open.
    assert got.count() == joined.where("n = m").count() > 0.9 * want.count()
