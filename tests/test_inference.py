from math import comb

from pyspark.sql import functions as F

from textloom.operators.inference import bootstrap, check_constitution, clopper_pearson, find_similar, fisher, louvain, posterior, wilcoxon
from textloom.sources import sinks


def test_fisher_against_definition():
    for a, b, c, d in ((3, 1, 1, 3), (10, 0, 2, 8), (0, 0, 0, 0), (5, 5, 5, 5)):
        n, r, k = a + b + c + d, a + b, a + c
        p = {x: comb(r, x) * comb(n - r, k - x) / comb(n, k) for x in range(max(0, k - n + r), min(r, k) + 1)}
        assert abs(fisher(a, b, c, d) - min(1, sum(v for v in p.values() if v <= p[a] + 1e-12))) < 1e-9


def test_clopper_pearson():
    low, high = clopper_pearson(5, 10)
    assert abs(low - 0.18709) < 1e-4 and abs(high - 0.81291) < 1e-4
    assert clopper_pearson(0, 10)[0] == 0.0 and clopper_pearson(10, 10)[1] == 1.0 and clopper_pearson(0, 0) == (0.0, 1.0)


def test_louvain_finds_cliques():
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 1.0)]
    found = louvain(edges)
    assert len(set(found.values())) == 2 and len({found[k] for k in range(5)}) == 1
    assert louvain([]) == {}


def test_lookups(spark):
    docs = spark.createDataFrame([(1, "en", "a b c d e f g"), (2, "en", "a b c d e x y"), (3, "en", "nothing alike here at all")], "doc_id long, lang string, text string")
    assert [r.doc_id for r in find_similar(docs, "a b c d e f g", 2).collect()] == [1, 2]
    assert find_similar(docs, "", 5).count() == 0
    imports = spark.createDataFrame([("p", "react"), ("p", "moment"), ("q", "moment/locale")], "path string, package string")
    declared = spark.createDataFrame([("react",), ("moment",), ("moment/locale",)], "package string")
    assert sorted((r.path, r.package, r.reason) for r in check_constitution(imports, declared, ["moment"]).collect()) == [("p", "moment", "forbidden"), ("q", "moment/locale", "forbidden")]


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([(1, "a/b", "ai", "high", True, 2, 3)], "doc_id long, rule_id string, category string, severity string, ai_specific boolean, n long, line int")
    assert '"level":"error"' in sinks.sarif_results(f).first().value and sinks.markdown_lines(f).first().value == " | a/b | high | 1 | 3 | "
    sinks.save(sinks.json_lines(f), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().rule_id == "a/b"
    sinks.append_history(f.select(F.lit(1).alias("x")), str(tmp_path / "history"))
    sinks.append_history(f.select(F.lit(2).alias("x")), str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2


def test_wilcoxon_and_posterior():
    assert wilcoxon([]) == (0.0, 1.0) and wilcoxon([0, 0]) == (0.0, 1.0)
    assert wilcoxon([1, -1])[0] == 1.5 and wilcoxon([1, -1])[1] == 1.0
    assert wilcoxon(list(range(1, 21)))[1] < 0.001
    assert posterior(0.5, []) == 0.5 and abs(posterior(0.3, [2.0, 3.5]) - 0.75) < 1e-9


def test_bootstrap(spark):
    rows = spark.createDataFrame([(g, float((g * 7 + k) % 5)) for g in range(60) for k in range(10)] + [(1, None)], "g long, v double")
    r = bootstrap(rows, "g", "v", 200).first()
    assert r["mean"] == 2.0 and r.low <= 2.0 <= r.high and r.high - r.low < 1
    spread = bootstrap(spark.createDataFrame([(g, float(g)) for g in range(60)], "g long, v double"), "g", "v", 300).first()
    assert 20 < spread.low < 29.5 < spread.high < 39
