import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import rule_cases
from textloom.plans import commands
from textloom.sources import sinks, tables
from textloom.streaming import events


@pytest.fixture(scope="module")
def result(spark):
    return commands.scan(rule_cases.units(spark), rule_cases.facts(spark), commands.Config(severities={"security/eval": "low", "cpp/magic-numbers": "off"}, max_slop=1.0, min_health=10.0, max_new=0))


def test_scan_and_gates(spark, result):
    found = result["findings"]
    assert {r.severity for r in found.where("rule_id = 'security/eval'").collect()} == {"low"} and found.where("rule_id = 'cpp/magic-numbers'").count() == 0
    on = {r[0] for r in rule_cases.catalog(spark).where("policy = 'on'").select("rule_id").collect()}
    assert {r.rule_id for r in result["scoring"].select("rule_id").distinct().collect()} <= on and result["files"].agg(F.max("score")).first()[0] <= 100
    config = commands.Config(max_slop=-1.0, min_health=101.0, max_new=3)
    assert commands.gate(result, config, new=4).first().failed == ["max-slop", "min-health", "max-new"] and commands.gate(result, commands.Config(max_slop=100.0, max_new=4), new=4).first().failed == []
    changed = tables.changed_paths(spark.createDataFrame([("M\tm/eval.js",), ("D\ta/any.py",), ("R100\tx\tn/img.html",)], "value string"))
    assert {r.path for r in changed.collect()} == {"m/eval.js", "n/img.html"}
    assert {r.path: r.points for r in commands.changed_points(found, changed).collect()} == {"m/eval.js": 4, "n/img.html": 3}


def test_lookups(spark):
    assert commands.explain_rule(spark, "security/eval").first().runs and commands.explain_rule(spark, "none").count() == 0
    assert commands.list_rules(spark, "ai", "security").count() > 3
    assert commands.problems(commands.Config(severities={"x/y": "loud"})) == ["unknown rule x/y", "unknown severity loud"] and commands.badge(81) == "health 81 good"
    classes = spark.createDataFrame([("p-[17px]",), ("p-[16px]",), ("p-4",)], "class string")
    assert [(r["class"], r.step) for r in commands.suggest_steps(classes, [0.5, 1.0]).collect()] == [("p-[17px]", 1.0)]
    code = spark.createDataFrame([("a", "import x from 'old/a'\nimport y from 'old/ab'\nz = 'old/a'")], "path string, text string")
    assert commands.rewrite_imports(code, {"old/a": "new"}).first().text == "import x from 'new'\nimport y from 'old/ab'\nz = 'old/a'"


def test_text_functions(spark):
    def one(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x

    t = F.col("t")
    assert one("import a from 'x/y'\nconst b = require('@s/p/q')\nimport('./z')\nimport '@/w'", T.imported_packages(t)) == ["x", "@s/p"]
    assert [(r.line, r.name, r.params) for r in one("\nfunction f(a, b = 1) {}\nconst g = async (c) => 1", T.signatures(t))] == [(2, "f", ["a", "b"]), (3, "g", ["c"])]
    assert [one(v, T.in_rem(t)) for v in ("8px", "1.5rem", "3%")] == [0.5, 1.5, None]
    assert one("b /* x */  a", T.canonical_style(t)) == "a b"
    assert [(r.line, r.text) for r in one("`a`\n```\n`b`\n```\nx `c`", T.code_spans(t))] == [(1, "a"), (5, "c")]
    assert one("a = 'x' + 12 // y", T.admission_tokens(t)) == ["a", "=", "<str>", "+", "<num>"]
    assert one("a\n/* b\nc */ d", T.mask_comments(t)) == "a\n\n d" and [r.line for r in one("x\n\ny x", T.matches(t, "x"))] == [1, 3]


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([(1, "a/<b>", "high", 3), (2, "a/<b>", "high", 4), (3, "c/d", "low", 1)], "doc_id long, rule_id string, severity string, line int")
    assert sorted(r.value for r in sinks.brief_lines(found).collect()) == ["high        2 a/<b>", "low         1 c/d"]
    assert sinks.pretty_lines(found.where("doc_id = 1")).first().value == "1:3  high    a/<b>" and "a/&lt;b&gt;" in sinks.html_rows(found).first().value
    hunk = sinks.diff_hunks(spark.createDataFrame([("p", 4, "x", "y")], "path string, line int, old string, new string")).first().value
    assert hunk == "--- a/p\n+++ b/p\n@@ -4,1 +4,1 @@\n-x\n+y"
    receipts = sinks.sharded_json(spark.range(100).withColumnRenamed("id", "k"), ["k"], str(tmp_path / "j"), 4, 10).collect()
    assert sum(r.rows for r in receipts) == 100 and len({r.digest for r in receipts}) == len(receipts) and spark.read.json(str(tmp_path / "j")).count() == 100
    sinks.append_outcomes(spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00")], "id string, at string").withColumn("at", F.to_timestamp("at")), str(tmp_path / "o"))
    stored = spark.read.json(str(tmp_path / "o"))
    assert sinks.outcomes(stored, since="2024-01-02").count() == 1 and sinks.outcomes(stored, without=["a"]).count() == 1 and tables.history(spark, str(tmp_path / "o")).count() == 2
    assert '"names":["x","y"]' in sinks.snapshot(spark.createDataFrame([("m", "y"), ("m", "x")], "kind string, name string"), "kind").first().value
    manifests = spark.createDataFrame([("a", '{"dependencies": {"x": "1"}, "scripts": {"t": "u"}}'), ("b", '{"devDependencies": {"x": "2"}, "workspaces": ["w"]}'), ("c", "no")], "path string, text string")
    facts = tables.manifest_facts(manifests)
    assert facts.count() == 4 and [(r.name, list(r["values"])) for r in tables.conflicts(facts).collect()] == [("x", ["1", "2"])]
    assert [r.path for r in tables.default_selection(spark.createDataFrame([("a.ts",), ("node_modules/b.ts",), ("c.bin",)], "path string")).collect()] == ["a.ts"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_text("eval(x)\n")
    (tmp_path / "in/b.js").write_text("fine")
    seen = []

    def scan(batch, _):
        from textloom.operators.source_rules import source_findings

        seen.extend(r.rule_id for r in source_findings(batch.select("path", "text")).collect())

    events.watch(spark, str(tmp_path / "in")).writeStream.foreachBatch(scan).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert seen == ["security/eval"]
    runs = spark.createDataFrame([("r", True)] * 3 + [("q", True), ("q", False)], "rule_id string, fired boolean").coalesce(1)
    runs.write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    got = []
    events.severities(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "t")).trigger(availableNow=True).start().awaitTermination()
    assert {r.rule_id: (r.runs, r.severity) for r in got} == {"r": (3, "high"), "q": (0, "medium")}
