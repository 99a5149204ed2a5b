from collections import Counter

import pytest

from textloom.operators import rule_cases
from textloom.operators.catalog import RULES as CATALOG
from textloom.operators.rules import STATISTICAL, pattern_findings


@pytest.fixture(scope="module")
def found(spark):
    return Counter((r.path, r.rule_id, r.line) for r in rule_cases.case_findings(spark).collect())


def test_every_rule_has_a_case():
    elsewhere = {r[0] for r in STATISTICAL} | {"security/hardcoded-secret", "dup/identical-block", "dup/near-duplicate", "dup/structural-clone", "ai/segment-surprisal-cv", "ai/comment-ratio"}
    assert {r for _, r, _ in rule_cases.expected()} == {r[0] for r in CATALOG} - elsewhere


def test_rules_find_what_they_should(found):
    want = Counter(rule_cases.expected())
    assert (want - found, found - want) == (Counter(), Counter())


def test_units_without_path_or_text(spark):
    from textloom.operators.source_rules import source_findings

    units = spark.createDataFrame([(None, "eval(x)"), ("a.js", None), ("b.js", ""), ("c.js", "a\n//eval(b)\n\neval(x)")], "path string, text string")
    assert [tuple(r) for r in source_findings(units).collect()] == [("c.js", "security/eval", 4)]


def test_secrets(spark):
    texts = ["x\n/* a\nb */\ntoken = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"", "token = \"short\"", None, "// token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.n, r.line) for r in pattern_findings(frame).collect()] == [(0, 1, 4)]


def test_class_gini(spark):
    from textloom.operators.families import class_gini

    g = class_gini(spark.createDataFrame([(1, '<a class="x y"><b class="x"><i class="x">')], "doc_id long, text string")).first()
    assert (g.classes, g.total, g.gini) == (2, 4, 0.25)


def test_all_findings_hold_rules_without_sql(spark, tmp_path):
    import random
    import zlib
    from collections import Counter

    from textloom.operators import rules

    rng = random.Random(6)
    line = "value of this line is much like the value of that line "
    texts = {1: "\n".join(line + str(k % 3) for k in range(80)), 2: "```ts\nimport x from 'y'", 3: "\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=60)) for _ in range(60)), 4: "short", 5: "see\n```ts\nimport x", 6: 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'}
    spark.createDataFrame([(k, t, "en", "a") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def squeezed(x):
        return len(zlib.compress(x.encode(), 9))

    def profile(t):
        lines = [x for x in t.split("\n") if x.strip()]
        ncd = [(squeezed(a + b) - min(squeezed(a), squeezed(b))) / max(squeezed(a), squeezed(b)) for a, b in zip(lines, lines[1:])]
        mean = sum(ncd) / len(ncd) if ncd else 0
        cv = (sum((x - mean) ** 2 for x in ncd) / len(ncd)) ** 0.5 / max(mean, 0.001) if ncd else 0
        return len(t.encode()) >= 2000 and (1 - squeezed(t) / len(t.encode()) > 0.6) + (1e-12 <= mean <= 0.25) + (1e-12 <= cv <= 0.4) >= 2

    got = Counter((r.doc_id, r.rule_id, r.category, r.severity, r.ai_specific, r.n, r.line) for r in rules.all_findings(spark, str(tmp_path)).collect())
    some = Counter((r.doc_id, r.rule_id, r.category, r.severity, r.ai_specific, r.n, r.line) for r in rules.findings(spark, str(tmp_path)).collect())
    want = [(k, "ai/compression-profile", "ai", "low", True, 1, 1) for k, t in texts.items() if profile(t)] + [(2, "ai/markdown-leakage", "ai", "high", True, 1, 1), (5, "ai/markdown-leakage", "ai", "high", True, 1, 2)]
    assert len(want) > 1 and (1, "ai/compression-profile") in {w[:2] for w in want} and got - some == Counter(want) and not some - got
