from itertools import combinations
from math import comb

import numpy as np

from textloom.functions import hashes
from textloom.operators.evidence import cluster_bootstrap, composite_id, ks_p_value, mined_rules, review_decisions, rule_intervals
from textloom.operators.policy import compared, select_corpus, undisabled
from textloom.operators.project import coherence, constitution_score, repository_health


def test_ks_against_all_orders():
    for n, m in ((3, 4), (5, 5), (2, 7)):
        gaps = []
        for places in combinations(range(n + m), n):
            a = b = 0
            gap = 0.0
            for k in range(n + m):
                a, b = (a + 1, b) if k in places else (a, b + 1)
                gap = max(gap, abs(a / n - b / m))
            gaps.append(gap)
        for gap in sorted(set(gaps)):
            assert abs(ks_p_value(gap, n, m) - sum(g >= gap - 1e-12 for g in gaps) / comb(n + m, n)) < 1e-9
    assert ks_p_value(0.5, 0, 3) == 1.0 and ks_p_value(1.5, 3, 3) == 0.0 and ks_p_value(0.9, 100, 100) == 0.0 and abs(ks_p_value(0.2, 50, 50) - 0.2700) < 1e-3


def test_signatures_against_integers():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**32, 3000, dtype=np.uint64))
    sig = hashes.signature(x, 16)
    for i in range(16):
        a, b = hashes.parameters(i)
        assert sig[i] == min((a * int(v) + b) % (2**61 - 1) & 0xFFFFFFFF for v in x)
    assert hashes.parameters(0) == (1, 0) and (hashes.signature(np.zeros(0, dtype=np.uint64)) == 0xFFFFFFFF).all()
    assert hashes.similarity(sig, sig) == 1.0 and hashes.fnv1a("hello") == 0x4F9F2CAB
    assert hashes.shape("if (a > 0x1f) { return 'b' } // c") == ["if", "(", "id", ">", "num", ")", "{", "return", "str", "}"]


def test_bootstrap_and_ids():
    got = cluster_bootstrap([(10, 5, 10, 1), (10, 9, 0, 0), (4, 0, 8, 8)], 7, 400)
    assert got["recall"][0] < (0.5 + 0.9 + 0) / 3 < got["recall"][1] and got["fpr"][0] < (0.1 + 1) / 2 < got["fpr"][1] and cluster_bootstrap([(1, 1, 0, 0)], 1) == {}
    assert cluster_bootstrap([(10, 5, 10, 1)], 7, 10) == cluster_bootstrap([(10, 5, 10, 1)], 7, 10)
    assert composite_id(["b", "a"]) == composite_id(["a", "b"]) and composite_id(["a"]).startswith("composite/")


def test_decisions(spark):
    rows = [("few", 3, 1, 30, 0), ("worse", 2, 40, 40, 2), ("low", 10, 40, 9, 40), ("on", 95, 5, 5, 95), ("advice", 70, 30, 40, 60), ("open", 55, 45, 45, 55)]
    got = {r.rule_id: r.outcome for r in review_decisions(spark.createDataFrame(rows, "rule_id string, f_useful long, f_not long, c_useful long, c_not long")).collect()}
    assert got == {"few": "insufficient-evidence", "worse": "default-off", "low": "default-off", "on": "default-on", "advice": "quality-advisory", "open": "insufficient-evidence"}


def test_policy_parts(spark):
    found = spark.createDataFrame([(1, "r", 2), (1, "r", 3), (1, "s", 2), (2, "r", 2)], "doc_id long, rule_id string, line int")
    hide = spark.createDataFrame([(1, "r", "block", 3), (2, "r", "next-line", 2)], "doc_id long, rule_id string, scope string, at int")
    assert sorted(map(tuple, undisabled(found, hide).collect())) == [(1, "r", 2), (1, "s", 2)]
    a, b = spark.createDataFrame([("x",), ("y",)], "identity string"), spark.createDataFrame([("y",), ("z",)], "identity string")
    assert {r.identity: r.change for r in compared(a, b).collect()} == {"x": "new", "y": "unchanged", "z": "resolved"}
    files = spark.createDataFrame([(k, "verified_ai", "gold", "train", "en", 8) for k in range(5)] + [(9, None, "gold", "train", "en", 8)], "file_id long, label string, tier string, split string, language string, stratum int")
    got = [r.reason for r in select_corpus(files, "s", 2).collect()]
    assert got.count(None) == 2 and got.count("stratum_quota_reached") == 3 and got.count("label_not_eligible") == 1


def test_scores(spark):
    axes = spark.createDataFrame([("a", "slopIndex", 50.0), ("a", "dbHealth", 100.0), ("b", "slopIndex", None)], "project string, axis string, health double")
    less = spark.createDataFrame([("a", "critical", 3), ("b", "low", 0)], "project string, risk string, high int")
    assert {r.project: (r.score, r.debt) for r in repository_health(axes, less).collect()} == {"a": (47.0, "high"), "b": (0.0, "critical")}
    counts = spark.createDataFrame([(k,) for k in (0, 1, 2, 4, 7, 15, 25)], "n int")
    assert [r[0] for r in counts.select(constitution_score(counts.n)).collect()] == [100.0, 80.0, 70.0, 50.0, 32.0, 10.0, 0.0]
    rows = spark.createDataFrame([(None, None, None, None), (100.0, 0.0, 0, "low")], "architecture double, fragmentation double, violations int, debt string")
    assert [r.coherence for r in coherence(rows).collect()] == [78.0, 100.0]


def test_mining(spark, tmp_path):
    from tests.conftest import SF

    assert {r.members for r in mined_rules(spark, SF, 0.01, -1.0, 1.1).collect()} and rule_intervals(spark, SF).where("recall_low > recall_high").count() == 0
