"""Code measures, surprisal of segments, exact tests and intervals, false discovery, communities, lookups."""

from __future__ import annotations

from math import comb, erfc, exp, factorial, lgamma, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph, scoring
from textloom.operators.overlap import shingled
from textloom.operators.profile import profile
from textloom.sources.tables import table, units

# Operators in the order in which they are tried, and words that count as operators.
OPERATORS = (">>>=", "<<=", "**=", "...", "===", "!==", "**", ">>>", "&&", "||", "??", "?.", "<=", ">=", "==", "!=", "++", "--", "<<", ">>", "=>", *"=+-*/%<>&|^~!?:(){}[],;.")
OPERATOR_WORDS = (
    "if else return const let var function class extends new await async this super import export from as in of for while do switch case break continue try catch finally throw typeof instanceof void delete "
    "yield enum interface type public private protected readonly static abstract implements with default"
).split()


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in text)


CODE_TOKEN = "|".join(map(_escaped, OPERATORS)) + "|" + "|".join(rf"\b{w}\b" for w in OPERATOR_WORDS) + r"|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?"


def halstead(spark: SparkSession, folder: str) -> DataFrame:
    """Volume, difficulty, effort and bugs from operators and operands of the code; all zero where either is missing."""
    d = units(spark, folder).select("doc_id", F.regexp_extract_all(T.plain_code(F.col("text")), F.lit(T.ascii_bounds(CODE_TOKEN)), F.lit(0)).alias("t"))
    known = F.array(*[F.lit(w) for w in OPERATOR_WORDS])
    d = d.withColumn("x", F.filter("t", lambda w: w.rlike(r"^[\w$]") & ~F.array_contains(known, w))).withColumn("o", F.filter("t", lambda w: ~w.rlike(r"^[\w$]") | F.array_contains(known, w)))
    d = d.select("doc_id", F.size("o").alias("ops"), F.size("x").alias("args"), F.size(F.array_distinct("o")).alias("op_kinds"), F.size(F.array_distinct("x")).alias("arg_kinds"))
    some = (F.col("op_kinds") > 0) & (F.col("arg_kinds") > 0)
    volume = F.when(some, (F.col("ops") + F.col("args")) * F.log2(F.greatest(F.lit(1), F.col("op_kinds") + F.col("arg_kinds")))).otherwise(F.lit(0.0))
    difficulty = F.when(some, F.col("op_kinds") / 2 * F.col("args") / F.greatest(F.lit(1), F.col("arg_kinds"))).otherwise(F.lit(0.0))
    d = d.withColumn("volume", volume).withColumn("difficulty", difficulty)
    bugs = F.pow(F.col("volume") * F.col("difficulty"), F.lit(2 / 3)) / 3000
    counts = [F.when(some, F.col(a)).otherwise(0).alias(b) for a, b in (("ops", "length1"), ("args", "length2"), ("op_kinds", "kinds1"), ("arg_kinds", "kinds2"))]
    return d.select("doc_id", *counts, F.round("volume", 4).alias("volume"), F.round("difficulty", 6).alias("difficulty"), F.round(bugs, 4).alias("bugs"))


_WORDS = ", ".join(f"'{w}'" for w in OPERATOR_WORDS)
HALSTEAD_SQL = rf"""WITH p AS (SELECT doc_id, {T.plain_code_sql("text")} AS c FROM documents),
t AS (SELECT doc_id, regexp_extract_all(c, '{CODE_TOKEN}') AS t FROM p),
d AS (SELECT doc_id, list_filter(t, lambda w: regexp_matches(w, '^[\w$]') AND NOT list_contains([{_WORDS}], w)) AS x, list_filter(t, lambda w: NOT regexp_matches(w, '^[\w$]') OR list_contains([{_WORDS}], w)) AS o FROM t),
c AS (SELECT doc_id, len(o) AS a, len(x) AS b, len(list_distinct(o)) AS c, len(list_distinct(x)) AS d FROM d),
v AS (SELECT *, CASE WHEN c > 0 AND d > 0 THEN (a + b) * log2(c + d) ELSE 0 END AS v, CASE WHEN c > 0 AND d > 0 THEN c / 2 * b / d ELSE 0 END AS w, c > 0 AND d > 0 AS s FROM c)
SELECT doc_id, CASE WHEN s THEN a ELSE 0 END::INT AS length1, CASE WHEN s THEN b ELSE 0 END::INT AS length2, CASE WHEN s THEN c ELSE 0 END::INT AS kinds1, CASE WHEN s THEN d ELSE 0 END::INT AS kinds2,
round(v, 4)::DOUBLE AS volume, round(w, 6)::DOUBLE AS difficulty, round(pow(v * w, 2 / 3) / 3000, 4) AS bugs FROM v"""


def segment_surprisal(spark: SparkSession, folder: str) -> DataFrame:
    """Variation of the mean surprisal over 20 equal segments, under the document's own add-one trigram model, for 200 tokens or more.

    Contexts don't reach over the start of a segment: its first two tokens count as one of as many equal chances as there are types.
    """
    r = profile(units(spark, folder), "surprisal").where("s_cv IS NOT NULL")
    flat = (F.col("s_cv") < 0.1) & (F.col("s_step") < 0.5)
    return r.select("doc_id", F.round("s_cv", 5).alias("cv"), F.round("s_range", 5).alias("range"), F.round("s_step", 5).alias("steepest"), flat.alias("flat"))


SURPRISAL_SQL = r"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS token, unnest(generate_series(0, len(w) - 1)) AS pos, len(w) AS n FROM a WHERE len(w) >= 200),
l AS (SELECT *, coalesce(lag(token, 1) OVER o, '<s>') AS l1, coalesce(lag(token, 2) OVER o, '<s>') AS l2, least(pos // (n // 20), 19) AS seg FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, pos - seg * (n // 20) AS k, count(*) OVER (PARTITION BY doc_id, l2, l1, token) AS tri, count(*) OVER (PARTITION BY doc_id, l2, l1) AS bi FROM l), v AS (SELECT doc_id, count(DISTINCT token) AS v FROM t GROUP BY 1),
g AS (SELECT doc_id, seg, avg(-log2(CASE WHEN k < 2 THEN 1 / v ELSE (tri + 1) / (bi + v) END)) AS s FROM c JOIN v USING (doc_id) GROUP BY 1, 2), h AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY doc_id ORDER BY seg)) AS step FROM g),
r AS (SELECT doc_id, stddev_pop(s) / avg(s) AS cv, max(s) - min(s) AS range, max(step) AS steepest FROM h GROUP BY 1)
SELECT doc_id, round(cv, 5) AS cv, round(range, 5) AS "range", round(steepest, 5) AS steepest, cv < 0.1 AND steepest < 0.5 AS flat FROM r"""


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2 by 2 table: the chance of all tables no likelier than it."""
    n, r, k = a + b + c + d, a + b, a + c

    def chance(x: int) -> float:
        return exp(_choose(r, x) + _choose(n - r, k - x) - _choose(n, k))

    seen = chance(a)
    return min(1.0, sum(p for x in range(max(0, k - (n - r)), min(r, k) + 1) if (p := chance(x)) <= seen + 1e-12))


def _choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share, by bisection on binomial tails."""
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2

    def at_least(p: float) -> float:
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if n <= 300 else _tail(k, n, p)

    def find(test) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if test(middle) else (middle, high)
        return (low + high) / 2

    low = 0.0 if k == 0 else find(lambda p: at_least(p) > tail)
    high = 1.0 if k == n else find(lambda p: 1 - at_least(p) + _mass(k, n, p) < tail)
    return low, high


def _mass(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == (0 if p == 0.0 else n))
    return exp(_choose(n, k) + k * log(p) + (n - k) * log(1 - p))


def _tail(k: int, n: int, p: float) -> float:
    return sum(_mass(i, n, p) for i in range(k, n + 1))


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """Signed-rank statistic (the smaller sum) and two-sided normal p-value: zeros dropped, tied sizes share their mean rank."""
    some = sorted((abs(d), d > 0) for d in differences if d != 0)
    n = len(some)
    if not n:
        return 0.0, 1.0
    up = down = 0.0
    at = 0
    while at < n:
        to = at
        while to < n and some[to][0] == some[at][0]:
            to += 1
        rank = (at + 1 + to) / 2
        for _, positive in some[at:to]:
            up, down = (up + rank, down) if positive else (up, down + rank)
        at = to
    z = (min(up, down) - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
    return min(up, down), min(1.0, erfc(abs(z) / 2**0.5))


def bootstrap(rows: DataFrame, group: str, value: str, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """One row: the mean of a value with the 2.5 and 97.5 percentiles of means over groups drawn with replacement.

    Executors reduce the rows to a sum and a number for each group; the draw of groups is a Poisson weight by hash for each group and replicate, so
    no task holds all groups.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    u = (F.xxhash64(F.col(group).cast("string"), "r", F.lit(seed)).cast("double") + 2.0**63) / 2.0**64
    steps = [F.lit(exp(-1) * sum(1 / factorial(i) for i in range(k + 1))) for k in range(8)]
    drawn = g.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", sum(((u > c).cast("int") for c in steps), F.lit(0)))
    means = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m")).where("m IS NOT NULL")
    whole = g.agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    return whole.crossJoin(means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high")))  # a row each


def posterior(prior: float, ratios: list[float]) -> float:
    """Probability after independent likelihood ratios."""
    odds = prior / (1 - prior)
    for r in ratios:
        odds *= r
    return odds / (1 + odds)


def bh_fdr(spark: SparkSession, folder: str, alpha: float = 0.05) -> DataFrame:
    """Rules whose fires differ between arms by the exact test, false discoveries held at alpha. There are as many rows as rules."""
    c = scoring.rule_confusion(spark, folder)
    labels = table(spark, folder, "labels").where("quality IS NOT NULL").join(units(spark, folder).select("doc_id"), "doc_id")
    arms = labels.agg(F.sum((F.col("quality") == 0).cast("long")).alias("pos"), F.sum((F.col("quality") != 0).cast("long")).alias("neg"))

    @F.pandas_udf("double")
    def exact(tp: pd.Series, fp: pd.Series, pos: pd.Series, neg: pd.Series) -> pd.Series:
        return pd.Series([fisher(a, b, p - a, q - b) for a, b, p, q in zip(tp, fp, pos, neg, strict=True)])

    p = c.crossJoin(F.broadcast(arms)).select("rule_id", "tp", "fp", exact("tp", "fp", "pos", "neg").alias("p"))
    w = Window.orderBy("p", "rule_id")
    p = p.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    cut = F.max(F.when(F.col("p") <= F.col("k") / F.col("n") * alpha, F.col("k"))).over(Window.partitionBy())
    return p.withColumn("cut", cut).select("rule_id", "tp", "fp", "p", (F.col("k") <= F.coalesce("cut", F.lit(0))).alias("discovery"))


def stem_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Stems (last words) of part names with two variants or more. Adapted: stands for component names and their suffixes."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("name")).where("name IS NOT NULL").distinct()
    stem = F.regexp_extract("name", r"[^ ]+$", 0)
    g = names.groupBy(stem.alias("stem")).agg(F.count("*").alias("variants"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))
    return g.where("variants >= 2")


STEM_SQL = r"""SELECT stem, count(*) AS variants, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT DISTINCT p_name AS name, regexp_extract(p_name, '[^ ]+$') AS stem FROM part WHERE p_name IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2"""


def louvain(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Communities of one graph that fits a task: nodes move to the neighbouring group of most gain until none gains, groups become nodes, again."""
    member = {n: n for e in edges for n in e[:2]}
    total = sum(w for _, _, w in edges)
    now = [(a, b, w) for a, b, w in edges]
    while total:
        links: dict[int, dict[int, float]] = {}
        loops: dict[int, float] = {}
        for a, b, w in now:
            if a == b:
                loops[a] = loops.get(a, 0) + w
                links.setdefault(a, {})
            else:
                links.setdefault(a, {})[b] = links.setdefault(a, {}).get(b, 0) + w
                links.setdefault(b, {})[a] = links.setdefault(b, {}).get(a, 0) + w
        degree = {n: sum(x.values()) + 2 * loops.get(n, 0) for n, x in links.items()}
        group, weight = {n: n for n in links}, dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in sorted(links):
                own = group[n]
                weight[own] -= degree[n]
                to: dict[int, float] = {own: 0.0}
                for m, w in links[n].items():
                    to[group[m]] = to.get(group[m], 0) + w
                gain = {g: w - weight[g] * degree[n] / (2 * total) for g, w in to.items()}
                best = max(sorted(gain), key=gain.__getitem__)
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                weight[best] += degree[n]
                if best != own:
                    group[n], moved, any_move = best, True, True
        if not any_move:
            break
        merged: dict[tuple[int, int], float] = {}
        for a, b, w in now:
            key = min(group[a], group[b]), max(group[a], group[b])
            merged[key] = merged.get(key, 0) + w
        now = [(a, b, w) for (a, b), w in merged.items()]
        member = {n: group[g] for n, g in member.items()}
    return member


def graph_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of nations that buy from one another's suppliers, of a graph with a node for each nation."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
    s = table(spark, folder, "lineitem").join(F.broadcast(table(spark, folder, "supplier")), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("b"))
    e = graph.normalised(o.join(s, "o_orderkey").groupBy("a", "b").agg(F.count("*").alias("w")))

    def find(g: pd.DataFrame) -> pd.DataFrame:
        found = louvain([(int(a), int(b), float(w)) for a, b, w in g[["a", "b", "w"]].sort_values(["a", "b"]).itertuples(index=False)])
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return e.withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(find, "node long, community long")


def find_similar(docs: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The k units (1 to 50) whose shingles are most like a text's; those that share none aren't there."""
    probe = shingled(docs.sparkSession.createDataFrame([(-1, "", text)], "doc_id long, lang string, text string")).select("s").first()
    own = F.array(*[F.lit(x) for x in (probe.s if probe else [])]).cast("array<bigint>")
    both = shingled(docs).withColumn("i", F.size(F.array_intersect("s", own)))
    return both.where("i > 0").select("doc_id", (F.col("i") / (F.col("n") + F.size(own) - F.col("i"))).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(max(1, min(50, k)))


def check_constitution(imports: DataFrame, declared: DataFrame, forbidden: list[str]) -> DataFrame:
    """Imports (path, package) that aren't declared (package), or whose package is forbidden or begins with a forbidden name and a slash."""
    bad = F.lit(False)
    for name in forbidden:
        bad = bad | (F.col("package") == name) | F.col("package").startswith(f"{name}/")
    unknown = imports.join(declared.select("package").distinct(), "package", "left_anti").select("path", "package", F.lit("undeclared").alias("reason"))
    return imports.where(bad).select("path", "package", F.lit("forbidden").alias("reason")).unionByName(unknown)


QUERIES = {"halstead": halstead, "segment_surprisal": segment_surprisal, "bh_fdr": bh_fdr, "stem_drift": stem_drift, "graph_communities": graph_communities}
ORACLES = {"halstead": HALSTEAD_SQL, "segment_surprisal": SURPRISAL_SQL, "stem_drift": STEM_SQL}
