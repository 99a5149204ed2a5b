"""Evidence on rules and texts: naturalness, description lengths, distances of samples, composite rules, reviews, and windows over histories."""

from __future__ import annotations

from math import comb, exp, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import rules, scoring
from textloom.operators.catalog import RULES
from textloom.operators.source_rules import most_in_window
from textloom.plans.components import components, kept
from textloom.sources.tables import table, units

# Size of the vocabulary that names have the same chance in; rules that generated or written code favours; weights of these and of others.
VOCABULARY = 373
AI_FAVOURED = (
    "test/weak-assertion", "logic/math-console-log-storm", "visual/math-rounded-entropy", "logic/reactive-hook-soup", "security/sql-construction", "wcag/focus-appearance", "security/missing-auth-check",
    "component/shadcn-prop-mismatch", "visual/math-default-font", "logic/optimistic-no-rollback", "logic/math-gini-class-usage", "security/dangerous-cors", "visual/math-color-cluster", "logic/zombie-state",
    "test/duplicate-setup", "logic/ghost-defensive", "security/fail-open-auth",
)
HUMAN_FAVOURED = (
    "component/multiple-components-per-file", "context/import-path-mismatch", "visual/spacing-scale-violation", "visual/inline-style-dominance", "security/public-admin-route", "security/unsafe-html-render",
    "logic/key-prop-missing", "layout/spacing-grid", "typo/math-button-label-uniformity", "logic/math-variable-name-entropy",
)
FAVOURED, OTHER, FLOOR = 1.0, 0.01, 1e-6


def naturalness(spark: SparkSession, folder: str) -> DataFrame:
    """Names and numbers of the code: how many, how many different, and entropy and perplexity under equal chances; 0, 0 and 1 without any."""
    t = F.regexp_extract_all(T.plain_code(F.col("text")), F.lit(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?"), F.lit(0))
    d = units(spark, folder).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("length"), F.size(F.array_distinct("t")).alias("kinds"))
    some = F.col("length") > 0
    return d.select("doc_id", "length", "kinds", F.round(F.when(some, F.col("kinds") / F.col("length")).otherwise(0.0), 6).alias("ratio"), F.when(some, F.lit(round(log2(VOCABULARY), 6))).otherwise(0.0).alias("entropy"), F.when(some, F.lit(float(VOCABULARY))).otherwise(1.0).alias("perplexity"))


NATURAL_SQL = rf"""WITH c AS (SELECT doc_id, {T.plain_code_sql("text")} AS c FROM documents), t AS (SELECT doc_id, regexp_extract_all(c, '[A-Za-z_$][\w$]*|\d+(?:\.\d+)?') AS t FROM c)
SELECT doc_id, len(t)::INT AS length, len(list_distinct(t))::INT AS kinds, round(CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END, 6)::DOUBLE AS ratio, CASE WHEN len(t) > 0 THEN {round(log2(VOCABULARY), 6)} ELSE 0 END::DOUBLE AS entropy,
CASE WHEN len(t) > 0 THEN {VOCABULARY} ELSE 1 END::DOUBLE AS perplexity FROM t"""


def _chances() -> dict[str, tuple[float, float]]:
    """Chance of each rule in the two models."""
    weights = {r[0]: (FAVOURED if r[0] in AI_FAVOURED else OTHER, FAVOURED if r[0] in HUMAN_FAVOURED else OTHER) for r in RULES}
    totals = [sum(w[k] for w in weights.values()) for k in (0, 1)]
    return {r: (w[0] / totals[0], w[1] / totals[1]) for r, w in weights.items()}


def description_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Log likelihoods of each document's fired rules in the two models, and their difference; rules that a model lacks have FLOOR."""
    chances = spark.createDataFrame([(r, a, b) for r, (a, b) in _chances().items()], "rule_id string, ai double, human double")
    fired = rules.findings(spark, folder).select("doc_id", "rule_id").distinct().join(F.broadcast(chances), "rule_id", "left")
    a, b = (F.sum(F.ln(F.coalesce(k, F.lit(FLOOR)))) for k in ("ai", "human"))
    return fired.groupBy("doc_id").agg(F.round(a, 6).alias("ai"), F.round(b, 6).alias("human"), F.round(a - b, 5).alias("ratio"))


_CHANCES = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for r, (a, b) in _chances().items()) + ") AS t(rule_id, ai, human))"
LENGTHS_SQL = f"""WITH f AS (SELECT DISTINCT doc_id, rule_id FROM ({rules.FINDINGS_SQL})), {_CHANCES}
SELECT doc_id, round(sum(ln(coalesce(ai, {FLOOR}))), 6) AS ai, round(sum(ln(coalesce(human, {FLOOR}))), 6) AS human, round(sum(ln(coalesce(ai, {FLOOR}))) - sum(ln(coalesce(human, {FLOOR}))), 5) AS ratio FROM f LEFT JOIN m USING (rule_id) GROUP BY 1"""

#: Members of composite rules and how many must fire on a document.
COMPOSITES = (
    ("composite/spread", ("ai/renyi-profile", "logic/zipf-slope-anomaly", "logic/heaps-deviation"), 2), ("composite/layout", ("ai/whitespace-regularity", "logic/heaps-deviation"), 2),
    ("composite/ai-fingerprint-cluster", ("ai/compression-profile", "ai/comment-ratio", "ai/segment-surprisal-cv"), 2),
)


def composite_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Composite rules that fire, with the number of their members that do."""
    members = spark.createDataFrame([(c, r, n) for c, rs, n in COMPOSITES for r in rs], "composite string, rule_id string, least int")
    fired = rules.findings(spark, folder).select("doc_id", "rule_id").distinct().join(F.broadcast(members), "rule_id")
    return fired.groupBy("doc_id", "composite").agg(F.count("*").alias("members"), F.max("least").alias("least")).where("members >= least").drop("least")


_MEMBERS = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}', {n})" for c, rs, n in COMPOSITES for r in rs) + ") AS t(composite, rule_id, least))"
COMPOSITES_SQL = f"WITH f AS (SELECT DISTINCT doc_id, rule_id FROM ({rules.FINDINGS_SQL})), {_MEMBERS} SELECT doc_id, composite, count(*) AS members FROM f JOIN m USING (rule_id) GROUP BY 1, 2 HAVING count(*) >= max(least)"


def composite_id(members: list[str]) -> str:
    import hashlib

    return "composite/" + hashlib.sha1("\n".join(sorted(members)).encode()).hexdigest()[:12]


def mined_rules(spark: SparkSession, folder: str, min_support: float = 0.01, min_npmi: float = 0.05, max_p: float = 0.01) -> DataFrame:
    """Groups of rules that fire together: rules on enough documents, pairs of enough mutual information that an exact test doesn't leave to chance, and what
    these join. There are as many rows as rules."""
    from textloom.operators.inference import fisher

    n = table(spark, folder, "documents").count()
    pairs = scoring.rule_cooccurrence(spark, folder).where((F.col("ka") >= max(1, int(-(-min_support * n // 1)))) & (F.col("kb") >= max(1, int(-(-min_support * n // 1)))) & (F.col("npmi") >= min_npmi))

    @F.pandas_udf("double")
    def exact(both: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.Series:
        return pd.Series([fisher(b, x - b, y - b, n - x - y + b) for b, x, y in zip(both, ka, kb, strict=True)])

    strong = kept(pairs.withColumn("p", exact("both", "ka", "kb")).where(F.col("p") <= max_p))
    groups = components(strong, "a", "b")
    return groups.withColumn("members", F.count("*").over(Window.partitionBy("component"))).select(F.col("node").alias("rule_id"), F.col("component").alias("group"), "members")


def ks_p_value(gap: float, n: int, m: int) -> float:
    """Chance of a gap so large between two samples of one continuous distribution: exact to 40 values in all, by counting paths, and asymptotic beyond."""
    if n == 0 or m == 0 or gap < 0:
        return 1.0
    if gap > 1:
        return 0.0
    if n + m <= 40:
        if gap <= 0:
            return 1.0
        limit = gap - 1e-12
        ways = np.zeros(m + 1)
        for i in range(n + 1):
            row = np.zeros(m + 1)
            for j in range(m + 1):
                if abs(i / n - j / m) <= limit:
                    row[j] = 1.0 if i == j == 0 else (ways[j] if i else 0.0) + (row[j - 1] if j else 0.0)
            ways = row
        return float(min(1.0, max(0.0, 1 - ways[m] / comb(n + m, n))))
    size = (n * m / (n + m)) ** 0.5 * gap
    if size > 3.6:
        return 0.0
    total = 0.0
    for j in range(1, 1000):
        term = 2 * (-1) ** (j - 1) * exp(-2 * j * j * size * size)
        total += term
        if abs(term) < 1e-15:
            break
    return min(1.0, max(0.0, total))


def ks_features(spark: SparkSession, folder: str, alpha: float = 0.05) -> DataFrame:
    """Kolmogorov-Smirnov tests of good and bad documents on some features, significant at alpha shared by the features.

    Cumulative counts run over each feature's distinct values, in one task for each feature.
    """
    labels = table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    d = units(spark, folder).join(labels, "doc_id")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    values = {"chars": F.length("text"), "words": words, "lines": T.newlines(F.col("text")) + 1}
    rows = d.select("quality", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("long").alias("v")) for k, v in values.items()])).alias("f")).select("quality", "f.*")
    c = rows.groupBy("feature", "v").agg(F.sum((F.col("quality") == 1).cast("long")).alias("a"), F.sum((F.col("quality") == 0).cast("long")).alias("b"))
    order, every = Window.partitionBy("feature").orderBy("v"), Window.partitionBy("feature")
    c = c.withColumn("ca", F.sum("a").over(order)).withColumn("cb", F.sum("b").over(order)).withColumn("na", F.sum("a").over(every)).withColumn("nb", F.sum("b").over(every))
    g = c.groupBy("feature").agg(F.max("na").alias("n_good"), F.max("nb").alias("n_bad"), F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))

    @F.pandas_udf("double")
    def chance(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_p_value(x, int(a), int(b)) for x, a, b in zip(gap, n, m, strict=True)])

    g = g.withColumn("p", chance("ks", "n_good", "n_bad"))
    return g.select("feature", "n_good", "n_bad", F.round("ks", 6).alias("ks"), F.round("p", 6).alias("p"), (F.col("p") < alpha / len(values)).alias("significant"))


FEATURES_SQL = r"""WITH d AS (SELECT quality, text FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND coalesce(text, '') <> ''),
r AS (SELECT quality, 'chars' AS feature, length(text) AS v FROM d UNION ALL SELECT quality, 'words', len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM d UNION ALL SELECT quality, 'lines', length(text) - length(replace(text, chr(10), '')) + 1 FROM d),
c AS (SELECT feature, v, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM r GROUP BY 1, 2),
w AS (SELECT *, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM c WINDOW o AS (PARTITION BY feature ORDER BY v)),
g AS (SELECT feature, max(na)::BIGINT AS n_good, max(nb)::BIGINT AS n_bad, max(abs(ca / na - cb / nb)) AS ks FROM w GROUP BY 1),
p AS (SELECT *, CASE WHEN sqrt(n_good * n_bad / (n_good + n_bad)) * ks > 3.6 THEN 0.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(generate_series(1, 100), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * ks * ks * n_good * n_bad / (n_good + n_bad)))))) END AS p FROM g)
SELECT feature, n_good, n_bad, round(ks, 6) AS ks, round(p, 6) AS p, p < 0.05 / 3 AS significant FROM p"""

#: Determinate reviews that each side of a rule needs.
DETERMINATE = 20


def _outward(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's interval rounded away from the share."""
    return F.floor(scoring.wilson(k, n, -1) * 1_000_000) / 1_000_000, F.ceil(scoring.wilson(k, n, 1) * 1_000_000) / 1_000_000


def review_decisions(counts: DataFrame, evidence_class: str = "contextual-quality", last_round: bool = True) -> DataFrame:
    """What reviews say of each rule: counts (rule_id, f_useful, f_not, c_useful, c_not) are useful and useless ones of findings and of controls."""
    c = counts.withColumn("f_n", F.col("f_useful") + F.col("f_not")).withColumn("c_n", F.col("c_useful") + F.col("c_not"))
    f_low, f_high = _outward(F.col("f_useful"), F.col("f_n"))
    c_low, c_high = _outward(F.col("c_useful"), F.col("c_n"))
    c = c.withColumn("f_low", f_low).withColumn("f_high", f_high).withColumn("c_low", c_low).withColumn("c_high", c_high)
    review = (F.col("f_low") >= 0.5) & (F.col("f_low") > F.col("c_high"))
    outcome = (
        F.when((F.col("f_n") < DETERMINATE) | (F.col("c_n") < DETERMINATE), "insufficient-evidence").when(F.col("f_high") <= F.col("c_low"), "default-off").when(F.col("f_high") < 0.5, "default-off")
        .when(F.lit(evidence_class == "contextual-quality") & (F.col("f_low") >= 0.7) & (F.col("c_high") <= 0.3), "default-on").when(review & F.lit(evidence_class == "statistical-review-utility" or last_round), "quality-advisory")
        .otherwise("insufficient-evidence")
    )
    return c.withColumn("outcome", outcome)


def quality_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions where a document's low quality stands for a useful review; controls are labelled documents on which the rule doesn't fire."""
    labelled, fired = scoring._fires(spark, folder)
    all_ = labelled.agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    c = labelled.join(fired, "doc_id").groupBy("rule_id").agg(F.sum(F.col("positive").cast("long")).alias("f_useful"), F.sum((~F.col("positive")).cast("long")).alias("f_not")).crossJoin(F.broadcast(all_))
    c = c.select("rule_id", "f_useful", "f_not", (F.col("pos") - F.col("f_useful")).alias("c_useful"), (F.col("neg") - F.col("f_not")).alias("c_not"))
    return review_decisions(c).select("rule_id", "f_useful", "f_n", "c_useful", "c_n", *[F.coalesce(k, F.lit(-1.0)).alias(k) for k in ("f_low", "f_high", "c_low", "c_high")], "outcome")


def _wilson(k: str, n: str, sign: str) -> str:
    z, p = "1.959963984540054", f"({k} / {n})"
    raw = f"greatest(0.0, least(1.0, ({p} + {z} * {z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n})))"
    return f"CASE WHEN {n} > 0 THEN {'floor' if sign == '-' else 'ceil'}({raw} * 1000000) / 1000000 ELSE -1.0 END"


REVIEW_SQL = f"""WITH f AS (SELECT DISTINCT doc_id, rule_id FROM ({rules.FINDINGS_SQL})), {scoring._L}, a AS (SELECT count(*) FILTER (WHERE positive) AS pos, count(*) FILTER (WHERE NOT positive) AS neg FROM l),
c AS (SELECT rule_id, count(*) FILTER (WHERE positive) AS fu, count(*) FILTER (WHERE NOT positive) AS fn FROM l JOIN f USING (doc_id) GROUP BY 1), d AS (SELECT rule_id, fu AS f_useful, fu + fn AS f_n, pos - fu AS c_useful, pos - fu + neg - fn AS c_n FROM c, a),
w AS (SELECT *, {_wilson('f_useful', 'f_n', '-')} AS f_low, {_wilson('f_useful', 'f_n', '+')} AS f_high, {_wilson('c_useful', 'c_n', '-')} AS c_low, {_wilson('c_useful', 'c_n', '+')} AS c_high FROM d)
SELECT *, CASE WHEN f_n < {DETERMINATE} OR c_n < {DETERMINATE} THEN 'insufficient-evidence' WHEN f_high <= c_low OR f_high < 0.5 THEN 'default-off' WHEN f_low >= 0.7 AND c_high <= 0.3 THEN 'default-on' WHEN f_low >= 0.5 AND f_low > c_high THEN 'quality-advisory' ELSE 'insufficient-evidence' END AS outcome FROM w"""


def calibration_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether rules can be calibrated: each eligible document must have been looked at, else nothing is told, for all labels and for each source."""
    eligible = table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id").join(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", "left")
    g = eligible.groupBy("source").agg(F.count("*").alias("eligible"), F.sum((F.coalesce("text", F.lit("")) == "").cast("long")).alias("missing"))
    return g.withColumn("status", F.when(F.col("missing") > 0, "unavailable").otherwise("available"))


STATUS_SQL = """WITH g AS (SELECT source, count(*) AS eligible, sum((coalesce(text, '') = '')::INT)::BIGINT AS missing FROM labels LEFT JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN missing > 0 THEN 'unavailable' ELSE 'available' END AS status FROM g"""


def supported_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on enough documents: five, or one document in twenty where that is more."""
    n = table(spark, folder, "documents").agg(F.count("*").alias("n"))
    s = rules.findings(spark, folder).groupBy("rule_id").agg(F.countDistinct("doc_id").alias("docs")).crossJoin(F.broadcast(n))
    least = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.05), 5 / F.col("n")) * F.col("n") - 1e-9))
    return s.where(F.col("docs") >= least).select("rule_id", "docs")


SUPPORT_SQL = f"WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT rule_id, count(DISTINCT doc_id) AS docs FROM ({rules.FINDINGS_SQL}) GROUP BY 1) SELECT rule_id, docs FROM s, n WHERE docs >= greatest(1, ceil(greatest(0.05, 5 / n) * n - 1e-9))"


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The most long numbers that 30 lines of a document hold, and the line of the first."""
    found = most_in_window(units(spark, folder).select(F.col("doc_id").alias("path"), "text"), r"[0-9]{4,}", 30)
    return found.select(F.col("path").alias("doc_id"), "most", "first")


WINDOW_SQL = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, i, len(regexp_extract_all(l[i], '[0-9]{4,}')) AS n FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM l)),
e AS (SELECT doc_id, i, unnest(generate_series(1, n)) FROM r WHERE n > 0), w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT doc_id, max(n) AS most, min(i)::INT AS first FROM w GROUP BY 1"""


def last_points(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last 30 events: how many, the first and last value and their difference."""
    e = table(spark, folder, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 30")
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("value", "k").alias("first"), F.min_by("value", "k").alias("last"))
    return g.select("user_id", "n", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(F.col("last") - F.col("first"), 5).alias("delta"))


POINTS_SQL = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS n, round(max_by(value, k), 6) AS first, round(min_by(value, k), 6) AS last, round(min_by(value, k) - max_by(value, k), 5) AS delta FROM e WHERE k <= 30 GROUP BY 1"""


def sparklines(spark: SparkSession, folder: str) -> DataFrame:
    """Each type's number of events by day on a scale of eight steps from its least to its most."""
    d = table(spark, folder, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    low, high = F.min("n").over(w), F.max("n").over(w)
    step = F.least(F.lit(7), F.floor((F.col("n") - low) / F.when(high > low, high - low).otherwise(1) * 8))
    return d.select("event_type", "day", "n", step.cast("int").alias("step"))


SPARK_SQL = """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, min(n) OVER (PARTITION BY event_type) AS a, max(n) OVER (PARTITION BY event_type) AS b FROM d)
SELECT event_type, day, n, least(7, floor((n - a) / CASE WHEN b > a THEN b - a ELSE 1 END * 8))::INT AS step FROM w"""


def chronic_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users among a day's three most active on the table's last day and the days before it without a gap; from three days on they are chronic."""
    d = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    top = d.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "user_id"))).where("k <= 3").select("day", "user_id")
    last = top.agg(F.max("day").alias("last"))
    g = top.crossJoin(F.broadcast(last)).withColumn("back", F.datediff("last", "day")).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("back")) - 1)
    s = g.groupBy("user_id").agg(F.sum((F.col("back") == F.col("i")).cast("long")).alias("days")).where("days > 0")
    return s.withColumn("chronic", F.col("days") >= 3)


CHRONIC_SQL = """WITH d AS (SELECT ts::DATE AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT day, user_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS k FROM d) WHERE k <= 3),
g AS (SELECT user_id, datediff('day', day, (SELECT max(day) FROM t)) AS back, row_number() OVER (PARTITION BY user_id ORDER BY datediff('day', day, (SELECT max(day) FROM t))) - 1 AS i FROM t)
SELECT user_id, count(*) FILTER (WHERE back = i) AS days, count(*) FILTER (WHERE back = i) >= 3 AS chronic FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE back = i) > 0"""


def flywheel(spark: SparkSession, folder: str) -> DataFrame:
    """A history in one table: the ten users of the greatest mean value with their events, and the ten of the greatest sums."""
    e = table(spark, folder, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))
    top = e.orderBy(F.desc("mean"), "user_id").limit(10).select(F.lit("mean").alias("by"), "user_id", F.col("mean").alias("value"), "n")
    return top.unionByName(e.orderBy(F.desc("total"), "user_id").limit(10).select(F.lit("total").alias("by"), "user_id", F.col("total").alias("value"), "n"))


FLYWHEEL_SQL = """WITH e AS (SELECT user_id, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1)
SELECT * FROM (SELECT 'mean' AS "by", user_id, mean AS value, n FROM e ORDER BY mean DESC, user_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'total', user_id, total, n FROM e ORDER BY total DESC, user_id LIMIT 10)"""


def drift_score(spark: SparkSession, folder: str) -> DataFrame:
    """For each type: users that came and went between the halves of the table, the score of that, and how many came undeclared (with an odd number)."""
    e = table(spark, folder, "events").withColumn("late", F.date_format("ts", "yyyy-MM-dd") >= "2024-01-15")
    u = e.groupBy("event_type", "user_id").agg(F.max((~F.col("late")).cast("int")).alias("early"), F.max(F.col("late").cast("int")).alias("late"))
    g = u.groupBy("event_type").agg(*[F.sum(x.cast("long")).alias(k) for k, x in (("base", F.col("early") == 1), ("introduced", F.col("early") == 0), ("removed", F.col("late") == 0), ("undeclared", (F.col("early") == 0) & (F.col("user_id") % 2 == 1)))])
    score = F.least(F.lit(100), F.floor(100 * (F.col("introduced") + F.col("removed")) / F.greatest(F.lit(1), F.col("base")) + 0.5))
    return g.withColumn("score", score.cast("long"))


DRIFT_SCORE_SQL = """WITH u AS (SELECT event_type, user_id, min(ts) < TIMESTAMP '2024-01-15' AS early, max(ts) >= TIMESTAMP '2024-01-15' AS late FROM events GROUP BY 1, 2),
g AS (SELECT event_type, count(*) FILTER (WHERE early) AS base, count(*) FILTER (WHERE NOT early) AS introduced, count(*) FILTER (WHERE NOT late) AS removed, count(*) FILTER (WHERE NOT early AND user_id % 2 = 1) AS undeclared FROM u GROUP BY 1)
SELECT *, least(100, floor(100 * (introduced + removed) / greatest(1, base) + 0.5))::BIGINT AS score FROM g"""


def canonical_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of doubles that don't hang on the order of rows: exact decimals, made doubles at the end."""
    d = F.col("value").cast("decimal(30,12)")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(d).cast("double").alias("total"))


SUMS_SQL = "SELECT event_type, sum(value::DECIMAL(30, 12))::DOUBLE AS total FROM events GROUP BY 1"


def cluster_bootstrap(groups: list[tuple[int, int, int, int]], seed: int, replicates: int = 1000, level: float = 0.95) -> dict[str, tuple[float, float]]:
    """Intervals of recall and false positive rate over families drawn with replacement, by a 32-bit xorshift generator: groups are (positive files,
    positive fires, negative files, negative fires). A list of families fits a task, as a family is many files."""
    pos, neg = [(n, k) for n, k, _, _ in groups if n], [(n, k) for _, _, n, k in groups if n]
    if not pos or not neg:
        return {}
    state = seed & 0xFFFFFFFF or 0x9E3779B9

    def draw(size: int) -> int:
        nonlocal state
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        return state * size >> 32

    values: dict[str, list[float]] = {"recall": [], "fpr": []}
    for _ in range(replicates):
        for name, arm in (("recall", pos), ("fpr", neg)):
            some = [arm[draw(len(arm))] for _ in arm]
            values[name].append(sum(k / n for n, k in some) / len(some))
    tail = (1 - level) / 2
    return {k: (float(np.percentile(v, 100 * tail)), float(np.percentile(v, 100 * (1 - tail)))) for k, v in values.items()}


def rule_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of each rule's macro recall and false positive rate over sources."""
    labelled, fired = scoring._fires(spark, folder)
    sizes = labelled.groupBy("source").agg(F.sum(F.col("positive").cast("int")).alias("pos"), F.sum((~F.col("positive")).cast("int")).alias("neg"))
    hits = labelled.join(fired, "doc_id").groupBy("source", "rule_id").agg(F.sum(F.col("positive").cast("int")).alias("tp"), F.sum((~F.col("positive")).cast("int")).alias("fp"))
    rows = hits.select("rule_id").distinct().crossJoin(F.broadcast(sizes)).join(hits, ["source", "rule_id"], "left").na.fill(0, ["tp", "fp"])  # rules by sources

    def intervals(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("source")
        found = cluster_bootstrap(list(zip(g["pos"], g["tp"], g["neg"], g["fp"], strict=True)), 42)
        row = [x for k in ("recall", "fpr") for x in found.get(k, (float("nan"), float("nan")))]
        return pd.DataFrame([[g["rule_id"].iloc[0], *row]], columns=["rule_id", "recall_low", "recall_high", "fpr_low", "fpr_high"])

    return rows.groupBy("rule_id").applyInPandas(intervals, "rule_id string, recall_low double, recall_high double, fpr_low double, fpr_high double")


QUERIES = {
    "naturalness": naturalness, "description_lengths": description_lengths, "composite_findings": composite_findings, "mined_rules": mined_rules, "ks_features": ks_features, "quality_reviews": quality_reviews, "calibration_status": calibration_status,
    "supported_rules": supported_rules, "line_windows": line_windows, "last_points": last_points, "sparklines": sparklines, "chronic_users": chronic_users, "flywheel": flywheel, "drift_score": drift_score, "canonical_sums": canonical_sums,
    "rule_intervals": rule_intervals,
}
ORACLES = {
    "naturalness": NATURAL_SQL, "description_lengths": LENGTHS_SQL, "composite_findings": COMPOSITES_SQL, "ks_features": FEATURES_SQL, "quality_reviews": REVIEW_SQL, "calibration_status": STATUS_SQL, "supported_rules": SUPPORT_SQL,
    "line_windows": WINDOW_SQL, "last_points": POINTS_SQL, "sparklines": SPARK_SQL, "chronic_users": CHRONIC_SQL, "flywheel": FLYWHEEL_SQL, "drift_score": DRIFT_SCORE_SQL, "canonical_sums": SUMS_SQL,
}
