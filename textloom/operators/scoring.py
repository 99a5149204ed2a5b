"""Scores and gates over findings, and calibration of rules against labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import rules
from textloom.plans.components import kept
from textloom.sources.tables import table, units

#: Weights of severities, and of the axes of the two composite scores.
WEIGHTS = {"low": 1, "medium": 3, "high": 5}
HEADLINE = {"slop": 0.4, "hygiene": 0.3, "security": 0.2, "test": 0.1}
SLOP = {"boundary": 0.40, "context": 0.35, "visual": 0.25}
#: The bucket of each rule that isn't in the visual one.
BUCKETS = {
    "boundary": ("logic/boundary-violation", "component/giant-component", "component/multiple-components-per-file"),
    "context": (
        "component/shadcn-prop-mismatch", "context/import-path-mismatch", "logic/key-prop-missing", "logic/optimistic-no-rollback", "logic/ghost-defensive", "logic/reactive-hook-soup", "logic/zombie-state",
        "logic/math-any-density", "logic/math-console-log-storm", "logic/math-variable-name-entropy", "logic/math-gini-class-usage",
    ),
}
HYGIENE = ("arch", "logic", "layout", "visual", "component", "test")


def weight(severity: Column) -> Column:
    w = F.lit(0)
    for name, value in WEIGHTS.items():
        w = F.when(severity == name, F.lit(value)).otherwise(w)
    return w


def burden(points: Column, scale: float) -> Column:
    return F.least(F.lit(100.0), F.log10(1 + points / scale) / F.log10(F.lit(11.0)) * 100)


def bucket(rule_id: Column) -> Column:
    return F.when(rule_id.isin(*BUCKETS["boundary"]), "boundary").when(rule_id.isin(*BUCKETS["context"]), "context").otherwise("visual")


def file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted findings of each document, at most 100."""
    f = rules.findings(spark, folder)
    return f.groupBy("doc_id").agg(F.least(F.lit(100), F.sum(weight(F.col("severity")))).cast("long").alias("score"), F.count("*").alias("n_findings"))


_W = "CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END"
FILE_SQL = f"WITH f AS ({rules.FINDINGS_SQL}) SELECT doc_id, least(100, sum({_W}))::BIGINT AS score, count(*) AS n_findings FROM f GROUP BY 1"


def score_p90(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank ninetieth percentile, peak and mean of scores over all documents; those without findings score 0."""
    s = table(spark, folder, "documents").select("doc_id").join(file_scores(spark, folder), "doc_id", "left").select(F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    return s.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY score)").cast("long").alias("p90"), F.max("score").alias("peak"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


P90_SQL = f"WITH s AS ({FILE_SQL}), d AS (SELECT coalesce(score, 0) AS score FROM documents LEFT JOIN s USING (doc_id)) SELECT quantile_disc(score, 0.9)::BIGINT AS p90, max(score) AS peak, round(avg(score), 6) AS mean, count(*) AS n FROM d"


def bucket_burden(spark: SparkSession, folder: str) -> DataFrame:
    """Logarithmic burden of each document's AI-specific findings by bucket."""
    f = rules.findings(spark, folder).where(F.coalesce("ai_specific", F.lit(True))).withColumn("bucket", bucket(F.col("rule_id")))
    g = f.groupBy("doc_id", "bucket").agg(F.sum(weight(F.col("severity"))).alias("points"))
    return g.select("doc_id", "bucket", F.col("points").cast("long").alias("points"), F.round(burden(F.col("points"), 1.0), 4).alias("burden"))


_IN = {k: ", ".join(f"'{r}'" for r in v) for k, v in BUCKETS.items()}
_B = f"CASE WHEN rule_id IN ({_IN['boundary']}) THEN 'boundary' WHEN rule_id IN ({_IN['context']}) THEN 'context' ELSE 'visual' END"
BUCKET_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}), g AS (SELECT doc_id, {_B} AS bucket, sum({_W})::BIGINT AS points FROM f WHERE ai_specific GROUP BY 1, 2)
SELECT doc_id, bucket, points, round(least(100.0, log10(1 + points) / log10(11.0) * 100), 4) AS burden FROM g"""


def headline_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus's four axes and their mean: slop, hygiene, security, test."""
    return health(rules.findings(spark, folder))


def health(found: DataFrame) -> DataFrame:
    """One row: slop, hygiene, security, test and health of findings."""
    f = found.withColumn("bucket", bucket(F.col("rule_id"))).groupBy("bucket", "category", "ai_specific").agg(F.sum(weight(F.col("severity"))).alias("w"), F.count("*").alias("n"))

    def total(test: Column, what: str = "w") -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(what))), F.lit(0))

    slop = sum((F.lit(v) * burden(total(F.coalesce("ai_specific", F.lit(True)) & (F.col("bucket") == k)), 1000.0) for k, v in SLOP.items()), F.lit(0.0))
    hygiene = 100 - sum((burden(total(F.col("category") == c), 500.0) for c in HYGIENE), F.lit(0.0)) / len(HYGIENE)
    security = 100 / (1 + total(F.col("category") == "security", "n") / 5)
    test = F.greatest(F.lit(0.0), 100 - F.ceil(total(F.col("category") == "test") / 5))
    one = f.agg(slop.alias("slop"), hygiene.alias("hygiene"), security.alias("security"), test.cast("double").alias("test"))
    health = HEADLINE["slop"] * (100 - F.col("slop")) + HEADLINE["hygiene"] * F.col("hygiene") + HEADLINE["security"] * F.col("security") + HEADLINE["test"] * F.col("test")
    return one.select(*[F.round(k, 4).alias(k) for k in ("slop", "hygiene", "security", "test")], F.round(health, 4).alias("health"))


def _hl(points: str, scale: float) -> str:
    return f"least(100.0, log10(1 + coalesce({points}, 0) / {scale}) / log10(11.0) * 100)"


HEADLINE_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}), g AS (SELECT {' + '.join(f"{v} * " + _hl(f"sum({_W}) FILTER (WHERE ai_specific AND {_B} = '{k}')", 1000.0) for k, v in SLOP.items())} AS slop,
100 - ({' + '.join(_hl(f"sum({_W}) FILTER (WHERE category = '{c}')", 500.0) for c in HYGIENE)}) / 6 AS hygiene, 100 / (1 + count(*) FILTER (WHERE category = 'security') / 5) AS security,
greatest(0.0, 100 - ceil(coalesce(sum({_W}) FILTER (WHERE category = 'test'), 0) / 5))::DOUBLE AS test FROM f)
SELECT round(slop, 4) AS slop, round(hygiene, 4) AS hygiene, round(security, 4) AS security, round(test, 4) AS test, round(0.4 * (100 - slop) + 0.3 * hygiene + 0.2 * security + 0.1 * test, 4) AS health FROM g"""


def gates(spark: SparkSession, folder: str, max_slop: float = 60.0, min_health: float = 50.0, max_high: int = 100) -> DataFrame:
    """One row: which gates fail."""
    found = rules.kept_findings(spark, folder)
    high = found.agg(F.coalesce(F.sum((F.col("severity") == "high").cast("long")), F.lit(0)).alias("high"))
    one = health(found).crossJoin(high)  # a row each
    failed = F.array_compact(F.array(F.when(F.col("slop") > max_slop, F.lit("max-slop")), F.when(F.col("health") < min_health, F.lit("min-health")), F.when(F.col("high") > max_high, F.lit("max-high"))))
    return one.select("slop", "health", "high", F.array_join(failed, ",").alias("failed"))


GATES_SQL = f"""WITH h AS ({HEADLINE_SQL}), f AS ({rules.FINDINGS_SQL}), n AS (SELECT count(*) FILTER (WHERE severity = 'high') AS high FROM f)
SELECT slop, health, high, array_to_string(list_filter([CASE WHEN slop > 60 THEN 'max-slop' END, CASE WHEN health < 50 THEN 'min-health' END, CASE WHEN high > 100 THEN 'max-high' END], lambda x: x IS NOT NULL), ',') AS failed FROM h, n"""

#: Normal quantile of the calibration's intervals.
Z = 1.959963984540054


def wilson(k: Column, n: Column, sign: int) -> Column:
    p = k / n
    middle = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle + sign * half) / (1 + Z * Z / n))))


def _fires(spark: SparkSession, folder: str, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled documents (doc_id, positive: quality 0, lang, source), and the rules that fire (doc_id, rule_id), of findings if they are given."""
    labels = table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("positive"))
    labelled = labels.join(units(spark, folder).select("doc_id", "lang", "source"), "doc_id")
    fired = (rules.findings(spark, folder) if found is None else found).select("doc_id", "rule_id").distinct()
    return labelled, fired


def rule_confusion(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """Recall, false positive rate with Wilson intervals, smoothed likelihood ratio and verdict of each rule over the labelled documents."""
    labelled, fired = _fires(spark, folder, found)
    arms = labelled.agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    c = labelled.join(fired, "doc_id").groupBy("rule_id").agg(F.sum(F.col("positive").cast("long")).alias("tp"), F.sum((~F.col("positive")).cast("long")).alias("fp"))
    c = c.crossJoin(F.broadcast(arms))  # one row
    recall, fpr = F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg")
    ratio = ((F.col("tp") + 0.5) / (F.col("pos") + 1)) / ((F.col("fp") + 0.5) / (F.col("neg") + 1))
    verdict = F.when(F.col("tp") + F.col("fp") < 5, "DORMANT").when(ratio >= 1.5, "USEFUL").when(ratio >= 1.2, "OK").when(ratio > 0.8, "NEUTRAL").otherwise("INVERTED")
    return c.select(
        "rule_id", "tp", "fp", F.round(recall, 6).alias("recall"), F.round(fpr, 6).alias("fpr"), F.round(wilson(F.col("tp"), F.col("pos"), -1), 6).alias("recall_low"),
        F.round(wilson(F.col("tp"), F.col("pos"), 1), 6).alias("recall_high"), F.round(ratio, 6).alias("lr"), verdict.alias("verdict"),
    )


_L = "l AS (SELECT doc_id, quality = 0 AS positive, lang, source FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"
CONFUSION_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}), {_L}, a AS (SELECT count(*) FILTER (WHERE positive) AS pos, count(*) FILTER (WHERE NOT positive) AS neg FROM l),
c AS (SELECT rule_id, count(*) FILTER (WHERE positive) AS tp, count(*) FILTER (WHERE NOT positive) AS fp FROM l JOIN (SELECT DISTINCT doc_id, rule_id FROM f) USING (doc_id) GROUP BY 1),
x AS (SELECT *, tp / pos AS p, ((tp + 0.5) / (pos + 1)) / ((fp + 0.5) / (neg + 1)) AS lr, {Z} AS z FROM c, a)
SELECT rule_id, tp, fp, round(p, 6) AS recall, round(fp / neg, 6) AS fpr, round(greatest(0.0, least(1.0, (p + z * z / (2 * pos) - z * sqrt(p * (1 - p) / pos + z * z / (4 * pos * pos))) / (1 + z * z / pos))), 6) AS recall_low,
round(greatest(0.0, least(1.0, (p + z * z / (2 * pos) + z * sqrt(p * (1 - p) / pos + z * z / (4 * pos * pos))) / (1 + z * z / pos))), 6) AS recall_high, round(lr, 6) AS lr,
CASE WHEN tp + fp < 5 THEN 'DORMANT' WHEN lr >= 1.5 THEN 'USEFUL' WHEN lr >= 1.2 THEN 'OK' WHEN lr > 0.8 THEN 'NEUTRAL' ELSE 'INVERTED' END AS verdict FROM x"""


def macro_rates(by: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Each rule's mean over groups of the positive documents' recall."""
        labelled, fired = _fires(spark, folder)
        sizes = labelled.where("positive").groupBy(by).agg(F.count("*").alias("n"))
        hits = labelled.where("positive").join(fired, "doc_id").groupBy(by, "rule_id").agg(F.count("*").alias("k"))
        groups = sizes.agg(F.count("*").alias("groups"))
        g = hits.join(sizes, by).groupBy("rule_id").agg(F.sum(F.col("k") / F.col("n")).alias("s")).crossJoin(F.broadcast(groups))
        return g.select("rule_id", F.round(F.col("s") / F.col("groups"), 6).alias("macro_recall"), "groups")

    return query


def macro_sql(by: str) -> str:
    return f"""WITH f AS ({rules.FINDINGS_SQL}), {_L}, s AS (SELECT {by}, count(*) AS n FROM l WHERE positive GROUP BY 1),
h AS (SELECT {by}, rule_id, count(*) AS k FROM l JOIN (SELECT DISTINCT doc_id, rule_id FROM f) USING (doc_id) WHERE positive GROUP BY 1, 2)
SELECT rule_id, round(sum(k / n) / (SELECT count(*) FROM s), 6) AS macro_recall, (SELECT count(*) FROM s) AS groups FROM h JOIN s USING ({by}) GROUP BY 1"""


def rule_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised pointwise mutual information of rules that fire on one document. Pairs are of rules, of which a document has few."""
    fired = kept(rules.findings(spark, folder).select("doc_id", "rule_id").distinct())
    n = table(spark, folder, "documents").agg(F.count("*").alias("n"))
    support = fired.groupBy("rule_id").agg(F.count("*").alias("k"))
    sets = fired.groupBy("doc_id").agg(F.sort_array(F.collect_list("rule_id")).alias("r"))
    pairs = sets.select(F.explode(F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
    j = both.join(F.broadcast(support.select(F.col("rule_id").alias("a"), F.col("k").alias("ka"))), "a").join(F.broadcast(support.select(F.col("rule_id").alias("b"), F.col("k").alias("kb"))), "b").crossJoin(F.broadcast(n))
    p = F.col("both") / F.col("n")
    npmi = F.when(p == 1, F.lit(1.0)).otherwise(F.ln(p / ((F.col("ka") / F.col("n")) * (F.col("kb") / F.col("n")))) / -F.ln(p))
    return j.select("a", "b", "both", "ka", "kb", F.round(npmi, 6).alias("npmi"))


NPMI_SQL = f"""WITH f AS (SELECT DISTINCT doc_id, rule_id FROM ({rules.FINDINGS_SQL})), n AS (SELECT count(*) AS n FROM documents), k AS (SELECT rule_id, count(*) AS k FROM f GROUP BY 1),
p AS (SELECT x.rule_id AS a, y.rule_id AS b, count(*) AS both FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.rule_id < y.rule_id GROUP BY 1, 2)
SELECT a, b, p.both AS "both", ka.k AS ka, kb.k AS kb, round(CASE WHEN p.both = n THEN 1.0 ELSE ln((p.both / n) / ((ka.k / n) * (kb.k / n))) / -ln(p.both / n) END, 6) AS npmi FROM p JOIN k ka ON ka.rule_id = a JOIN k kb ON kb.rule_id = b, n"""


def composite_probability(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of each document with findings: prior 0.3 and the rules' positive log likelihood ratios (13.8 at most)."""
    found = rules.kept_findings(spark, folder)
    llr = rule_confusion(spark, folder, found).where("lr > 1 AND verdict IN ('USEFUL', 'OK')").select("rule_id", F.least(F.lit(13.8), F.ln("lr")).alias("llr"))
    fired = found.select("doc_id", "rule_id").distinct().join(F.broadcast(llr), "rule_id", "left")  # a row for each rule
    g = fired.groupBy("doc_id").agg(F.sum(F.coalesce("llr", F.lit(0.0))).alias("s"), F.count("llr").alias("rules"))
    logit = F.lit(0.3 / 0.7)
    return g.select("doc_id", "rules", F.round(1 / (1 + F.exp(-(F.ln(logit) + F.col("s")))), 5).alias("probability"))


COMPOSITE_SQL = f"""WITH r AS (SELECT rule_id, least(13.8, ln(lr)) AS llr FROM ({CONFUSION_SQL}) WHERE lr > 1 AND verdict IN ('USEFUL', 'OK')), f AS (SELECT DISTINCT doc_id, rule_id FROM ({rules.FINDINGS_SQL}))
SELECT doc_id, count(llr) AS rules, round(1 / (1 + exp(-(ln(0.3 / 0.7) + sum(coalesce(llr, 0))))), 5) AS probability FROM f LEFT JOIN r USING (rule_id) GROUP BY 1"""


def stratified_sample(spark: SparkSession, folder: str, per_stratum: int = 5) -> DataFrame:
    """The first documents of each stratum (language, power of two of the size) by a hash of the id: a sample, so limited by its nature."""
    d = units(spark, folder).select("doc_id", "lang", F.floor(F.log2(F.greatest(F.lit(1), F.octet_length("text")))).cast("long").alias("size_class"), F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256).alias("k"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "size_class").orderBy("k"))).where(F.col("rank") <= per_stratum).select("doc_id", "lang", "size_class", "rank")


SAMPLE_SQL = """WITH d AS (SELECT doc_id, lang, floor(log2(greatest(1, strlen(text))))::BIGINT AS size_class, sha256('42:' || doc_id) AS k FROM documents)
SELECT doc_id, lang, size_class, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, size_class ORDER BY k) AS rank FROM d) WHERE rank <= 5"""

QUERIES = {
    "file_scores": file_scores, "score_p90": score_p90, "bucket_burden": bucket_burden, "headline_scores": headline_scores, "gates": gates, "rule_confusion": rule_confusion,
    "macro_by_lang": macro_rates("lang"), "macro_by_source": macro_rates("source"), "rule_cooccurrence": rule_cooccurrence, "composite_probability": composite_probability, "stratified_sample": stratified_sample,
}
ORACLES = {
    "file_scores": FILE_SQL, "score_p90": P90_SQL, "bucket_burden": BUCKET_SQL, "headline_scores": HEADLINE_SQL, "gates": GATES_SQL, "rule_confusion": CONFUSION_SQL,
    "macro_by_lang": macro_sql("lang"), "macro_by_source": macro_sql("source"), "rule_cooccurrence": NPMI_SQL, "composite_probability": COMPOSITE_SQL, "stratified_sample": SAMPLE_SQL,
}
