"""What becomes of findings: rule selection, overrides, policy, filters, directives, identities and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import rules, scoring
from textloom.operators.catalog import catalog, catalog_sql
from textloom.sources.tables import table

#: Verdicts whose rules are off by default, buckets of verdicts, the next lower severity.
OFF_VERDICTS = ("NOISY", "INVERTED", "DORMANT")
LOWER = {"high": "medium", "medium": "low", "low": "off", "off": "off", "auto": "low"}
TEST_FILE = r"(^|/)__tests__/|(^|/)__fixtures__/|\.(test|spec|stories)\.[jt]sx?$"
UI_FILE = r"(?i)\.(tsx|jsx|vue|svelte|astro|html|htm|css|scss|less|sass|md|mdx)$"
#: Kinds of context in the order in which they are tried, with what a lower-cased path has.
CONTEXTS = (
    ("test-fixture", r"(^|/)(tests|test|__tests__|fixtures|fixture)(/|$)|\.(test|spec)\.[a-z0-9]+$"),
    ("generated-schema", r"(^|/)(generated|schemas|schema|dist|build|\.astro)(/|$)|(^|/)(builtins|product-facts|version)\.[a-z0-9]+$"),
    ("rule-implementation", r"(^|/)(rules|rule|snippet|snippets)(/|$)|signal-strength"),
    ("documentation-example", r"(^|/)(docs|doc|examples|example)(/|$)|(^|/)(readme|changelog)(\.|$)"),
    ("demo-marketing", r"(^|/)(website|marketing|demo|demos)(/|$)"),
)


def default_off(flag: Column, verdict: Column) -> Column:
    """The explicit flag, or what the verdict says where there is none."""
    return F.coalesce(flag, verdict.isin(*OFF_VERDICTS))


def reliable(precision: Column, recall: Column) -> Column:
    """Whether a rule's evidence is good enough; without evidence it is."""
    return F.coalesce((precision >= 0.5) & (recall >= 0.1), F.lit(True))


def lower(severity: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in LOWER.items():
        out = F.when(severity == a, b).otherwise(out)
    return out


def bucket_of(verdict: Column, ai_specific: Column) -> Column:
    return F.when(verdict.isin("USEFUL", "OK"), F.when(ai_specific, "ai").otherwise("hygiene")).when(verdict.isin("HYGIENE", "INVERTED"), "hygiene").otherwise("suppressed")


def context_of(path: Column) -> Column:
    out = F.lit("application")
    for name, pattern in reversed(CONTEXTS):
        out = F.when(F.lower(F.translate(path, "\\", "/")).rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(path, F.lit("")) == "", "project-wide").otherwise(out)


def select_rules(known: DataFrame, only: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, kind: str = "all") -> DataFrame:
    """Rows of a catalog that are asked for: those of only or include if given, none of exclude, and of kind ai or human those that are."""
    if only:
        known = known.where(F.col("rule_id").isin(*only))
    if include:
        known = known.where(F.col("rule_id").isin(*include))
    if exclude:
        known = known.where(~F.col("rule_id").isin(*exclude))
    return known if kind == "all" else known.where(F.col("ai_specific") == (kind == "ai"))


def rule_policy(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog with what its rows mean, and, from the labelled documents, which rules' evidence is poor and what severity they fall to."""
    signals = scoring.rule_confusion(spark, folder).select("rule_id", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), "recall")
    j = catalog(spark).join(signals, "rule_id", "left")
    good = reliable(F.col("precision"), F.col("recall"))
    return j.select(
        "rule_id", "severity", default_off(F.when(F.col("default_off"), F.lit(True)), F.col("verdict")).alias("off"), (F.col("policy") == "on").alias("scores"), bucket_of(F.col("verdict"), F.col("ai_specific")).alias("bucket"),
        "precision", good.alias("reliable"), F.when(good, F.col("severity")).otherwise(lower(F.col("severity"))).alias("tuned"),
    )


POLICY_SQL = f"""WITH c AS ({catalog_sql()}), s AS (SELECT rule_id, round(tp / (tp + fp), 6) AS precision, recall FROM ({scoring.CONFUSION_SQL})),
j AS (SELECT *, coalesce(precision >= 0.5 AND recall >= 0.1, true) AS reliable FROM c LEFT JOIN s USING (rule_id))
SELECT rule_id, severity, default_off OR verdict IN ('NOISY', 'INVERTED', 'DORMANT') AS off, policy = 'on' AS scores,
CASE WHEN verdict IN ('USEFUL', 'OK') THEN CASE WHEN ai_specific THEN 'ai' ELSE 'hygiene' END WHEN verdict IN ('HYGIENE', 'INVERTED') THEN 'hygiene' ELSE 'suppressed' END AS bucket, precision, reliable,
CASE WHEN reliable THEN severity ELSE CASE severity WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'off' END END AS tuned FROM j"""


def selected_rules(spark: SparkSession, folder: str) -> DataFrame:
    """How many rules each of some selections has."""
    known = catalog(spark)
    asked = {
        "all": {}, "ai": {"kind": "ai"}, "human": {"kind": "human"}, "only": {"only": ["security/eval", "dead/unreachable", "none/such"]}, "not": {"exclude": ["security/eval"]},
        "ai of some": {"include": ["security/eval", "ai/any-density", "ai/renyi-profile"], "kind": "ai"},
    }
    out = None
    for name, how in asked.items():
        one = select_rules(known, **how).agg(F.count("*").alias("rules"), F.min("rule_id").alias("first")).select(F.lit(name).alias("selection"), "rules", "first")
        out = one if out is None else out.unionByName(one)
    return out


SELECTED_SQL = f"""WITH c AS ({catalog_sql()}) SELECT 'all' AS selection, count(*) AS rules, min(rule_id) AS first FROM c UNION ALL SELECT 'ai', count(*), min(rule_id) FROM c WHERE ai_specific UNION ALL SELECT 'human', count(*), min(rule_id) FROM c WHERE NOT ai_specific
UNION ALL SELECT 'only', count(*), min(rule_id) FROM c WHERE rule_id IN ('security/eval', 'dead/unreachable', 'none/such') UNION ALL SELECT 'not', count(*), min(rule_id) FROM c WHERE rule_id <> 'security/eval'
UNION ALL SELECT 'ai of some', count(*), min(rule_id) FROM c WHERE rule_id IN ('security/eval', 'ai/any-density', 'ai/renyi-profile') AND ai_specific"""

#: Severities that a configuration gives to rules, for the queries.
OVERRIDES = (("logic/zipf-slope-anomaly", "off"), ("ai/renyi-profile", "high"), ("security/hardcoded-secret", "auto"), ("ai/whitespace-regularity", "low"))


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """findings with the severities that overrides (rule_id, override) give; auto leaves them, off removes the finding."""
    j = findings.join(F.broadcast(overrides), "rule_id", "left").where(F.coalesce("override", F.lit("")) != "off")  # a row for each rule
    return j.withColumn("severity", F.when(F.coalesce("override", F.lit("auto")) == "auto", F.col("severity")).otherwise(F.col("override"))).drop("override")


def effective(findings: DataFrame, known: DataFrame) -> DataFrame:
    """findings of rules that the policy of a catalog lets score; rules that it doesn't know do."""
    return findings.join(F.broadcast(known.select("rule_id", "policy")), "rule_id", "left").where(F.coalesce("policy", F.lit("on")) == "on").drop("policy")


def effective_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by rule after overrides, all and those that score."""
    found = overridden(rules.findings(spark, folder), spark.createDataFrame(list(OVERRIDES), "rule_id string, override string"))
    j = found.join(F.broadcast(catalog(spark).select("rule_id", "policy")), "rule_id", "left")
    g = j.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.sum((F.coalesce("policy", F.lit("on")) == "on").cast("long")).alias("scoring"))
    return g


_OVER = "o AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in OVERRIDES) + ") AS t(rule_id, override))"
_FOUND = f"f AS ({rules.FINDINGS_SQL}), c AS ({catalog_sql()}), {_OVER}, x AS (SELECT f.* EXCLUDE (severity), CASE WHEN coalesce(override, 'auto') = 'auto' THEN f.severity ELSE override END AS severity FROM f LEFT JOIN o USING (rule_id) WHERE coalesce(override, '') <> 'off')"
EFFECTIVE_SQL = f"WITH {_FOUND} SELECT x.rule_id, x.severity, count(*) AS n, count(*) FILTER (WHERE coalesce(policy, 'on') = 'on') AS scoring FROM x LEFT JOIN c ON c.rule_id = x.rule_id GROUP BY 1, 2"


def filtered(findings: DataFrame, ai_only: bool = False, human_only: bool = False, no_wcag: bool = False, rule: str | None = None, security_only: bool = False) -> DataFrame:
    test = F.lit(True)
    if ai_only:
        test = test & F.coalesce("ai_specific", F.lit(False))
    if human_only:
        test = test & ~F.coalesce("ai_specific", F.lit(False))
    if no_wcag:
        test = test & (F.col("category") != "wcag")
    if rule:
        test = test & (F.col("rule_id") == rule)
    if security_only:
        test = test & ((F.col("category") == "security") | F.col("rule_id").startswith("security/"))
    return findings.where(test)


def finding_filters(spark: SparkSession, folder: str) -> DataFrame:
    """How many findings each filter leaves."""
    found = rules.kept_findings(spark, folder)
    out = None
    for name, how in (("ai", {"ai_only": True}), ("human", {"human_only": True}), ("rule", {"rule": "logic/heaps-deviation"}), ("security", {"security_only": True}), ("human, no wcag", {"human_only": True, "no_wcag": True})):
        one = filtered(found, **how).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).select(F.lit(name).alias("filter"), "n", "docs")
        out = one if out is None else out.unionByName(one)
    return out


FILTERS_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}) SELECT 'ai' AS filter, count(*) AS n, count(DISTINCT doc_id) AS docs FROM f WHERE ai_specific UNION ALL SELECT 'human', count(*), count(DISTINCT doc_id) FROM f WHERE NOT ai_specific
UNION ALL SELECT 'rule', count(*), count(DISTINCT doc_id) FROM f WHERE rule_id = 'logic/heaps-deviation' UNION ALL SELECT 'security', count(*), count(DISTINCT doc_id) FROM f WHERE category = 'security' OR rule_id LIKE 'security/%'
UNION ALL SELECT 'human, no wcag', count(*), count(DISTINCT doc_id) FROM f WHERE NOT ai_specific AND category <> 'wcag'"""


def undisabled(findings: DataFrame, directives: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings that no directive (key, rule_id, scope, at) hides: one for a line or the next line at its line, one for a block from its line on."""
    f, d = findings.alias("f"), directives.alias("d")
    hides = (F.col(f"f.{key}") == F.col(f"d.{key}")) & (F.col("f.rule_id") == F.col("d.rule_id")) & F.when(F.col("d.scope") == "block", F.col("f.line") >= F.col("d.at")).otherwise(F.col("f.line") == F.col("d.at"))
    return f.join(d, hides, "left_anti")


def disabled_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings left by rule, if documents in turn hide growth of vocabulary at line 1, secrets from line 2 on, or brackets at line 3."""
    kinds = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("scope"), F.lit(k).alias("at")) for r, s, k in (("logic/heaps-deviation", "line", 1), ("security/hardcoded-secret", "block", 2), ("ai/errors-near-eof", "next-line", 3))])
    directives = table(spark, folder, "documents").select("doc_id", F.get(kinds, F.pmod("doc_id", F.lit(3)).cast("int")).alias("x")).select("doc_id", "x.*")
    return undisabled(rules.findings(spark, folder), directives).groupBy("rule_id").agg(F.count("*").alias("n"))


DISABLED_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}) SELECT rule_id, count(*) AS n FROM f WHERE NOT (doc_id % 3 = 0 AND rule_id = 'logic/heaps-deviation' AND line = 1) AND NOT (doc_id % 3 = 1 AND rule_id = 'security/hardcoded-secret' AND line >= 2)
AND NOT (doc_id % 3 = 2 AND rule_id = 'ai/errors-near-eof' AND line = 3) GROUP BY 1"""


def page_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """What each page's path says: its context, whether it is a UI file or a test file."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/?([^?#]*)", 1)
    return table(spark, folder, "pages").select("page_id", context_of(path).alias("context"), F.coalesce(path.rlike(UI_FILE), F.lit(False)).alias("ui"), F.coalesce(path.rlike(TEST_FILE), F.lit(False)).alias("test"))


_CASES = " ".join(f"WHEN regexp_matches(lower(replace(p, '\\', '/')), '{pattern}') THEN '{name}'" for name, pattern in CONTEXTS)
CONTEXT_SQL = rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/?([^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN coalesce(p, '') = '' THEN 'project-wide' {_CASES} ELSE 'application' END AS context, coalesce(regexp_matches(p, '{UI_FILE}'), false) AS ui, coalesce(regexp_matches(p, '{TEST_FILE}'), false) AS test FROM p"""


def identity(path: Column) -> Column:
    """A finding's identity: the digest of its canonical JSON. Needs rule_id, category, line and message."""
    return F.sha2(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "category", path.alias("filePath"), "line", F.lit(1).alias("column"), "message")), 256)


def identities(found: DataFrame) -> DataFrame:
    named = found.withColumn("message", F.concat("rule_id", F.lit(" x"), F.col("n").cast("string")))
    return named.select("doc_id", "rule_id", identity(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("identity"))


def finding_identities(spark: SparkSession, folder: str) -> DataFrame:
    return identities(rules.findings(spark, folder))


IDENTITY_SQL = f"""WITH f AS ({rules.FINDINGS_SQL}) SELECT doc_id, rule_id, sha256('{{"ruleId":"' || rule_id || '","category":"' || category || '","filePath":"' || doc_id || '.txt","line":' || line || ',"column":1,"message":"' || rule_id || ' x' || n || '"}}') AS identity FROM f"""


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(identity, change): new, unchanged or resolved, of two tables with identities."""
    a, b = current.select("identity").distinct().withColumn("now", F.lit(True)), baseline.select("identity").distinct().withColumn("then", F.lit(True))
    return a.join(b, "identity", "full").select("identity", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged").alias("change"))


def _baseline(found: DataFrame, docs: DataFrame) -> DataFrame:
    """For the queries: what was known of four fifths of the documents, and of every seventh a finding that has gone."""
    return identities(found.where(F.col("doc_id") % 5 != 0)).select("identity").unionByName(docs.where(F.col("doc_id") % 7 == 0).select(F.sha2(F.concat(F.lit("gone:"), F.col("doc_id").cast("string")), 256).alias("identity")))


def finding_delta(spark: SparkSession, folder: str) -> DataFrame:
    """How many findings are new, unchanged or resolved against a baseline."""
    found = rules.kept_findings(spark, folder)
    return compared(identities(found), _baseline(found, table(spark, folder, "documents"))).groupBy("change").agg(F.count("*").alias("n"))


_DELTA = f"""c AS ({IDENTITY_SQL}), b AS (SELECT identity FROM c WHERE doc_id % 5 <> 0 UNION ALL SELECT sha256('gone:' || doc_id) FROM documents WHERE doc_id % 7 = 0),
d AS (SELECT CASE WHEN b.identity IS NULL THEN 'new' WHEN c.identity IS NULL THEN 'resolved' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT identity FROM c) c FULL JOIN (SELECT DISTINCT identity FROM b) b ON c.identity = b.identity)"""
DELTA_SQL = f"WITH {_DELTA} SELECT change, count(*) AS n FROM d GROUP BY 1"


def new_debt(delta: DataFrame, allowed: int, baseline: str | None = "a", config: str = "a") -> DataFrame:
    """One row: whether more findings are new than allowed; without a baseline, or with another configuration's, it isn't told (new is -1), and fails."""
    if baseline is None or baseline != config:
        return delta.agg(F.lit(-1).cast("long").alias("new")).select("new", F.lit("not-evaluated").alias("status"), F.lit(True).alias("failed"))
    one = delta.agg(F.coalesce(F.sum(F.when(F.col("change") == "new", F.col("n"))), F.lit(0)).alias("new"))
    return one.select("new", F.when(F.col("new") > allowed, "failed").otherwise("passed").alias("status"), (F.col("new") > allowed).alias("failed"))


def new_debt_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate for some limits, and where it can't be told."""
    from textloom.plans.components import kept

    d = kept(finding_delta(spark, folder))
    asked = (("none allowed", 0, "a", "a"), ("a million allowed", 10**6, "a", "a"), ("no baseline", 0, None, "a"), ("other configuration", 0, "b", "a"))
    out = None
    for name, allowed, baseline, config in asked:
        one = new_debt(d, allowed, baseline, config).select(F.lit(name).alias("gate"), "new", "status", "failed")
        out = one if out is None else out.unionByName(one)
    return out


DEBT_SQL = f"""WITH {_DELTA}, n AS (SELECT count(*) FILTER (WHERE change = 'new') AS n FROM d) SELECT 'none allowed' AS gate, n AS new, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, n > 0 AS failed FROM n
UNION ALL SELECT 'a million allowed', n, CASE WHEN n > 1000000 THEN 'failed' ELSE 'passed' END, n > 1000000 FROM n UNION ALL SELECT 'no baseline', -1, 'not-evaluated', true UNION ALL SELECT 'other configuration', -1, 'not-evaluated', true"""


def select_corpus(files: DataFrame, seed: str, per_stratum: int) -> DataFrame:
    """Adds selection_key and reason (null: selected) to files (file_id, label, tier, split, language, stratum): the first test that a file fails, and a
    quota for each label, language and stratum, by the digests of seed and file."""
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col("file_id").cast("string")), 256)
    why = F.when(~F.coalesce(F.col("label").isin("verified_ai", "verified_human"), F.lit(False)), "label_not_eligible").when(F.col("tier") != "gold", "tier_not_gold").when(F.col("split") == "excluded", "split_excluded").when(F.col("stratum") < 6, "stratum_not_eligible")
    f = files.withColumn("selection_key", key).withColumn("reason", why)
    rank = F.row_number().over(Window.partitionBy("label", "language", "stratum", F.col("reason").isNull()).orderBy("selection_key", "file_id"))
    return f.withColumn("rank", rank).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("rank") > per_stratum), "stratum_quota_reached").otherwise(F.col("reason"))).drop("rank")


def corpus_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents a corpus takes, and why not the others."""
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    files = d.select(
        F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 0, "verified_ai").when(F.col("quality") == 1, "verified_human").otherwise("unknown").alias("label"),
        F.when(F.col("toxic") == 0, "gold").otherwise("silver").alias("tier"), F.when(F.coalesce("source", F.lit("")).rlike("[05]$"), "excluded").otherwise("train").alias("split"),
        F.col("lang").alias("language"), F.floor(F.log2(F.greatest(F.lit(1), F.octet_length(F.coalesce("text", F.lit("")))))).cast("long").alias("stratum"),
    )
    return select_corpus(files, "s", 2).select("file_id", "label", "stratum", "reason")


CORPUS_SQL = """WITH f AS (SELECT doc_id AS file_id, CASE WHEN quality = 0 THEN 'verified_ai' WHEN quality = 1 THEN 'verified_human' ELSE 'unknown' END AS label, CASE WHEN toxic = 0 THEN 'gold' ELSE 'silver' END AS tier,
CASE WHEN regexp_matches(coalesce(source, ''), '[05]$') THEN 'excluded' ELSE 'train' END AS split, lang AS language, floor(log2(greatest(1, strlen(coalesce(text, '')))))::BIGINT AS stratum, sha256('s:' || doc_id) AS k FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN label = 'unknown' THEN 'label_not_eligible' WHEN tier <> 'gold' THEN 'tier_not_gold' WHEN split = 'excluded' THEN 'split_excluded' WHEN stratum < 6 THEN 'stratum_not_eligible' END AS reason FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY label, language, stratum, reason IS NULL ORDER BY k, file_id) AS n FROM r)
SELECT file_id, label, stratum, CASE WHEN reason IS NULL AND n > 2 THEN 'stratum_quota_reached' ELSE reason END AS reason FROM q"""


def label_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that documents of both labels have."""
    d = table(spark, folder, "documents").where(F.col("text").isNotNull()).join(table(spark, folder, "labels").where("quality IS NOT NULL"), "doc_id")
    g = d.groupBy(F.sha2("text", 256).alias("content")).agg(F.countDistinct("quality").alias("labels"), F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    return g.where("labels > 1").select("first", "docs")


COLLISION_SQL = "SELECT min(doc_id) AS first, count(*) AS docs FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY sha256(text) HAVING count(DISTINCT quality) > 1"

QUERIES = {
    "rule_policy": rule_policy, "selected_rules": selected_rules, "effective_findings": effective_findings, "finding_filters": finding_filters, "disabled_findings": disabled_findings, "page_contexts": page_contexts,
    "finding_identities": finding_identities, "finding_delta": finding_delta, "new_debt_gate": new_debt_gate, "corpus_selection": corpus_selection, "label_collisions": label_collisions,
}
ORACLES = {
    "rule_policy": POLICY_SQL, "selected_rules": SELECTED_SQL, "effective_findings": EFFECTIVE_SQL, "finding_filters": FILTERS_SQL, "disabled_findings": DISABLED_SQL, "page_contexts": CONTEXT_SQL,
    "finding_identities": IDENTITY_SQL, "finding_delta": DELTA_SQL, "new_debt_gate": DEBT_SQL, "corpus_selection": CORPUS_SQL, "label_collisions": COLLISION_SQL,
}
