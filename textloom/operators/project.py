"""Scores of projects: from findings (project, path, rule_id, line, n, category, severity, ai_specific), files, facts and inventories of patterns.

The queries take the first folder of each literal unit's path for its project, so that every score has something to tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import rule_cases, scoring
from textloom.operators.catalog import catalog
from textloom.sources.tables import table, units

# Fixed values of the scores.
DOMAINS = {"codeHygiene": ("logic", "test", "typo", "visual", "layout"), "accessibility": ("wcag",), "performance": ("perf",), "security": ("security",)}
CATEGORIES = ("ai", "arch", "component", "context", "db", "dead", "docs", "dup", "layout", "logic", "perf", "security", "test", "typo", "visual", "wcag")
HEALTH_WEIGHTS = {"slopIndex": 0.20, "architectureConsistency": 0.20, "aiSecurityRisk": 0.20, "designTokenViolations": 0.10, "testQuality": 0.10, "businessLogicCoherence": 0.10, "docFreshness": 0.05, "dbHealth": 0.05}
RISK_HEALTH = {"low": 100, "medium": 75, "high": 40, "critical": 10}
COHERENCE = {"architecture": 0.50, "fragmentation": 0.30, "constitution": 0.10, "debt": 0.10}
DEBT_HEALTH = {"low": 95, "medium": 85, "high": 50, "critical": 25}
CONSTITUTION = ((0, 100), (1, 80), (3, 60), (5, 40), (10, 20), (20, 0))
COST_WEIGHTS = {"slop": 0.20, "architecture": 0.25, "security": 0.30, "constitution": 0.10, "tokens": 0.10, "high": 0.05}
COST_RISK = {"low": 100, "medium": 70, "high": 30, "critical": 0}
COST_ISSUE, COST_LINES, COST_AI = {"high": 400, "medium": 150, "low": 50}, 25.5, 1.8
COST_BUCKET = {"low": 0.5, "medium": 1.0, "high": 2.0, "critical": 4.0}
DOC_WEIGHTS = {"docs/stale-package-reference": 5, "docs/stale-function-reference": 3, "docs/broken-link": 2}
PATTERN_WEIGHTS = {"modal": 10, "auth": 8, "state": 6, "button": 4, "api": 4, "toast": 4, "card": 4, "forms": 3}
SUFFIXES = (
    "RepositoryClient ServiceFactory Repository Service Manager Handler Controller Helper Factory Provider Store Client API Util Repo Modal Dialog Drawer Sheet Panel Card List Form Page View Button Icon "
    "Submit Input Select Model Schema Entity Document Record"
).split()


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded, halves up."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def chosen(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))


def cases(spark: SparkSession) -> DataFrame:
    """Findings of the literal units by project."""
    rows = spark.createDataFrame([(p.split("/")[0], p, r, k) for p, r, k in rule_cases.expected()], "project string, path string, rule_id string, line int")
    return rows.join(F.broadcast(catalog(spark)), "rule_id")


def projects(spark: SparkSession) -> DataFrame:
    """Files and lines by project."""
    paths = {p: t for p, t, _ in rule_cases.UNITS}
    for rows in (rule_cases.ELEMENTS, rule_cases.COMPONENTS, rule_cases.BINDINGS, rule_cases.FACTS):
        paths |= {p: paths.get(p, "") for p, *_ in rows}
    paths |= {p: paths.get(p, "") for p, _, _ in rule_cases.MORE}
    files = spark.createDataFrame([(p.split("/")[0], p, t.count("\n") + 1) for p, t in sorted(paths.items())], "project string, path string, lines int")
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def _cases_sql() -> str:
    return f"f AS (SELECT split_part(path, '/', 1) AS project, t.* FROM ({rule_cases.RULE_SQL}) t)"


def _projects_sql() -> str:
    paths = {p: t for p, t, _ in rule_cases.UNITS}
    for rows in (rule_cases.ELEMENTS, rule_cases.COMPONENTS, rule_cases.BINDINGS, rule_cases.FACTS):
        paths |= {p: paths.get(p, "") for p, *_ in rows}
    paths |= {p: paths.get(p, "") for p, _, _ in rule_cases.MORE}
    values = ", ".join(f"('{p}', {t.count(chr(10)) + 1})" for p, t in sorted(paths.items()))
    return f"p AS (SELECT split_part(path, '/', 1) AS project, count(*) AS files, sum(lines)::BIGINT AS lines FROM (VALUES {values}) AS t(path, lines) GROUP BY 1)"


_W = "CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END"


def domain_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and score of each domain in each project."""
    of = F.lit(None).cast("string")
    for name, known in DOMAINS.items():
        of = F.when(F.col("category").isin(*known), name).otherwise(of)
    every = projects(spark).select("project", F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("domain"))
    n = cases(spark).withColumn("domain", of).groupBy("project", "domain").agg(F.count("*").alias("n"))
    j = every.join(n, ["project", "domain"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    plain = F.when(F.col("n") >= 25, 0.0).otherwise(half_up(100 * (1 - F.col("n") / 25)))
    return j.select("project", "domain", "n", F.round(F.when(F.col("domain") == "security", 100 / (1 + F.col("n") / 5)).otherwise(plain), 4).alias("score"))


_DOMAIN = "CASE " + " ".join(f"WHEN category IN ({', '.join(repr(c) for c in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + " END"
DOMAIN_SQL = f"""WITH {_cases_sql()}, {_projects_sql()}, e AS (SELECT project, unnest([{', '.join(repr(d) for d in DOMAINS)}]) AS domain FROM p), n AS (SELECT project, {_DOMAIN} AS domain, sum(n) AS n FROM f GROUP BY 1, 2),
j AS (SELECT project, domain, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN n USING (project, domain))
SELECT project, domain, n, round(CASE WHEN domain = 'security' THEN 100 / (1 + n / 5) WHEN n >= 25 THEN 0 ELSE floor(100 * (1 - n / 25) + 0.5) END, 4)::DOUBLE AS score FROM j"""


def category_burdens(spark: SparkSession, folder: str) -> DataFrame:
    """Logarithmic burden of each category, those without findings too."""
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    g = cases(spark).groupBy("category").agg(F.sum(scoring.weight(F.col("severity"))).alias("points"))
    return every.join(g, "category", "left").select("category", F.coalesce("points", F.lit(0)).cast("long").alias("points"), F.round(scoring.burden(F.coalesce("points", F.lit(0)), 500.0), 4).alias("burden"))


BURDEN_SQL = f"""WITH {_cases_sql()}, e AS (SELECT unnest([{', '.join(repr(c) for c in CATEGORIES)}]) AS category), g AS (SELECT category, sum(n * {_W}) AS points FROM f GROUP BY 1)
SELECT category, coalesce(points, 0)::BIGINT AS points, round(least(100.0, log10(1 + coalesce(points, 0) / 500) / log10(11.0) * 100), 4) AS burden FROM e LEFT JOIN g USING (category)"""


def risk(high: Column, medium: Column) -> Column:
    return F.when(high >= 3, "critical").when((high >= 1) | (medium >= 3), "high").when(medium >= 1, "medium").otherwise("low")


def measured(found: DataFrame, files: DataFrame) -> DataFrame:
    """What each project's scores are made of: slop, risk, test and document and database scores, counts."""
    f = found.withColumn("bucket", scoring.bucket(F.col("rule_id"))).withColumn("w", scoring.weight(F.col("severity")))

    def total(test: Column, what: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(test, F.lit(1) if what is None else what)), F.lit(0))

    security = F.col("category") == "security"
    slop = sum((F.lit(v) * scoring.burden(total(F.col("ai_specific") & (F.col("bucket") == k), F.col("w")), 1000.0) for k, v in scoring.SLOP.items()), F.lit(0.0))
    g = f.groupBy("project").agg(
        slop.alias("slop"), total(security & (F.col("severity") == "high")).alias("sec_high"), total(security & (F.col("severity") == "medium")).alias("sec_medium"),
        *[total(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], total(F.col("category") == "test", F.col("w")).alias("test_points"),
        total(F.col("rule_id").isin(*DOC_WEIGHTS), chosen(F.col("rule_id"), DOC_WEIGHTS)).alias("doc_points"), total(F.col("rule_id") == "db/sql-concat").alias("db_points"),
        total(F.col("rule_id").isin("visual/spacing-scale-violation", "visual/radius-scale-violation")).alias("off_scale"), total(F.col("ai_specific")).alias("ai"), total(F.col("category") == "logic").alias("logic"),
    )
    j = files.join(g, "project", "left").na.fill(0).na.fill(0.0)
    return j.select(
        "project", "files", "lines", "slop", "high", "medium", "low", "off_scale", "ai", risk(F.col("sec_high"), F.col("sec_medium")).alias("risk"), clamp(100 - F.ceil(F.col("test_points") / 5)).alias("test_quality"),
        clamp(100 - F.col("doc_points")).alias("doc_freshness"), clamp(half_up(100 - 5 * F.col("db_points") / F.col("files") * 5)).alias("db_health"), clamp(half_up(clamp(100 - 2 * F.col("logic") / F.col("files") * 100))).alias("business_logic"),
    )


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, ({x})::DOUBLE))"


def _burden(test: str) -> str:
    return f"least(100.0, log10(1 + coalesce(sum(n * {_W}) FILTER (WHERE {test}), 0) / 1000) / log10(11.0) * 100)"


def _count(test: str, what: str = "n") -> str:
    return f"coalesce(sum({what}) FILTER (WHERE {test}), 0)"


_DOCW = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DOC_WEIGHTS.items()) + " END"
_MEASURED = f"""{_cases_sql()}, {_projects_sql()}, g AS (SELECT project, {' + '.join(f"{v} * " + _burden(f"ai_specific AND {scoring._B} = '{k}'") for k, v in scoring.SLOP.items())} AS slop,
{_count("category = 'security' AND severity = 'high'")} AS sh, {_count("category = 'security' AND severity = 'medium'")} AS sm, {_count("severity = 'high'")} AS high, {_count("severity = 'medium'")} AS medium, {_count("severity = 'low'")} AS low,
{_count("category = 'test'", f"n * {_W}")} AS tp, {_count("category = 'docs'", f"n * {_DOCW}")} AS dp, {_count("rule_id = 'db/sql-concat'")} AS db, {_count("rule_id IN ('visual/spacing-scale-violation', 'visual/radius-scale-violation')")} AS off_scale,
{_count("ai_specific")} AS ai, {_count("category = 'logic'")} AS logic FROM f GROUP BY 1),
m AS (SELECT p.project, files, lines, coalesce(slop, 0) AS slop, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(off_scale, 0) AS off_scale, coalesce(ai, 0) AS ai,
CASE WHEN coalesce(sh, 0) >= 3 THEN 'critical' WHEN coalesce(sh, 0) >= 1 OR coalesce(sm, 0) >= 3 THEN 'high' WHEN coalesce(sm, 0) >= 1 THEN 'medium' ELSE 'low' END AS risk, {_clamp('100 - ceil(coalesce(tp, 0) / 5)')} AS test_quality,
{_clamp('100 - coalesce(dp, 0)')} AS doc_freshness, {_clamp('floor(100 - 5 * coalesce(db, 0) / files * 5 + 0.5)')} AS db_health, floor({_clamp('100 - 2 * coalesce(logic, 0) / files * 100')} + 0.5) AS business_logic FROM p LEFT JOIN g USING (project))"""


def drift(score: Column, bounds: tuple[int, int, int] = (80, 60, 40)) -> Column:
    return F.when(score >= bounds[0], "low").when(score >= bounds[1], "medium").when(score >= bounds[2], "high").otherwise("critical")


def project_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Security risk, test quality, freshness of documents, health of database code and coherence of business logic, with bands, and the weight of size."""
    m = measured(cases(spark), projects(spark))
    size = F.when(F.col("files") == 0, 0.0).when(F.col("files") <= 10, 1.0).otherwise(F.least(F.lit(1.0), F.log10(1 + F.col("files")) / F.log10(F.lit(10001.0))))
    return m.select("project", "risk", "test_quality", "doc_freshness", drift(F.col("doc_freshness")).alias("doc_drift"), "db_health", drift(F.col("db_health")).alias("db_drift"), "business_logic", F.round(size, 6).alias("size_weight"))


def _drift(x: str, a: int = 80, b: int = 60, c: int = 40) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'low' WHEN {x} >= {b} THEN 'medium' WHEN {x} >= {c} THEN 'high' ELSE 'critical' END"


PROJECT_SQL = f"""WITH {_MEASURED} SELECT project, risk, test_quality, doc_freshness, {_drift('doc_freshness')} AS doc_drift, db_health, {_drift('db_health')} AS db_drift, business_logic,
round(CASE WHEN files = 0 THEN 0 WHEN files <= 10 THEN 1 ELSE least(1.0, log10(1 + files) / log10(10001)) END, 6)::DOUBLE AS size_weight FROM m"""


def repository_health(axes: DataFrame, penalties: DataFrame) -> DataFrame:
    """(project, score, debt): the mean of the axes (project, axis, health) that are there by their weights, less 10 for a critical risk and 15 at most for
    findings of high severity, of penalties (project, risk, high)."""
    w = chosen(F.col("axis"), HEALTH_WEIGHTS)
    g = axes.where(F.col("health").isNotNull() & ~F.isnan("health")).groupBy("project").agg((F.sum(clamp(F.col("health")) * w) / F.sum(w)).alias("mean"))
    less = F.when(F.col("risk") == "critical", 10).otherwise(0) + F.least(F.lit(15), F.col("high"))
    j = penalties.join(g, "project", "left").withColumn("raw", clamp(clamp(F.coalesce("mean", F.lit(0.0))) - less))
    return j.select("project", half_up(F.col("raw"), 1).alias("score"), drift(F.col("raw")).alias("debt"))


def project_health(spark: SparkSession, folder: str) -> DataFrame:
    """Health on seven of the eight axes, as architecture isn't measured here."""
    m = measured(cases(spark), projects(spark))
    axes = {"slopIndex": 100 - F.col("slop"), "aiSecurityRisk": chosen(F.col("risk"), RISK_HEALTH).cast("double"), "designTokenViolations": 100.0 - F.col("off_scale") * 2, "testQuality": F.col("test_quality"), "businessLogicCoherence": F.col("business_logic"), "docFreshness": F.col("doc_freshness"), "dbHealth": F.col("db_health")}
    rows = m.select("project", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), h.cast("double").alias("health")) for a, h in axes.items()])).alias("a")).select("project", "a.*")
    return repository_health(rows, m.select("project", "risk", "high"))


_HEALTH = f"""({_clamp('100 - slop')} * 0.2 + (CASE risk {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RISK_HEALTH.items())} END) * 0.2 + {_clamp('100 - off_scale * 2')} * 0.1 + test_quality * 0.1 + business_logic * 0.1 + doc_freshness * 0.05 + db_health * 0.05) / 0.8"""
HEALTH_SQL = f"""WITH {_MEASURED}, h AS (SELECT project, {_clamp(f"{_clamp(_HEALTH)} - CASE WHEN risk = 'critical' THEN 10 ELSE 0 END - least(15, high)")} AS raw FROM m)
SELECT project, floor(raw * 10 + 0.5) / 10 AS score, {_drift('raw')} AS debt FROM h"""


def constitution_score(count: Column) -> Column:
    out = F.lit(0.0)
    for (a, x), (b, y) in reversed(list(zip(CONSTITUTION, CONSTITUTION[1:], strict=False))):
        out = F.when((count >= a) & (count <= b), half_up(x + (y - x) * (count - a) / (b - a))).otherwise(out)
    return F.when(count <= 0, 100.0).when(count >= 20, 0.0).otherwise(out)


def coherence(rows: DataFrame) -> DataFrame:
    """Adds coherence to rows (architecture, fragmentation, violations, debt); what is null counts as 75, or as no violation."""
    parts = {
        "architecture": F.coalesce("architecture", F.lit(75.0)), "fragmentation": F.coalesce(100 - F.col("fragmentation"), F.lit(75.0)), "constitution": constitution_score(F.coalesce("violations", F.lit(0))),
        "debt": F.coalesce(chosen(F.col("debt"), DEBT_HEALTH).cast("double"), F.lit(75.0)),
    }
    return rows.withColumn("coherence", clamp(half_up(sum((COHERENCE[k] * v for k, v in parts.items()), F.lit(0.0)))))


def project_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence with the number of findings as violations and the debt of the health score; architecture isn't measured here."""
    n = cases(spark).groupBy("project").agg(F.count("*").alias("violations"))
    j = project_health(spark, folder).join(n, "project", "left").withColumn("architecture", F.lit(None).cast("double")).withColumn("fragmentation", F.when(F.col("violations") > 3, 40.0))
    return coherence(j).select("project", "violations", "debt", "coherence")


_STEPS = " ".join(f"WHEN violations BETWEEN {a} AND {b} THEN floor({x} + ({y} - {x}) * (violations - {a}) / {b - a} + 0.5)" for (a, x), (b, y) in zip(CONSTITUTION, CONSTITUTION[1:], strict=False))
COHERENCE_SQL = f"""WITH h AS ({HEALTH_SQL}), {_cases_sql()}, n AS (SELECT project, sum(n)::BIGINT AS violations FROM f GROUP BY 1), j AS (SELECT * FROM h LEFT JOIN n USING (project))
SELECT project, violations, debt, {_clamp(f"floor(0.5 * 75 + 0.3 * CASE WHEN violations > 3 THEN 60 ELSE 75 END + 0.1 * (CASE WHEN coalesce(violations, 0) <= 0 THEN 100 WHEN violations >= 20 THEN 0 {_STEPS} END) + 0.1 * (CASE debt {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_HEALTH.items())} END) + 0.5)")} AS coherence FROM j"""


def maintenance_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Health for maintenance on six axes, its band, and the monthly cost in dollars."""
    m = measured(cases(spark), projects(spark))
    axes = {"slop": clamp(100 - F.col("slop")), "architecture": F.lit(70.0), "security": chosen(F.col("risk"), COST_RISK).cast("double"), "constitution": F.lit(100.0), "tokens": clamp(100 - F.col("off_scale") * 0.5), "high": clamp(100 - F.col("high") * 5)}
    m = m.withColumn("health", sum((COST_WEIGHTS[k] * v for k, v in axes.items()), F.lit(0.0))).withColumn("band", drift(F.col("health"), (80, 60, 30)))
    ai = F.when(F.col("ai") > 0, COST_AI).otherwise(1.0)
    issues = sum((F.col(k) * v for k, v in COST_ISSUE.items()), F.lit(0))
    cost = F.col("lines") / 1000 * COST_LINES * chosen(F.col("band"), COST_BUCKET) * ai + issues * ai
    return m.select("project", F.round("health", 4).alias("health"), "band", half_up(cost).cast("long").alias("dollars"))


COST_SQL = f"""WITH {_MEASURED}, h AS (SELECT *, 0.2 * {_clamp('100 - slop')} + 0.25 * 70 + 0.3 * (CASE risk {' '.join(f"WHEN '{k}' THEN {v}" for k, v in COST_RISK.items())} END) + 0.1 * 100 + 0.1 * {_clamp('100 - off_scale * 0.5')} + 0.05 * {_clamp('100 - high * 5')} AS health FROM m),
b AS (SELECT *, {_drift('health', 80, 60, 30)} AS band, CASE WHEN ai > 0 THEN 1.8 ELSE 1.0 END AS k FROM h)
SELECT project, round(health, 4)::DOUBLE AS health, band, floor(lines / 1000 * 25.5 * (CASE band {' '.join(f"WHEN '{k}' THEN {v}" for k, v in COST_BUCKET.items())} END) * k + (high * 400 + medium * 150 + low * 50) * k + 0.5)::BIGINT AS dollars FROM b"""


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by rule with the place of each among its project's by number, and whether it is of the three most common."""
    g = cases(spark).groupBy("project", "rule_id").agg(F.count("*").alias("n"), F.first("category").alias("category"), F.first("severity").alias("severity"))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "rule_id"))
    return g.withColumn("place", place).withColumn("top", F.col("place") <= 3)


ROLLUP_SQL = f"""WITH {_cases_sql()}, g AS (SELECT project, rule_id, sum(n)::BIGINT AS n, any_value(category) AS category, any_value(severity) AS severity FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, rule_id)::INT AS place FROM g) SELECT *, place <= 3 AS top FROM r"""


def issue_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each finding in a report: by weight of severity, then path, line and rule."""
    f = cases(spark).groupBy("project", "path", "rule_id", "line", "severity").agg(F.count("*").alias("n"))
    order = Window.partitionBy("project").orderBy(scoring.weight(F.col("severity")).desc(), "path", "line", "rule_id")
    return f.select("project", "path", "rule_id", "line", F.row_number().over(order).alias("place"))


ORDER_SQL = f"WITH {_cases_sql()} SELECT project, path, rule_id, line, row_number() OVER (PARTITION BY project ORDER BY {_W} DESC, path, line, rule_id)::INT AS place FROM f"

#: An inventory of patterns for the queries: category, name, number of files.
INVENTORY = (
    ("modal", "UserModal", 3), ("modal", "UserDialog", 2), ("modal", "OrderModal", 1), ("button", "SaveButton", 4), ("button", "SaveIcon", 1), ("api", "UserClient", 2), ("api", "UserAPI", 1), ("state", "zustand", 5), ("state", "jotai", 1),
    ("service", "UserService", 2), ("service", "UserManager", 2), ("route", "/users/:id", 1), ("route", "/users/{id}/", 1), ("route", "/orders/", 1), ("card", "UserCard", 1), ("toast", "ErrorToast", 1), ("forms", "zod", 2), ("auth", "useAuth", 1), ("auth", "AuthGuard", 1),
)


def inventory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INVENTORY), "category string, name string, files int")


def route(path: Column) -> Column:
    """A route without its parameters and without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r":\w+", ""), r"\{\w+\}", ""), r"/+$", "")


def stem(name: Column) -> Column:
    """A name without the first of the known suffixes that it ends with."""
    out = name
    for suffix in reversed(SUFFIXES):
        out = F.when(name.endswith(suffix) & (F.length(name) > len(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out


def stems(patterns: DataFrame) -> DataFrame:
    """(category, stem, variants, names) of stems with two variants or more in a category."""
    s = F.when(F.col("category") == "route", route(F.col("name"))).otherwise(stem(F.col("name")))
    return patterns.withColumn("stem", s).groupBy("category", "stem").agg(F.countDistinct("name").alias("variants"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names")).where("variants >= 2")


def pattern_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Stems with several variants, and in how many categories a stem drifts."""
    return stems(inventory(spark)).withColumn("categories", F.count("*").over(Window.partitionBy("stem")))


_INVENTORY = "i AS (SELECT * FROM (VALUES " + ", ".join(map(str, INVENTORY)) + ") AS t(category, name, files))"
_SUFFIX = "CASE WHEN category = 'route' THEN regexp_replace(regexp_replace(regexp_replace(name, ':\\w+', '', 'g'), '\\{\\w+\\}', '', 'g'), '/+$', '') " + " ".join(f"WHEN name LIKE '%{s}' AND length(name) > {len(s)} THEN substr(name, 1, length(name) - {len(s)})" for s in SUFFIXES) + " ELSE name END"
_STEMS = f"{_INVENTORY}, s AS (SELECT category, {_SUFFIX} AS stem, name FROM i), d AS (SELECT category, stem, count(DISTINCT name) AS variants, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM s GROUP BY 1, 2 HAVING count(DISTINCT name) >= 2)"
DRIFT_SQL = f"WITH {_STEMS} SELECT *, count(*) OVER (PARTITION BY stem) AS categories FROM d"


def architecture(spark: SparkSession, folder: str) -> DataFrame:
    """One row: 100 less deductions for modals, buttons, files that call services, libraries of state, drift of names; and the fragmentation of patterns."""
    i = inventory(spark)
    n = i.agg(*[F.coalesce(F.countDistinct(F.when(F.col("category") == c, F.col("name"))), F.lit(0)).alias(c) for c in ("modal", "button", "state")], F.sum(F.when(F.col("category") == "api", F.col("files")).otherwise(0)).alias("api"))
    d = stems(i)
    extra = d.agg(F.coalesce(F.sum(F.col("variants") - 1), F.lit(0)).alias("extra"))
    cross = d.groupBy("stem").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum((F.col("k") >= 2).cast("int")), F.lit(0)).alias("cross"))
    one = n.crossJoin(extra).crossJoin(cross)  # a row each

    def above(c: str) -> Column:
        return F.greatest(F.lit(0), F.col(c) - 1)

    score = clamp(100 - above("modal") * 12 - above("button") * 8 - above("api") * 10 - above("state") * 15 - F.col("extra") * 10 - F.col("cross") * 15)
    excess = i.groupBy("category").agg(F.least(F.lit(4), F.countDistinct("name") - 1).alias("excess")).agg(F.sum(F.coalesce(chosen(F.col("category"), PATTERN_WEIGHTS), F.lit(0)) * F.col("excess")).alias("e"))
    return one.crossJoin(excess).select(score.alias("architecture"), clamp(half_up(100 - F.col("e") / (sum(PATTERN_WEIGHTS.values()) * 4) * 100)).alias("fragmentation"), "extra", "cross")


_PW = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PATTERN_WEIGHTS.items()) + " ELSE 0 END"
ARCHITECTURE_SQL = f"""WITH {_STEMS}, n AS (SELECT count(DISTINCT name) FILTER (WHERE category = 'modal') AS m, count(DISTINCT name) FILTER (WHERE category = 'button') AS b, count(DISTINCT name) FILTER (WHERE category = 'state') AS s, coalesce(sum(files) FILTER (WHERE category = 'api'), 0) AS a FROM i),
x AS (SELECT coalesce(sum(variants - 1), 0)::BIGINT AS extra FROM d), c AS (SELECT count(*) AS cross FROM (SELECT stem FROM d GROUP BY stem HAVING count(*) >= 2)), e AS (SELECT sum({_PW} * least(4, k - 1)) AS e FROM (SELECT category, count(DISTINCT name) AS k FROM i GROUP BY 1))
SELECT {_clamp('100 - greatest(0, m - 1) * 12 - greatest(0, b - 1) * 8 - greatest(0, a - 1) * 10 - greatest(0, s - 1) * 15 - extra * 10 - c.cross * 15')} AS architecture, {_clamp(f'floor(100 - e / {sum(PATTERN_WEIGHTS.values()) * 4} * 100 + 0.5)')} AS fragmentation, extra, c.cross AS "cross" FROM n, x, c, e"""


def composite_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """One row: mean and greatest probability of documents, and the tier of the mean."""
    one = scoring.composite_probability(spark, folder).agg(F.round(F.avg(F.col("probability").cast("decimal(20,10)")).cast("double"), 6).alias("mean"), F.max("probability").alias("max"), F.count("*").alias("files"))
    return one.withColumn("tier", F.when(F.col("mean") < 0.1, "LIKELY_HUMAN").when(F.col("mean") < 0.5, "INCONCLUSIVE").when(F.col("mean") < 0.9, "LIKELY_AI").otherwise("VERY_LIKELY_AI"))


AGGREGATE_SQL = f"""WITH c AS ({scoring.COMPOSITE_SQL}), o AS (SELECT round(avg(probability::DECIMAL(20, 10)), 6)::DOUBLE AS mean, max(probability) AS max, count(*) AS files FROM c)
SELECT *, CASE WHEN mean < 0.1 THEN 'LIKELY_HUMAN' WHEN mean < 0.5 THEN 'INCONCLUSIVE' WHEN mean < 0.9 THEN 'LIKELY_AI' ELSE 'VERY_LIKELY_AI' END AS tier FROM o"""


def directory_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The document with the greatest probability of each source (the smallest id of equal ones), and its tier."""
    c = scoring.composite_probability(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    g = c.groupBy("source").agg(F.max(F.struct("probability", (-F.col("doc_id")).alias("d"))).alias("b"))
    tier = F.when(F.col("b.probability") < 0.3, "LIKELY_HUMAN").when(F.col("b.probability") < 0.7, "INCONCLUSIVE").when(F.col("b.probability") < 0.95, "LIKELY_AI").otherwise("VERY_LIKELY_AI")
    return g.select("source", (-F.col("b.d")).alias("doc_id"), F.col("b.probability").alias("probability"), tier.alias("tier"))


DIRECTORY_SQL = f"""WITH c AS (SELECT source, doc_id, probability, row_number() OVER (PARTITION BY source ORDER BY probability DESC, doc_id) AS n FROM ({scoring.COMPOSITE_SQL}) JOIN documents USING (doc_id))
SELECT source, doc_id, probability, CASE WHEN probability < 0.3 THEN 'LIKELY_HUMAN' WHEN probability < 0.7 THEN 'INCONCLUSIVE' WHEN probability < 0.95 THEN 'LIKELY_AI' ELSE 'VERY_LIKELY_AI' END AS tier FROM c WHERE n = 1"""


def scan_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """One row: what became of the documents, and whether the scan is whole. Documents without text are skipped."""
    found = scoring.rules.findings(spark, folder).select("doc_id").distinct().withColumn("found", F.lit(True))
    d = table(spark, folder, "documents").select("doc_id", (F.coalesce("text", F.lit("")) != "").alias("read")).join(found, "doc_id", "left")
    one = d.agg(F.count("*").alias("selected"), F.coalesce(F.sum(F.col("read").cast("long")), F.lit(0)).alias("analyzed"), F.coalesce(F.sum((F.col("read") & F.col("found").isNull()).cast("long")), F.lit(0)).alias("zero_finding"))
    status = F.when(F.col("selected") == 0, "empty").when(F.col("analyzed") < F.col("selected"), "partial").otherwise("complete")
    return one.withColumn("status", status).withColumn("validity", chosen(F.col("status"), {"complete": "valid", "partial": "incomplete", "empty": "not-applicable"}))


ACCOUNT_SQL = f"""WITH f AS (SELECT DISTINCT doc_id FROM ({scoring.rules.FINDINGS_SQL})), d AS (SELECT doc_id, coalesce(text, '') <> '' AS read, f.doc_id IS NOT NULL AS found FROM documents LEFT JOIN f USING (doc_id)),
o AS (SELECT count(*) AS selected, count(*) FILTER (WHERE read) AS analyzed, count(*) FILTER (WHERE read AND NOT found) AS zero_finding FROM d), s AS (SELECT *, CASE WHEN selected = 0 THEN 'empty' WHEN analyzed < selected THEN 'partial' ELSE 'complete' END AS status FROM o)
SELECT *, CASE status WHEN 'complete' THEN 'valid' WHEN 'partial' THEN 'incomplete' ELSE 'not-applicable' END AS validity FROM s"""


def page_bloat(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted class strings that occur more than five times, on more than one page: how often and on how many."""
    pages = table(spark, folder, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("s"))
    style = F.array_join(F.array_sort(F.filter(F.split(F.trim("s"), r"\s+"), lambda x: x != "")), " ")
    g = pages.select("page_id", style.alias("style")).where("style <> ''").groupBy("style").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
    return g.where("n > 5 AND pages > 1")


BLOAT_SQL = r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS s FROM pages), n AS (SELECT page_id, array_to_string(list_sort(list_filter(regexp_split_to_array(trim(s), '\s+'), lambda x: x <> '')), ' ') AS style FROM s)
SELECT style, count(*) AS n, count(DISTINCT page_id) AS pages FROM n WHERE style <> '' GROUP BY 1 HAVING count(*) > 5 AND count(DISTINCT page_id) > 1"""


def page_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose first 15 tags are the same, on two or more: the first page and their number."""
    tags = F.slice(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), 1, 15)
    g = table(spark, folder, "pages").where(F.col("html").isNotNull()).select("page_id", F.array_join(tags, ",").alias("tags")).where("tags <> ''").groupBy("tags").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    return g.where("pages >= 2")


TWINS_SQL = r"""WITH t AS (SELECT page_id, array_to_string(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)[1:15], ',') AS tags FROM pages WHERE html IS NOT NULL)
SELECT tags, min(page_id) AS first, count(*) AS pages FROM t WHERE tags <> '' GROUP BY 1 HAVING count(*) >= 2"""


def gap_monopoly(values: DataFrame, tokens: int | None = None) -> DataFrame:
    """One row if the commonest of (path, gap) values takes too large a part of the files that have gaps: the value, its share of files and a score."""
    n = values.agg(F.countDistinct("path").alias("files"))
    top = values.groupBy("gap").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "gap")).alias("t"))
    limit = F.lit(0.95) if tokens is not None and 1 <= tokens <= 3 else F.when(F.col("files") < 20, 0.85).otherwise(0.7)
    one = n.crossJoin(top).where("files > 0").withColumn("ratio", F.col("t.n") / F.col("files")).withColumn("limit", limit).withColumn("score", (F.col("ratio") - F.col("limit")) / (1 - F.col("limit")))
    return one.where("ratio > limit AND score > 0.5").select(F.col("t.gap").alias("gap"), "files", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


def project_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(p, c) for p, es, _ in rule_cases.ELEMENTS for _, classes, *_ in es for c in classes.split() if c.startswith("gap-")]
    return gap_monopoly(spark.createDataFrame(rows, "path string, gap string"))


_GAPS = ", ".join(f"('{p}', '{c}')" for p, es, _ in rule_cases.ELEMENTS for _, classes, *_ in es for c in classes.split() if c.startswith("gap-"))
GAPS_SQL = f"""WITH v AS (SELECT * FROM (VALUES {_GAPS}) AS t(path, gap)), n AS (SELECT count(DISTINCT path) AS files FROM v), t AS (SELECT gap, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, gap DESC LIMIT 1),
r AS (SELECT gap, files, n / files AS ratio, CASE WHEN files < 20 THEN 0.85 ELSE 0.7 END AS l FROM t, n) SELECT gap, files, round(ratio, 6)::DOUBLE AS ratio, round((ratio - l) / (1 - l), 6)::DOUBLE AS score FROM r WHERE ratio > l AND (ratio - l) / (1 - l) > 0.5"""


def document_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Edit recency: each document's number of findings times a weight for its last events (1.5 within ten days of the last) and for their number; users stand for files."""
    e = table(spark, folder, "events")
    last = e.agg(F.max("ts").alias("end"))
    g = e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("edits"), F.round(F.sum(F.col("value").cast("decimal(20,6)")).cast("double"), 4).alias("score")).crossJoin(F.broadcast(last))
    recency = F.when(F.unix_timestamp("end") - F.unix_timestamp("ts") <= 10 * 86400, 1.5).otherwise(1.0)
    churn = 1 + F.least(F.col("edits") / 10, F.lit(1.0))
    return g.select("user_id", recency.alias("recency"), F.round(churn, 6).alias("churn"), F.round(F.col("score") * recency * churn, 3).alias("roi"))


WEIGHTS_SQL = """WITH g AS (SELECT user_id, max(ts) AS ts, count(*) AS edits, round(sum(value::DECIMAL(20, 6))::DOUBLE, 4) AS score FROM events GROUP BY 1), w AS (SELECT *, CASE WHEN epoch((SELECT max(ts) FROM events))::BIGINT - epoch(ts)::BIGINT <= 864000 THEN 1.5 ELSE 1.0 END AS r, 1 + least(edits / 10, 1.0) AS c FROM g)
SELECT user_id, r::DOUBLE AS recency, round(c, 6)::DOUBLE AS churn, round(score * r * c, 3)::DOUBLE AS roi FROM w"""

QUERIES = {
    "domain_scores": domain_scores, "category_burdens": category_burdens, "project_scores": project_scores, "project_health": project_health, "project_coherence": project_coherence, "maintenance_cost": maintenance_cost,
    "rule_rollup": rollup, "issue_order": issue_order, "pattern_drift": pattern_drift, "architecture": architecture, "composite_aggregate": composite_aggregate, "directory_scores": directory_scores, "scan_accounting": scan_accounting,
    "page_bloat": page_bloat, "page_twins": page_twins, "project_gaps": project_gaps, "edit_recency": document_weights,
}
ORACLES = {
    "domain_scores": DOMAIN_SQL, "category_burdens": BURDEN_SQL, "project_scores": PROJECT_SQL, "project_health": HEALTH_SQL, "project_coherence": COHERENCE_SQL, "maintenance_cost": COST_SQL,
    "rule_rollup": ROLLUP_SQL, "issue_order": ORDER_SQL, "pattern_drift": DRIFT_SQL, "architecture": ARCHITECTURE_SQL, "composite_aggregate": AGGREGATE_SQL, "directory_scores": DIRECTORY_SQL, "scan_accounting": ACCOUNT_SQL,
    "page_bloat": BLOAT_SQL, "page_twins": TWINS_SQL, "project_gaps": GAPS_SQL, "edit_recency": WEIGHTS_SQL,
}
