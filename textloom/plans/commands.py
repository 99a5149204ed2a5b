"""What a user types: scans, gates, changed files, lookups. Each takes tables and gives tables; nothing is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import policy, scoring
from textloom.operators.catalog import RULES, catalog
from textloom.operators.fact_rules import Facts, fact_findings
from textloom.operators.source_rules import source_findings
from textloom.plans.components import kept


@dataclass(frozen=True)
class Config:
    """Severities by rule (or off), rules to look at alone, what imports and scales are allowed, and limits of gates (null: none)."""

    severities: dict[str, str] = field(default_factory=dict)
    only: tuple[str, ...] = ()
    allowed_imports: tuple[str, ...] = ()
    spacing_scale: tuple[float, ...] = ()
    radius_scale: tuple[float, ...] = ()
    max_slop: float | None = None
    min_health: float | None = None
    max_new: int | None = None


def problems(config: Config) -> list[str]:
    """What is wrong with a configuration."""
    known = {r[0] for r in RULES}
    out = [f"unknown rule {r}" for r in sorted({*config.severities, *config.only} - known)]
    return out + [f"unknown severity {s}" for s in sorted(set(config.severities.values()) - {"off", "auto", "low", "medium", "high"})]


def scan(units: DataFrame, facts: Facts | None = None, config: Config = Config()) -> dict[str, DataFrame]:
    """findings of units (path, text) and facts, those that score, scores by file and the corpus's health."""
    spark = units.sparkSession
    found = source_findings(units)
    if facts is not None:
        found = found.unionByName(fact_findings(facts, units, list(config.allowed_imports), list(config.spacing_scale), list(config.radius_scale)))
    known = policy.select_rules(catalog(spark), only=list(config.only) or None)
    found = found.join(F.broadcast(known.select("rule_id", "category", "severity", "ai_specific")), "rule_id")
    if config.severities:
        found = policy.overridden(found, spark.createDataFrame(list(config.severities.items()), "rule_id string, override string"))
    found = kept(found)
    scoring_ones = policy.effective(found, known)
    files = scoring_ones.groupBy("path").agg(F.least(F.lit(100), F.sum(scoring.weight(F.col("severity")))).cast("long").alias("score"), F.count("*").alias("n"))
    return {"findings": found, "scoring": scoring_ones, "files": files, "health": scoring.health(scoring_ones)}


def gate(result: dict[str, DataFrame], config: Config, new: int | None = None) -> DataFrame:
    """One row: the gates that fail, in order; a limit on new findings fails where their number isn't known."""
    failed = [F.when(F.col("slop") > config.max_slop, "max-slop") if config.max_slop is not None else F.lit(None), F.when(F.col("health") < config.min_health, "min-health") if config.min_health is not None else F.lit(None)]
    if config.max_new is not None:
        failed.append(F.lit("max-new") if new is None or new > config.max_new else F.lit(None))
    return result["health"].select("slop", "health", F.array_compact(F.array(*[f.cast("string") for f in failed])).alias("failed"))


def changed_points(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Weighted findings of changed files (path)."""
    some = findings.join(changed.select("path").distinct(), "path", "left_semi")
    return some.groupBy("path").agg(F.sum(scoring.weight(F.col("severity"))).cast("long").alias("points"))


def list_rules(spark: SparkSession, kind: str = "all", category: str | None = None) -> DataFrame:
    known = policy.select_rules(catalog(spark), kind=kind)
    return (known if category is None else known.where(F.col("category") == category)).orderBy("rule_id")


def explain_rule(spark: SparkSession, rule_id: str) -> DataFrame:
    """A rule's row and what its policy means; none for a name that isn't known."""
    c = catalog(spark).where(F.col("rule_id") == rule_id)
    return c.withColumn("runs", F.col("policy").isin("on")).withColumn("bucket", policy.bucket_of(F.col("verdict"), F.col("ai_specific")))


def suggest_steps(classes: DataFrame, scale: list[float]) -> DataFrame:
    """(class, rem, step) of spacing classes with a value in px or rem that no step of a scale is, and the nearest step."""
    value = F.regexp_extract("class", r"\[(-?\d+(?:\.\d+)?)(px|rem)\]", 1)
    rem = F.when(F.regexp_extract("class", r"\[(-?\d+(?:\.\d+)?)(px|rem)\]", 2) == "px", value.cast("double") / 16).otherwise(value.cast("double"))
    steps = F.array(*[F.struct(F.abs(F.col("rem") - s).alias("d"), F.lit(float(s)).alias("step")) for s in scale])
    near = classes.where(value != "").withColumn("rem", rem).withColumn("near", F.array_min(steps))
    return near.where("near.d >= 0.001").select("class", "rem", F.col("near.step").alias("step"))


def badge(health: float) -> str:
    """Text of a badge for a health score."""
    return f"health {round(health)} " + ("good" if health >= 80 else "fair" if health >= 60 else "poor")


def rewrite_imports(units: DataFrame, moves: dict[str, str]) -> DataFrame:
    """Units with import specifiers replaced where they are the whole quoted text; moves are few and a literal."""
    text = F.col("text")
    for old, new in moves.items():
        text = F.regexp_replace(text, r"""(\bfrom\s*|\brequire\(\s*|\bimport\s*)(['"])""" + T.re_escape(old) + r"\2", "$1$2" + new.replace("$", r"\$") + "$2")
    return units.withColumn("text", text)
