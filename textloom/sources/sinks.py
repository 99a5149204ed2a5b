"""Reports of findings: each is a DataFrame of lines, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a line; wrap them in a run where a single file is wanted."""
    level = F.lit("none")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    place = F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))).alias("value"))


def markdown_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat_ws(" | ", F.lit(""), "rule_id", "severity", F.col("doc_id").cast("string"), F.col("line").cast("string"), F.lit("")).alias("value"))


def save(lines: DataFrame, folder: str) -> None:
    lines.write.mode("overwrite").text(folder)


def append_history(rows: DataFrame, folder: str) -> None:
    """Adds rows of a scan to a history, partitioned by its day."""
    rows.withColumn("day", F.date_format(F.current_timestamp(), "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(folder)


def brief_lines(findings: DataFrame) -> DataFrame:
    """A line for each rule: how many findings it has."""
    g = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    return g.select(F.concat_ws(" ", F.rpad("severity", 6, " "), F.lpad(F.col("n").cast("string"), 6, " "), "rule_id").alias("value"))


def pretty_lines(findings: DataFrame) -> DataFrame:
    """A line for each finding: place, severity and rule."""
    return findings.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.rpad("severity", 8, " "), "rule_id").alias("value"))


def _escaped(column: str):
    out = F.col(column).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_rows(findings: DataFrame) -> DataFrame:
    """A table row of HTML for each finding."""
    cells = [F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>")) for c in ("doc_id", "line", "severity", "rule_id")]
    return findings.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def diff_hunks(fixes: DataFrame) -> DataFrame:
    """A unified diff's hunk for each fix (path, line, old, new) of one line."""
    place = F.concat(F.lit("@@ -"), F.col("line").cast("string"), F.lit(",1 +"), F.col("line").cast("string"), F.lit(",1 @@"))
    return fixes.select(F.concat_ws("\n", F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), place, F.concat(F.lit("-"), "old"), F.concat(F.lit("+"), "new")).alias("value"))


def sharded_json(rows: DataFrame, keys: list[str], folder: str, shards: int, most: int = 1_000_000) -> DataFrame:
    """Writes rows as JSON lines in ranges of the keys, sorted, no file with more than most rows; returns a receipt for each range: number of rows, first and
    last key and the digest of its lines' digests, in order."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    placed = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    placed.select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", most).text(folder)
    key = F.struct(*keys)
    digests = placed.select(F.spark_partition_id().alias("shard"), key.alias("key"), F.sha2(line, 256).alias("d"))
    return digests.groupBy("shard").agg(F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def append_outcomes(rows: DataFrame, folder: str) -> None:
    """Adds outcome events (at timestamp, more) to their store, by day."""
    rows.withColumn("day", F.date_format("at", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(folder)


def outcomes(rows: DataFrame, since: str | None = None, without: list[str] | None = None, key: str = "id") -> DataFrame:
    """Outcome events to export: those from a day on, and without those of some ids, which is how a store is written anew to delete them."""
    if since is not None:
        rows = rows.where(F.col("day") >= since)
    return rows.where(~F.col(key).isin(*without)) if without else rows


def snapshot(inventory: DataFrame, by: str) -> DataFrame:
    """One JSON line for each value of a column: how many rows and the names in order."""
    g = inventory.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    return g.select(F.to_json(F.struct(F.col(by), "n", "names")).alias("value"))
