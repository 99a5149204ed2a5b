"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Source units (doc_id, lang, source, text) of documents; those without text aren't there."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs.where(F.col("text").isNotNull() & (F.col("text") != ""))


def text_files(spark: SparkSession, pattern: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Source units from whole files: path, extension, text. include and exclude are regular expressions on paths.

    A file without an extension is skipped where one with the same name and an extension is there.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    files = files.withColumn("extension", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    if include:
        files = files.where(F.col("path").rlike(include))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    named = files.where("extension <> ''").select(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "").alias("path")).distinct()
    bare = files.where("extension = ''").join(named, "path", "left_anti")
    return files.where("extension <> ''").unionByName(bare)


def changed_only(units: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Units whose key is in a table of changed ones."""
    return units.join(changed.select(key).distinct(), key, "left_semi")


def unchanged(units: DataFrame, cached: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Units whose content hash is the one in a cache (key, content_sha256): they need no new scan."""
    return units.withColumn("content_sha256", F.sha2(F.col(text), 256)).join(cached.select(key, "content_sha256").distinct(), [key, "content_sha256"], "left_semi")


#: Source files that are looked at by default, and folders that are not.
DEFAULT_INCLUDE = r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs|vue|svelte|astro|html|css|scss|md|mdx|py|go|java|kt|php|rb|rs|swift|dart|cs|c|cc|cpp|h|hpp)$"
DEFAULT_EXCLUDE = r"(?:^|/)(?:node_modules|\.next|dist|build|coverage|\.git)(?:/|$)"


def default_selection(files: DataFrame, key: str = "path") -> DataFrame:
    """Files that are looked at by default."""
    return files.where(F.col(key).rlike(DEFAULT_INCLUDE) & ~F.col(key).rlike(DEFAULT_EXCLUDE))


def changed_paths(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path) of what a version control's list of names and states (state, tab, path, and for a move the new path) says was added, changed or moved."""
    parts = F.split(column, "\t", -1)
    rows = lines.select(F.substring(F.get(parts, 0), 1, 1).alias("state"), F.element_at(parts, -1).alias("path"))
    return rows.where(F.col("state").isin("A", "M", "R", "C", "T")).select("path").distinct()


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a history of scans, from all files of its folder, rotated ones too."""
    return spark.read.option("recursiveFileLookup", "true").json(folder)


def manifest_facts(manifests: DataFrame) -> DataFrame:
    """(path, family, name, value) of package manifests (path, text): dependencies, scripts, engines and workspaces; a text that is no such JSON has none."""
    schema = "name string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, engines map<string,string>, workspaces array<string>"
    m = manifests.select("path", F.from_json("text", schema).alias("m")).select("path", "m.*")
    empty = F.create_map().cast("map<string,string>")
    spaces = F.map_from_arrays(F.coalesce("workspaces", F.array().cast("array<string>")), F.transform(F.coalesce("workspaces", F.array().cast("array<string>")), lambda w: F.lit("")))
    families = {"dependency": F.map_concat(F.coalesce("dependencies", empty), F.map_filter(F.coalesce("devDependencies", empty), lambda k, v: ~F.map_contains_key(F.coalesce("dependencies", empty), k))), "script": F.coalesce("scripts", empty), "engine": F.coalesce("engines", empty), "workspace": spaces}
    rows = F.flatten(F.array(*[F.transform(F.map_entries(v), lambda e, f=f: F.struct(F.lit(f).alias("family"), e["key"].alias("name"), e["value"].alias("value"))) for f, v in families.items()]))
    return m.select("path", F.explode(rows).alias("r")).select("path", "r.*")


def conflicts(facts: DataFrame) -> DataFrame:
    """(family, name, values) of facts that manifests give different values."""
    return facts.groupBy("family", "name").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)
