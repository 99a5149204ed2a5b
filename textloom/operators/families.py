"""How unequal class names' counts are on a page; rules on the spread of families of tokens are in fact_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.tables import table

CLASS = ("logic/math-gini-class-usage", r'class(?:Name)?="([^"]*)"')


def class_gini(given: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Gini coefficient of class names' counts by ranks, and how often the commonest whole class string of ten characters or more occurs."""
    strings = given.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(text, F.lit(CLASS[1]), F.lit(1))).alias("s"))
    c = strings.select(key, F.explode(F.filter(F.split("s", " +"), lambda x: x != "")).alias("c")).groupBy(key, "c").agg(F.count("*").alias("n"))
    c = c.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("n", "c")))
    g = c.groupBy(key).agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.sum(F.col("i") * F.col("n")).alias("w"))
    gini = 2 * F.col("w") / (F.col("classes") * F.col("total")) - (F.col("classes") + 1) / F.col("classes")
    most = strings.where(F.length("s") >= 10).groupBy(key, "s").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("repeated"))
    return g.join(most, key, "left").select(key, "classes", "total", (F.round(gini, 6) + 0.0).alias("gini"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


def page_classes(spark: SparkSession, folder: str) -> DataFrame:
    return class_gini(table(spark, folder, "pages"), "page_id", "html")


PAGE_SQL = r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, 'class(?:Name)?="([^"]*)"', 1)) AS s FROM pages WHERE html IS NOT NULL),
t AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(s, ' +'), lambda x: x <> '')) AS c FROM s), c AS (SELECT page_id, c, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n, c) AS i FROM c), g AS (SELECT page_id, count(*) AS k, sum(n) AS total, sum(i * n) AS w FROM r GROUP BY 1),
m AS (SELECT page_id, max(n) AS n FROM (SELECT page_id, s, count(*) AS n FROM s WHERE length(s) >= 10 GROUP BY 1, 2) GROUP BY 1)
SELECT page_id, k AS classes, total::BIGINT AS total, round(2 * w / (k * total) - (k + 1) / k, 6) + 0.0 AS gini, coalesce(n, 0) AS repeated FROM g LEFT JOIN m USING (page_id)"""

QUERIES = {"page_classes": page_classes}
ORACLES = {"page_classes": PAGE_SQL}
