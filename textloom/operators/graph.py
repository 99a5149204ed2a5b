"""Weighted graphs: edges from co-occurrence, modularity, components, a spectral estimate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.components import components
from textloom.sources.tables import table


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parts bought together in an order: a < b, with the number of orders. An order has few lines, which bounds its pairs."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "a"), lines.withColumnRenamed("l_partkey", "b")
    return a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))


EDGES_SQL = "l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT x.p AS a, y.p AS b, count(*) AS w FROM l x JOIN l y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2)"


def normalised(rows: DataFrame) -> DataFrame:
    """Edges (a, b, w) of an undirected graph, parallel and reversed ones merged."""
    return rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def modularity(e: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: modularity of groups (node, g) in a graph."""
    m = e.agg(F.sum("w").alias("m"))
    j = e.join(groups.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a").join(groups.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b")
    sides = j.select(F.explode(F.array(F.struct(F.col("ga").alias("g"), F.when(F.col("ga") == F.col("gb"), F.col("w")).otherwise(0).alias("i"), F.col("w").alias("t")), F.struct(F.col("gb").alias("g"), F.when(F.col("ga") == F.col("gb"), F.col("w")).otherwise(0).alias("i"), F.col("w").alias("t")))).alias("s")).select("s.*")
    g = sides.groupBy("g").agg(F.sum("i").alias("i"), F.sum("t").alias("t")).crossJoin(F.broadcast(m))
    return g.agg(F.round(F.sum(F.col("i") / (2 * F.col("m")) - F.pow(F.col("t") / (2 * F.col("m")), 2)), 6).alias("modularity"), F.count("*").alias("groups"))


def graph_modularity(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity of parts' groups by brand-like classes (the key's remainder by 7) in the graph of joint orders."""
    nodes = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 7).alias("g"))
    return modularity(edges(spark, folder), nodes)


MODULARITY_SQL = f"""WITH {EDGES_SQL}, s AS (SELECT a % 7 AS g, CASE WHEN a % 7 = b % 7 THEN w ELSE 0 END AS i, w AS t FROM e UNION ALL SELECT b % 7, CASE WHEN a % 7 = b % 7 THEN w ELSE 0 END, w FROM e),
g AS (SELECT g, sum(i) AS i, sum(t) AS t FROM s GROUP BY 1), m AS (SELECT sum(w) AS m FROM e) SELECT round(sum(i / (2 * m) - pow(t / (2 * m), 2)), 6) AS modularity, count(*) AS groups FROM g, m"""


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the graph of customers and suppliers of one nation, by their balances' signs: sizes by least node."""
    c = table(spark, folder, "customer").select((F.col("c_custkey") * 2).alias("a"), (F.col("c_nationkey") * 2 + 1 + 2 * (F.col("c_acctbal") < 0).cast("int") * 100).alias("b"))
    found = components(c, "a", "b")
    return found.groupBy("component").agg(F.count("*").alias("members"))


COMPONENTS_SQL = """WITH e AS (SELECT c_custkey * 2 AS a, c_nationkey * 2 + 1 + 2 * (c_acctbal < 0)::INT * 100 AS b FROM customer),
l AS (SELECT b, least(min(a), b) AS c, count(DISTINCT a) + 1 AS n FROM e GROUP BY 1) SELECT c AS component, n AS members FROM l"""


def fiedler(n: int, rows: list[tuple[int, int, float]]) -> float:
    """Least nonzero Ritz value of the Laplacian after three Lanczos steps from the first unit vector: an estimate of the connectivity. 0 for fewer
    than two nodes or no edges."""
    if n < 2 or not rows:
        return 0.0
    lap = np.zeros((n, n))
    for a, b, w in rows:
        if 0 <= a < n and 0 <= b < n and a != b:
            lap[a, b] -= w
            lap[b, a] -= w
            lap[a, a] += w
            lap[b, b] += w
    q, before, alphas, betas = np.eye(n)[0], np.zeros(n), [], []
    beta = 0.0
    for _ in range(min(3, n)):
        z = lap @ q - beta * before
        alphas.append(float(q @ z))
        z -= alphas[-1] * q
        beta = float(np.linalg.norm(z))
        if beta < 1e-12:
            break
        betas.append(beta)
        before, q = q, z / beta
    k = len(alphas)
    t = np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1)
    some = [v for v in np.linalg.eigvalsh(t) if v > 1e-9]
    return round(float(min(some)), 4) if some else 0.0


QUERIES = {"graph_modularity": graph_modularity, "graph_components": graph_components}
ORACLES = {"graph_modularity": MODULARITY_SQL, "graph_components": COMPONENTS_SQL}
