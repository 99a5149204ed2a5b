"""Connected components by repeated minimum labels and pointer jumps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df without its lineage, in the checkpoint folder that machines share; a session in one process may go without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): least node that edges reach, for nodes that have edges."""
    ways = kept(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct())
    labels = kept(ways.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("c")))
    for _ in range(max_rounds):
        near = ways.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("c").alias("near"))
        closer = labels.join(near, "x").select("x", F.least("c", "near").alias("c"))
        jump = closer.select(F.col("x").alias("c"), F.col("c").alias("further"))
        after = kept(closer.join(jump, "c", "left").select("x", F.least("c", F.coalesce("further", "c")).alias("c")))
        if not after.join(labels.withColumnRenamed("c", "old"), "x").where("c <> old").limit(1).count():
            return after.select(F.col("x").alias("node"), F.col("c").alias("component"))
        labels = after
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
