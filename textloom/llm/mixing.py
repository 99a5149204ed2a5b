"""Mixing sources to target weights by entropy balancing.

Among all rates w of documents, 0 <= w <= most, whose rated words meet every source's target, the mix is the one nearest to the plain corpus: that
with the least sum over documents of w log w - w + 1. Its dual has one multiplier for each source's token constraint and is convex, and the rate of
a document of size x is exp(multiplier * x / mean size of its source), cut off at most: documents are tilted by their own size. Newton's steps
solve the dual. In each, executors sum the gradient (words due less target) and the Hessian over the documents, equal sizes of a source as one
row; the Hessian is diagonal, as no document belongs to two sources, so all sources step at once. Rates then are rounded into whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, ranked, word_count

NEWTON_STEPS = 200
#: Part of a target by which the words due may miss it.
TOLERANCE = 1e-12
#: Documents that are rounded together, in one task's memory; a larger source is dealt into several blocks of about this size.
BLOCK_ROWS = 1_000


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds __rank (from 0) and target to sources (source, source_size), a table with one row for each source. Kept.

    Sources by code point, null last, take the weights in turn and share so large a part of all words. No target is above most times its
    source's size; what is cut off is shared by weight among the rest until none is above. So target = min(limit, weight * level) with one level
    for all: each round takes the level that the sources below their limit leave, until no other reaches its own.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked(sources, [F.col("source").asc_nulls_last()], "__rank")
    table = cut(table.withColumn("__weight", F.element_at(pattern, (F.col("__rank") % len(weights) + 1).cast("int"))).withColumn("__limit", most * F.col("source_size")))
    one = table.agg(F.sum("source_size").alias("words"), F.sum("__weight").alias("weight")).first()
    total = share * (one.words or 0)
    level, before = total / (one.weight or 1.0), None
    while level is not None and level != before:
        full = F.col("__limit") <= level * F.col("__weight")
        one = table.agg(F.sum(F.when(full, F.col("__limit")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("__weight"))).alias("left")).first()
        before, level = level, (total - one.full) / one.left if one.left else None
    target = F.col("__limit") if level is None else F.least(F.col("__limit"), F.lit(level) * F.col("__weight"))
    return table.withColumn("target", target.cast("double")).drop("__weight", "__limit")


def multipliers(sizes: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """(__rank, multiplier) of the dual's solution, from sizes (__rank, size, n) without empty documents and plan (__rank, words, docs, least, target), where
    words, docs and the least size are those of documents with words. Infinite where a target takes all that the limit allows.

    The gradient grows with the multiplier, so its signs bracket the root; a step that leaves the bracket or gains too little is a bisection.
    """
    cap = math.log(most)
    x = F.col("size") * F.col("docs") / F.col("words")
    smallest = F.col("least") * F.col("docs") / F.col("words")
    # All rates are at the limit at the one end. At the other, no rate is above target / words.
    down = F.col("target") < F.col("words")
    low = F.when(down, F.ln(F.col("target") / F.col("words")) / smallest).otherwise(F.lit(0.0))
    high = F.when(down, F.lit(0.0)).otherwise(cap / smallest)
    full = F.col("target") >= most * F.col("words") * (1 - TOLERANCE)
    state = plan.where("target > 0 AND words > 0").select("__rank", "words", "docs", "target", low.alias("low"), high.alias("high"), F.lit(0.0).alias("at"), (high - low).alias("step"), (high - low).alias("old"), full.alias("done"), full.alias("full"))
    state = cut(state)
    carried = [c for c in state.columns if c != "__rank"]
    for _ in range(NEWTON_STEPS):
        if not state.where("NOT done").limit(1).count():
            break
        tilt = F.col("at") * x
        rate = F.exp(F.least(tilt, F.lit(cap)))
        due, slope = F.col("n") * F.col("size") * rate, F.col("n") * F.col("size") * x * rate
        sums = sizes.join(state, "__rank").groupBy("__rank").agg(
            F.sum(due).alias("due"), F.sum(F.when(tilt < cap, slope).otherwise(0.0)).alias("slope"), *[F.first(c).alias(c) for c in carried],
        )
        gap = F.col("due") - F.col("target")
        sums = sums.withColumn("gap", gap).withColumn("done", F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target")))
        sums = sums.withColumn("low", F.when(F.col("gap") < 0, F.col("at")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("at")).otherwise(F.col("high")))
        newton = F.col("at") - F.try_divide(F.col("gap"), F.col("slope"))
        good = F.coalesce((newton > F.col("low")) & (newton < F.col("high")) & (2 * F.abs(F.col("gap")) <= F.abs(F.col("old") * F.col("slope"))), F.lit(False))
        after = F.when(good, newton).otherwise((F.col("low") + F.col("high")) / 2)
        moved = sums.withColumn("next", F.when(F.col("done"), F.col("at")).otherwise(after))
        narrow = (F.col("next") == F.col("at")) | (F.col("high") - F.col("low") <= 1e-15 * F.abs(F.col("at")))
        state = cut(moved.select("__rank", "words", "docs", "target", "low", "high", F.col("next").alias("at"), (F.col("next") - F.col("at")).alias("step"), F.col("step").alias("old"), (F.col("done") | narrow).alias("done"), "full"))
    return state.select("__rank", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("at")).alias("multiplier"))


def rates(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds __rank, __docs, source_size, target, multiplier and rate to slim (source, size, more), which is kept."""
    sizes = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    some = F.col("size") > 0
    facts = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("__docs"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("docs"), F.min(F.when(some, F.col("size"))).alias("least"),
    )
    plan = targets(facts, weights, share, most)
    named = plan.withColumnRenamed("source", "__source")
    known = sizes.where("size > 0").join(named.select("__source", "__rank"), F.col("source").eqNullSafe(F.col("__source"))).select("__rank", "size", "n")
    found = multipliers(cut(known), plan.withColumnRenamed("source_size", "words"), most)
    named = cut(named.join(found, "__rank", "left").drop("least"))
    given = slim.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    tilt = F.col("multiplier") * F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when((F.col("size") > 0) & F.col("multiplier").isNotNull(), F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(math.log(most)))))).otherwise(F.lit(0.0))
    return given.withColumn("rate", F.round(rate, 12)).drop("docs")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies): how many whole copies of each document the mix takes.

    Null texts have size 0, and documents of size 0 are never taken; a null source is a source. No document has more than ceil(most) copies.
    Each row is a document of its own, also where ids are repeated or null. Empty tables give no rows. Rounding depends on ids and
    sizes only, so reruns agree. Needed columns are read, others may have any name.
    """
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    given = rates(slim, weights, share, most)
    given = given.withColumn("__block", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.ceil(F.col("__docs") / BLOCK_ROWS)))

    def rounded(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        return block.assign(copies=_copies(block["rate"].to_numpy(), block["size"].to_numpy()))[["doc_id", "source", "size", "source_size", "target", "rate", "copies"]]

    return given.groupBy("__rank", "__block").applyInPandas(
        rounded, "doc_id long, source string, size long, source_size long, target double, rate double, copies long"
    )


def _copies(rate: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole copies, the longest document first, each rounded to the side that keeps the words taken nearest to those due."""
    low = np.floor(rate + 1e-9)
    whole = rate - low < 1e-9
    copies = low.astype(np.int64)
    owed = 0.0
    for i in np.flatnonzero(~whole & (size > 0)):
        due = owed + (rate[i] - low[i]) * size[i]
        if due > size[i] / 2:
            copies[i] += 1
            due -= size[i]
        owed = due
    copies[size == 0] = 0
    return copies


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
