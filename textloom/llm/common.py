"""Words, vectorised word hashes, cut points of lineage and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space and U+0009 to U+000D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step takes at once (a longer document is a step by itself).
STEP_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n-1 modulo 2**64, for n up to STEP_BYTES + 1."""
    if base not in _powers:
        steps = np.full(STEP_BYTES + 1, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents data[starts[i]:ends[i]], which lie one after the other.

    Returns the byte where each word starts and ends, its hash, and the number of words before each document (one entry more than documents).
    fold: A-Z count as a-z.
    """
    n = len(data)
    solid = np.empty(n + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not(_IS_GAP[data], out=solid[1:-1].view(bool))
    step = np.diff(solid)
    begin_at, end_at = step[:-1] == 1, step[1:] == -1
    # Where one document ends and the next begins without white space, the word is cut.
    inner = starts[(starts > 0) & (starts < n)]
    inner = inner[(solid[inner + 1] == 1) & (solid[inner] == 1)]
    begin_at[inner] = True
    end_at[inner - 1] = True
    first, last = np.flatnonzero(begin_at), np.flatnonzero(end_at) + 1
    hashes = mix(_hashes(data, first, last, _FOLDED if fold else _BYTE))
    return first, last, hashes, np.append(np.searchsorted(first, starts), len(first))


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Polynomials of the bytes first[i] .. last[i] - 1, by steps of STEP_BYTES, whatever the length of a text or a word."""
    out = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        base = int(first[at])
        to = int(np.searchsorted(last, base + STEP_BYTES, side="right"))
        if to <= at:  # a word longer than a step
            total = 0
            for begin in range(base, int(last[at]), STEP_BYTES):
                piece = table[data[begin : min(begin + STEP_BYTES, int(last[at]))]]
                total += int((piece * _power(_BASE, len(piece))).sum(dtype=np.uint64)) * pow(_BASE, begin - base, 2**64)
            out[at] = total % 2**64
            at += 1
            continue
        part = table[data[base : last[to - 1]]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        begin, end = first[at:to] - base, last[at:to] - base
        out[at:to] = (sums[end] - sums[begin]) * _power(_INVERSE, len(part) + 1)[begin]
        at = to
    return out


def batches_of_text(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about STEP_BYTES: first row, row after the last, the bytes, where each text starts and where it ends. Null is empty."""
    text = batch.column(column)
    if text.null_count:
        text = text.fill_null("")
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        kind = np.int32
    rows = len(text)
    if not rows:
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + rows + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
        to = min(to, rows)
        base = offsets[at]
        yield at, to, data[base : offsets[to]], offsets[at:to] - base, offsets[at + 1 : to + 1] - base
        at = to


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of so many consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for j in range(width):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64
    return mix(total)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; only a session in one process may go without."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


#: With this setting Spark removes the shuffle files of a query as soon as it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that executors share. Shuffle files of its making are removed at once, as nothing reads them again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_FREE, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u, v).

    Alternates large-star and small-star steps, each a join and a map-side combined minimum, until the edges are a set of stars.
    Edges are 16 bytes each and never leave the executors; a node with very many edges is one row of the minimum and a splittable side of the join.
    """
    spark = edges.sparkSession
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    before = None
    for _ in range(max_rounds):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_key(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: the id, or, where ids are null or repeated, a new column __row of a kept copy."""
    odd = docs.groupBy(id_col).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | F.col(id_col).isNull()).limit(1)
    if not odd.count():
        return docs, id_col
    return cut(docs.withColumn("__row", F.monotonically_increasing_id())), "__row"


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's rank from 0 by the order given, sorted in parts by the executors; a number for each part goes to the driver. Kept."""
    place = cut(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = sorted((r.part, r.n) for r in place.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    start, before = {}, 0
    for k, n in sizes:
        start[k] = before
        before += n
    offsets = F.create_map(*[F.lit(x).cast("long") for k, n in start.items() for x in (k, n)]) if start else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return place.withColumn(name, offsets[part] + F.col(name).bitwiseAND((1 << 33) - 1))


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A schema with more columns, by name and type; the given one stays as it is."""
    out = T.StructType(list(schema.fields))
    for name, kind in columns.items():
        out.add(name, T.DataType.fromDDL(kind))
    return out
