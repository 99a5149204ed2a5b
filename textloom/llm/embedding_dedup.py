"""Near-duplicate embeddings by iterative quantisation.

A rotation of centred, normalised vectors is learned so that the signs of the rotated coordinates are balanced, near binary codes. Runs of code
bits, here signs of the rotated vectors themselves, are keys of several Hamming tables; vectors that share a key in any table meet. Signs after the
mean is subtracted would part pairs more often than their own angle says. Key length follows the largest label, and the number of tables follows
from it, so that a pair at the threshold meets with a probability of RECALL.

1. Keys alone go to their cells, and those that are alone in theirs are dropped.
2. What is left meets by codes: all keys of a vector, whose Hamming distance screens the pairs.
3. Vectors of the pairs that pass meet in the first table that brings the pair together, and the cosine of the original vectors decides.

Equal vectors are one vector with a count. A cell with more than BLOCK vectors is dealt into pairs of blocks, which hold codes in step 2, and a task
sends back counts and a spanning forest of the links that it finds, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import connected_components, cut, mix, partitions

#: Vectors that the rotations are learned from at most.
SAMPLE_ROWS = 20_000
ROUNDS = 30
RECALL = 0.999
BLOCK = 1024
#: Cells up to this size are compared as lists of pairs, larger ones as matrices of TILE rows.
SMALL, TILE, PAIRS = 48, 256, 1 << 16
#: Bytes of rotations that are broadcast at most.
MAX_BROADCAST = 512 << 20


def rotations(sample: np.ndarray, count: int, seed: int = 11) -> list[np.ndarray]:
    """So many rotations, learned from normalised vectors less their mean, from different starts."""
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - mean
    out = []
    for k in range(count):
        r = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((d, d)))[0]
        for _ in range(ROUNDS if len(x) >= d else 0):
            codes = np.where(x @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ x)
            r = (left @ right).T
        out.append(r)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tables:
    """Keys of vectors of one dimension."""

    def __init__(self, turns: list[np.ndarray], bits: int, count: int, threshold: float):
        per = max(1, turns[0].shape[0] // bits)
        self.bits, self.count = bits, count
        #: The columns of the rotations that keys are taken from, table after table.
        self.axes = np.hstack([t[:, : per * bits] for t in turns])[:, : count * bits]
        apart = math.acos(threshold) / math.pi
        total = bits * count
        #: Differing bits of all keys that a pair at the threshold has at most, eight standard deviations above what is expected.
        self.most = total * apart + 8 * math.sqrt(total * apart * (1 - apart)) + 2

    def keys(self, units: np.ndarray) -> np.ndarray:
        """A row of keys, one for each table."""
        signs = (units @ self.axes >= 0).reshape(len(units), self.count, self.bits)
        return (signs @ (1 << np.arange(self.bits, dtype=np.int64))).astype(np.uint32)


def plan(largest: int, dimension: int, threshold: float) -> tuple[int, int, int]:
    """Bits of a key, tables and rotations for so many vectors of one label. Cells hold an eighth of a vector on average."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, largest))) + 3), dimension)
    agree = 1 - math.acos(threshold) / math.pi
    tables = min(255, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))) if dimension > 1 else 1
    return bits, tables, math.ceil(tables / max(1, dimension // bits))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked directly, least id that links reach, and whether that's its own.

    Vectors link if their labels are equal and not null, they have one length, and their cosine in double precision is at least threshold. Those
    that are null, empty, zero or hold null, NaN or infinite components, or have no id, link with nothing. Ids should be unique. Equal vectors are
    told by two 64-bit hashes. Other columns are ignored. There is a set of rotations for each length of vectors, which should be few.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # what is exact stays as short as it is
    zero = F.lit(0.0).cast(kind[6:-1])
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    # -0.0 and 0.0 are one.
    marked = given.select("vec_id", "label", F.when(sound, F.transform("v", lambda x: x + zero)).alias("v"))
    marked = marked.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(29), F.size("v"), "v", "label").alias("b"))).alias("h"))
    same = marked.where("h IS NOT NULL").groupBy("h.a", "h.b")
    single = cut(same.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("v").alias("v"), F.first(F.xxhash64("label", F.size("v"))).alias("g")).withColumn("d", F.size("v")))
    shapes = {r.d: r.n for r in single.groupBy("g", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    tables = {}
    for d, largest in shapes.items():
        bits, count, turns = plan(largest, d, threshold)
        rows = single.where(F.col("d") == d).orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v").toPandas()
        tables[d] = Tables(rotations(unit(np.vstack(rows["v"].to_numpy())), turns), bits, count, threshold)
    if sum(t.axes.nbytes for t in tables.values()) > MAX_BROADCAST:
        raise ValueError(f"rotations of vectors of lengths {sorted(tables)} take more than {MAX_BROADCAST} bytes")
    sent = spark.sparkContext.broadcast(tables)

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of each vector; a cell's last byte is its table."""
        for batch in batches:
            for d, rows in _by_length(batch):
                keys = sent.value[d].keys(rows["unit"]).astype(np.uint64)
                which = np.arange(keys.shape[1], dtype=np.uint64)
                cells = mix(mix(keys * np.uint64(256) + which) ^ rows["g"].view(np.uint64)[:, None]) & ~np.uint64(255) | which
                ids = np.broadcast_to(rows["vec_id"][:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (cells.view(np.int64), ids)], ["cell", "vec_id"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_length(batch):
                keys = sent.value[d].keys(rows["unit"])
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * (4 * keys.shape[1])
                codes = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(rows["vec_id"]), pa.array(np.full(len(keys), d, dtype=np.int32)), codes], ["vec_id", "d", "code"])

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, vec_id) of vectors with a near code in this cell, if no earlier table has the pair."""
        for d, rows, table in _cells_of(batches):
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint32).reshape(len(table), -1)
            model, t = sent.value[d], rows["cell"] & 255

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.bitwise_count(code[a] ^ code[b]).sum(axis=-1, dtype=np.int32) <= model.most

            seen = np.zeros(len(code), dtype=bool)
            for a, b in _pairs(rows, near, near):
                first = np.argmax(code[a] == code[b], axis=1) == t[a]
                seen[a[first]] = True
                seen[b[first]] = True
            at = np.flatnonzero(seen)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rows["cell"][at]), pa.array(rows["vec_id"][at])], ["cell", "vec_id"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(u, links, v): links that u has in this cell, and a neighbour of its tree there."""
        for d, rows, table in _cells_of(batches):
            lists = table.column("v")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            x = unit(lists.flatten().to_numpy().astype(np.float64).reshape(len(table), d))
            keys, t, g, m = sent.value[d].keys(x), rows["cell"] & 255, rows["g"], rows["m"]

            def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (g[a] == g[b])

            def all_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (x[a[:, 0]] @ x[b[0]].T >= threshold) & (g[a] == g[b])

            links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            for a, b in _pairs(rows, alike, all_alike):
                first = np.argmax(keys[a] == keys[b], axis=1) == t[a]  # a pair counts in the first table where it meets
                a, b = a[first], b[first]
                np.add.at(links, a, m[b])
                np.add.at(links, b, m[a])
                while len(a):
                    least = root.copy()
                    np.minimum.at(least, root[a], root[b])
                    np.minimum.at(least, root[b], root[a])
                    while (least[least] != least).any():
                        least = least[least]
                    root = least[root]
                    open_ = root[a] != root[b]
                    a, b = a[open_], b[open_]
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rows["vec_id"][at]), pa.array(links[at]), pa.array(rows["vec_id"][root[at]])], ["u", "links", "v"])

    def meeting(cells: DataFrame, what: DataFrame) -> DataFrame:
        """Rows of cells with what belongs to their vectors, in the order of cell, i and j; a row of a large cell comes once for each of its blocks."""
        hot = cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        met = cells.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        met = met.join(what, "vec_id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("blocks", "o")
        return met.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    cells = single.select("vec_id", "g", "v").mapInArrow(in_cells, "cell long, vec_id long")
    busy = cut(cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_not_alone, "cell long, vec_id long"))
    codes = single.select("vec_id", "v").mapInArrow(coded, "vec_id long, d int, code binary")
    near = cut(meeting(busy, codes).mapInArrow(screened, "cell long, vec_id long").distinct())
    found = cut(meeting(near, single.select("vec_id", "d", "g", "m", "v")).mapInArrow(linked, "u long, links long, v long"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("u", "v"))
    reps = single.select("a", "b", F.col("vec_id").alias("rep"), "m").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = marked.where("h IS NOT NULL").select("vec_id", "h.a", "h.b").join(reps, ["a", "b"])
    component = F.coalesce("component", "rep")
    named = named.select("vec_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
    alone = marked.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(alone)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows of each length of vectors, these normalised."""
    lists = batch.column("v")
    sizes = lists.value_lengths().to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        part = batch.take(pa.array(at))
        rows = {c: _numbers(part.column(c)) for c in batch.schema.names if c != "v"}
        rows["unit"] = unit(part.column("v").flatten().to_numpy().astype(np.float64).reshape(len(at), d))
        yield int(d), rows


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that share their cell with another; rows come by cell. Of a cell that is in progress, only the last row is held."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    listed = False  # whether the held row's cell has been seen before it
    for batch in batches:
        rows = tuple(batch.column(k).to_numpy() for k in range(2))
        if not len(rows[0]):
            continue
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        same = rows[0][1:] == rows[0][:-1]
        good = np.append(listed, same) | np.append(same, False)
        at = np.flatnonzero(good[:-1])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in rows], ["cell", "vec_id"])
        listed = bool(good[-1])
        held = tuple(x[-1:] for x in rows)
    if held is not None and listed:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["cell", "vec_id"])


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray], pa.Table]]:
    """Whole meetings of rows that come in the order of cell, i and j: their length of vectors, numbers and all columns."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        keys = np.column_stack([_numbers(table.column(c)) for c in ("cell", "i", "j")])
        last = int(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))[-1])
        if last:
            yield from _of_each_length(table.slice(0, last))
        held = table.slice(last)
    if held is not None and len(held):
        yield from _of_each_length(held)


def _of_each_length(table: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray], pa.Table]]:
    lengths = _numbers(table.column("d"))
    for d in np.unique(lengths):
        part = (table if (lengths == d).all() else table.filter(pa.array(lengths == d))).combine_chunks()
        yield int(d), {c: _numbers(part.column(c)) for c in part.schema.names if c not in ("v", "code")}, part


def _pairs(rows: dict[str, np.ndarray], hits: Callable, all_hits: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one meeting that hit: hits takes places of pairs, all_hits a column and a row of places. In a meeting of two blocks, a pair has one
    row of each.
    """
    keys = np.column_stack([rows[c] for c in ("cell", "i", "j")])
    head = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(keys))
    size = np.diff(head)
    second, two = rows["b"] == rows["j"], rows["i"] != rows["j"]

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ~two[a] | (second[a] != second[b])

    for s in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(s, 1)
        starts = head[:-1][size == s]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(starts), step):
            a, b = ((starts[k : k + step, None] + x).ravel() for x in (i, j))
            keep = apart(a, b)
            keep[keep] = hits(a[keep], b[keep])
            if keep.any():
                yield a[keep], b[keep]
    for start, s in zip(head[:-1][size > SMALL], size[size > SMALL], strict=True):
        for k in range(start, start + s, TILE):
            for other in range(k, start + s, TILE):
                a, b = np.arange(k, min(k + TILE, start + s))[:, None], np.arange(other, min(other + TILE, start + s))[None, :]
                hit = all_hits(a, b) & (a < b) & apart(a, b)
                if hit.any():
                    i, j = np.nonzero(hit)
                    yield a[i, 0], b[0, j]


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) >= 0.98 * a.n * b.n
), r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON c.x = vec_id
"""
