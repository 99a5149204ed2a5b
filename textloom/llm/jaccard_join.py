"""Exact Jaccard join of word shingle sets, with skips that relations between sets allow.

Sets are ordered by (very common, hash) of their shingles, and two sets that are alike share one of their first n - ceil(T n) + 1 shingles, so
these go to inverted lists. Sets' relations then save most comparisons:

* Equal sets are one set, whose copies take over its answer.
* A list is ordered by set size. In a first round each of its sets meets only the next one, or a few; links found so make groups of highly similar sets.
* In the second round the sets of a group derive their answers from one another: only sets of different groups meet. Lists are in blocks that
  know their sizes, least positions and groups, and a pair of blocks is skipped as a whole where these leave no pair to compare: sizes too far
  apart, too little left after the positions, or one group. Parity bits of the sets, which bound what two of them can share, screen the pairs that meet.

Pairs that pass are compared in full, so links are exact (up to equal 64-bit hashes of different shingles). What is returned, components, needs
no more: pairs within a group could only join what is joined already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import batches_of_text, connected_components, cut, mix, partitions, sequence_hashes, with_key, words_of

WIDTH = 5
#: The threshold as a fraction.
NUM, DEN = 3, 4
#: A shingle is common if so many different sets of one batch have it; the most common of them are listed up to a bound that limits the broadcast
#: (8 bytes each). The list only orders shingles: results are the same with any.
COMMON = 3
MAX_COMMON = 1 << 19
#: Most ids that are broadcast (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
BLOCK = 64
#: Parts in which a batch's shingles are counted.
PARTS = 16
#: In the first round, a set of a list of LONG sets or more meets the next REACH if the list is one of FAR_LISTS (as sets of a large group share many
#: lists), and else only the next. As many chances as REACH join nearly all sets of a large group even where few of its pairs are alike, which
#: leaves the second round little; that finds whatever the first has left.
LONG, REACH, FAR_LISTS = 64, 32, 4
#: Pairs of a set that the first round compares in full.
TRIES = 5


def needed(a, b):
    """Least intersection of sets of sizes a and b whose Jaccard similarity reaches the threshold."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, row after the last, all sets' shingle hashes one after the other, each ascending, and where each set starts."""
    for at, to, data, starts, ends in batches_of_text(batch, "text"):
        _, _, hashes, before = words_of(data, starts, ends, fold=True)
        n_words = np.diff(before)
        doc = np.repeat(np.arange(to - at), n_words)
        wide = sequence_hashes(hashes, WIDTH)
        inside = doc[: len(wide)] == doc[WIDTH - 1 :] if len(wide) else np.zeros(0, dtype=bool)
        values, owner = wide[inside], doc[: len(wide)][inside]
        short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
        if len(short):
            more = [sequence_hashes(hashes[before[k] : before[k + 1]], int(n_words[k])) for k in short]
            values, owner = np.concatenate([values, *more]), np.append(owner, short)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        if len(values):
            new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))
            values, owner = values[new], owner[new]
        yield at, to, values, np.searchsorted(owner, np.arange(to - at + 1))


def _prefix(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-NUM * sizes // DEN) + 1, 0)


def _take(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[i] .. start[i] + count[i] - 1 of all i, and i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[owner], owner


SURVEY = ["shingle", "doc_id", "n", "k1", "k2", "bits"]


def _parities(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Of each set, whether the number of hashes with the same low bits is odd, for each value of these: two to four bits a shingle."""
    width = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spots = start[owner] + (values.astype(np.int64) & (width[owner] - 1))
    packed = np.packbits(np.bincount(spots, minlength=start[-1]) & 1 == 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((start // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def most_shared(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> int:
    """A bound of the intersection of two sets from their sizes and parities: each parity that differs takes a shingle that only one set has."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(a ^ b).sum())) // 2


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (null, doc_id, size, two hashes and the parities of the set) for each document, a row (shingle, sets that have it) for each common shingle."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        all_shingles: list[np.ndarray] = []
        known: set[int] = set()
        for at, to, values, start in _sets(batch):
            sizes = np.diff(start)
            sums = [np.append(0, np.cumsum(mix(values ^ np.uint64(salt)))).astype(np.uint64) for salt in (0x51ED270B9F3C6D15, 0x2545F4914F6CDD1D)]
            keys = [pa.array((s[start[1:]] - s[start[:-1]]).view(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.nulls(to - at, pa.int64()), pa.array(ids[at:to]), pa.array(sizes.astype(np.int64)), *keys, _parities(values, sizes)], SURVEY)
            other = [k for k, key in enumerate(keys[0].to_pylist()) if key not in known and not known.add(key)]
            all_shingles.append(values[_take(start[other], sizes[other])[0]])
        for part in range(PARTS if all_shingles else 0):  # by the hashes' last bits, which keeps the sorted copies small
            own = np.concatenate([x[x % PARTS == part] for x in all_shingles])
            shingle, count = np.unique(own, return_counts=True)
            shingle, count = shingle[count >= COMMON], count[count >= COMMON].astype(np.int64)
            none = pa.nulls(len(shingle), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), none, pa.array(count), none, none, pa.nulls(len(shingle), pa.binary())], SURVEY)


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Columns of runs of whole lists, and where each list starts, with the end; rows come by list."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in _and_end(batches):
        if batch is not None:
            rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            if not len(rows[0]):
                continue
            held.append(rows)
            if held[0][0][0] == rows[0][-1]:
                continue  # all one list so far
        if not held:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
        head = np.append(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])), len(rows[0]))
        stop = head[-1] if batch is None else head[-2]
        held = [tuple(x[stop:] for x in rows)] if stop < len(rows[0]) else []
        if stop:
            yield tuple(x[:stop] for x in rows), head[head <= stop]


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists with two sets or more; rows come by shingle. Of a list that is in progress, only the last row is held."""
    held: tuple[np.ndarray, ...] | None = None
    held_listed = False  # whether the row before the held one is of its list
    for batch in _and_end(batches):
        rows = held
        if batch is not None:
            new = tuple(batch.column(k).to_numpy() for k in range(3))
            rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if rows is None or not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        listed = np.append(same, False) | np.append(held_listed, same)
        stop = len(listed) - (batch is not None)
        out = np.flatnonzero(listed[:stop])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], ["shingle", "doc_id", "place"])
        held = tuple(x[-1:] for x in rows)
        held_listed = bool(same[-1]) if len(same) else held_listed


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])


def _apart(head: np.ndarray, picked: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each distance up to most: rows of the picked lists that have another so far behind in their list."""
    size = np.diff(head)
    left = np.repeat(head[1:], size) - 1 - np.arange(head[-1])  # rows behind each in its list
    rows = np.flatnonzero(np.repeat(picked, size) & (left > 0))
    for k in range(1, most + 1):
        rows = rows[left[rows] >= k]
        if not len(rows):
            return
        yield rows, k


def _nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each set and the next of its list, in some long lists the next REACH; rows come by shingle, size and id."""
    for (shingle, doc, place), head in _whole_lists(batches):
        n = place >> 32
        left = n - (place & 0xFFFFFFFF)
        far = (np.diff(head) >= LONG) & (shingle[head[:-1]] % FAR_LISTS == 0)
        for picked, most in ((~far, 1), (far, REACH)):
            for at, k in _apart(head, picked, most):
                at = at[np.minimum(left[at], left[at + k]) >= needed(n[at], n[at + k])]
                if len(at):
                    yield _pairs(doc[at], doc[at + k])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists that have sets of several groups: pairs of different groups of those shorter than LONG, and rows of the others. Rows come by
    shingle, size and id."""
    names = ["u", "v", "shingle", "doc_id", "place", "group"]
    for (shingle, doc, place, group), head in _whole_lists(batches):
        size = np.diff(head)
        several = np.minimum.reduceat(group, head[:-1]) != np.maximum.reduceat(group, head[:-1])
        n = place >> 32
        left = n - (place & 0xFFFFFFFF)
        for at, k in _apart(head, several & (size < LONG), LONG):
            at = at[(np.minimum(left[at], left[at + k]) >= needed(n[at], n[at + k])) & (group[at] != group[at + k])]
            if len(at):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([*_pairs(doc[at], doc[at + k]).columns, none, none, none, none], names)
        rows = np.flatnonzero(np.repeat(several & (size >= LONG), size))
        if len(rows):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *[pa.array(x[rows]) for x in (shingle, doc, place, group)]], names)


def _folded(bits: list[bytes]) -> np.ndarray:
    """Parities as rows of equal length, the shortest one's."""
    width = min(map(len, bits))
    out = np.empty((len(bits), width // 8), dtype=np.uint64)
    for k, x in enumerate(bits):
        row = np.frombuffer(x, dtype=np.uint64)
        while len(row) > width // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of different groups that a list has and that can be alike; rows come by shingle, size and id."""
    for columns, starts in _whole_lists(batches):
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            yield from _across_list(*[x[a:z] for x in columns[1:]])


def _across_list(doc: np.ndarray, place: np.ndarray, group: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = place >> 32
    left = n - (place & 0xFFFFFFFF)  # at the first shingle that two sets share, they can share no more than this
    head = np.arange(0, len(n), BLOCK)
    low, high = n[head], np.maximum.reduceat(n, head)
    most_left = np.maximum.reduceat(left, head)
    one = np.minimum.reduceat(group, head) == np.maximum.reduceat(group, head)
    parities = [_folded(bits[a : a + BLOCK]) for a in head]
    for k, a in enumerate(head):
        # Blocks from this one on: near enough in size, enough left, not both of one group.
        others = np.arange(k, np.searchsorted(low, DEN * high[k] // NUM, side="right"))
        bound = np.minimum(most_left[others], most_left[k])
        others = others[(bound >= needed(low[others], low[k])) & ~(one[k] & one[others] & (group[head[others]] == group[a]))]
        mine = np.arange(a, min(a + BLOCK, len(n)))
        for other in others:
            theirs = np.arange(head[other], min(head[other] + BLOCK, len(n)))
            least = needed(n[mine][:, None], n[theirs][None, :])
            meet = (theirs[None, :] > mine[:, None]) & (group[mine][:, None] != group[theirs][None, :])
            meet &= np.minimum(left[mine][:, None], left[theirs][None, :]) >= least
            i, j = np.nonzero(meet)
            if not len(i):
                continue
            p, q = parities[k], parities[other]
            while p.shape[1] > q.shape[1]:
                p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
            while q.shape[1] > p.shape[1]:
                q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
            shared = (n[mine[i]] + n[theirs[j]] - np.bitwise_count(p[i] ^ q[j]).sum(axis=1, dtype=np.int64)) // 2
            keep = shared >= least[i, j]
            if keep.any():
                yield _pairs(doc[mine[i[keep]]], doc[theirs[j[keep]]])


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with a table of ids that's kept; broadcast where these are few."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how)


def _screened(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those of pairs (u, v) that sizes and parities leave possible."""
    known = [sizes.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv"]
    both = pairs.join(known[0], "u").join(known[1], "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_u, n_v = (batch.column(k).to_pylist() for k in ("n_u", "n_v"))
            bits_u, bits_v = ([np.frombuffer(x, dtype=np.uint8) for x in batch.column(k).to_pylist()] for k in ("bits_u", "bits_v"))
            keep = [most_shared(a, b, x, y) >= needed(a, b) for a, b, x, y in zip(n_u, n_v, bits_u, bits_v, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(possible, "u long, v long").distinct())


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets are alike. pairs is kept and distinct."""
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, values, start in _sets(batch):
                sets = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((start * 8).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), sets], ["doc_id", "hashes"])

    sets = _with_ids(docs, ids, "left_semi").select("doc_id", "text").mapInArrow(whole, "doc_id long, hashes binary")
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b")), "v")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
                both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                found.append(both >= needed(len(a), len(b)))
            yield batch.select(["u", "v"]).filter(pa.array(found, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs: the size of each document's set and the least id that links reach, its own included.

    A set holds the runs of WIDTH words, A-Z lower-cased; a text with fewer words is one shingle, a text without words (or null) has an empty
    set and links with nothing. Ids should be unique: rows with one id are linked where both have sets. Rows without an id link with nothing, and their
    component_id is null. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = docs.where("doc_id IS NULL").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_survey, "shingle long, doc_id long, n long, k1 long, k2 long, bits binary")
    nothing = F.lit(None).cast("long")
    lost = lost.where("shingle IS NULL").select(nothing.alias("doc_id"), F.col("n").alias("n_shingles"), nothing.alias("component_id"))
    docs = docs.where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    n = partitions(spark)
    seen = cut(docs.mapInArrow(_survey, "shingle long, doc_id long, n long, k1 long, k2 long, bits binary"))
    sizes = seen.where("shingle IS NULL").drop("shingle")
    counted = cut(seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # The least level from which on no more than MAX_COMMON are listed; levels are few, whatever the corpus, and so is what reaches the driver.
    lowest, left = None, MAX_COMMON
    for r in counted.groupBy("level").agg(F.count("*").alias("many")).orderBy(F.desc("level")).collect():
        left -= r.many
        if left < 0:
            break
        lowest = r.level
    common = counted.where(F.col("level") >= lowest) if lowest is not None else counted.limit(0)
    last = spark.sparkContext.broadcast(np.sort(common.select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64)))

    equal = sizes.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    copies = cut(sizes.where("n > 0").join(equal, ["k1", "k2"]).where("doc_id <> least").select("doc_id", "least"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for at, _, values, start in _sets(batch):
                sizes = np.diff(start)
                if len(last.value) and len(values):
                    spot = np.minimum(np.searchsorted(last.value, values), len(last.value) - 1)
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    values = values[np.lexsort((values, last.value[spot] == values, owner))]
                spots, owner = _take(start[:-1], _prefix(sizes))
                place = sizes[owner] << 32 | spots - start[owner]
                yield pa.RecordBatch.from_arrays([pa.array(values[spots].view(np.int64)), pa.array(ids[at + owner]), pa.array(place)], ["shingle", "doc_id", "place"])

    rows = _with_ids(docs, copies.select("doc_id").distinct(), "left_anti").select("doc_id", "text").mapInArrow(listed, "shingle long, doc_id long, place long")
    in_order = [F.col("shingle"), F.shiftright("place", 32), F.col("doc_id")]
    lists = cut(rows.repartition(n, "shingle").sortWithinPartitions(*in_order).mapInArrow(_in_lists, "shingle long, doc_id long, place long"))

    near = _screened(lists.mapInArrow(_nearby, "u long, v long").where("u <> v").distinct(), sizes)  # kept lists are still in order
    # TRIES of each set's pairs are nearly sure to join what all would; the second round meets the others again, if they still matter.
    tried = near.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))).where(F.col("k") <= TRIES).select("u", "v")
    tried = cut(tried)
    groups = cut(connected_components(cut(_verified(docs, tried))))
    grouped = lists.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("shingle", "doc_id", "place", F.coalesce("component", "doc_id").alias("group"))
    mixed = cut(grouped.repartition(n, "shingle").sortWithinPartitions(*in_order).mapInArrow(_mixed, "u long, v long, shingle long, doc_id long, place long, group long"))
    long = mixed.where("u IS NULL").join(sizes.select("doc_id", "bits"), "doc_id").select("shingle", "doc_id", "place", "group", "bits")
    long = long.repartition(n, "shingle").sortWithinPartitions(*in_order).mapInArrow(_across, "u long, v long")
    pairs = _screened(mixed.where("u IS NOT NULL").select("u", "v").distinct(), sizes).unionByName(long).distinct().join(tried, ["u", "v"], "left_anti")
    more = _verified(docs, cut(pairs))

    # Groups that the second round joins, then sets' groups, then copies' sets.
    of_group = groups.select("node", "component")
    bridges = more.join(of_group.select(F.col("node").alias("u"), F.col("component").alias("a")), "u", "left").join(of_group.select(F.col("node").alias("v"), F.col("component").alias("b")), "v", "left")
    joined = connected_components(bridges.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
    set_of = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(copies, "doc_id", "left").withColumn("set", F.coalesce("least", "doc_id"))
    named = set_of.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("group", F.coalesce("component", "set")).drop("component")
    named = named.join(joined.withColumnRenamed("node", "group"), "group", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "group").alias("component_id")).unionByName(lost)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each group of near duplicates, with all its columns; rows without words stay. Rows with one id are documents of
    their own, as are those without an id, which come last.
    """
    keyed, key = with_key(docs, id_col)
    groups = components(keyed, key, text_col)
    if key == id_col:
        return keyed.join(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), key, "left_anti")
    named = groups.join(keyed.select(F.col(key).alias("doc_id"), F.col(id_col).alias("id")), "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id"))["doc_id"].alias(key))
    return keyed.join(first.select(key), key, "left_semi").drop(key)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY 1, 2
"""
