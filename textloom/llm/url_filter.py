"""URL rules by Bloom filter cascades.

Levels of a cascade alternate: the first encodes the listed keys, the second those keys of the corpus that the first takes for listed, the
third those listed keys that the second takes for unlisted, and so on until a level makes no mistake. As the cascade is built over all keys
that the corpus can ask for, its answers for these are exact, and judging a URL needs no join.

A first cascade tells which hosts of a URL (its own and those it is a subdomain of) have rules at all; only for these are the starts of its path asked of the
second ones. Keys are 64-bit hashes: that one of u unlisted keys of the corpus has the hash of one of r listed ones, and so is taken for it, has a chance
of u * r / 2**64 (5 in 10,000 for ten billion keys and a million rules).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, extended, mix

#: Listed keys that are held by the driver and, some bits each, by every worker; above it, build() refuses.
MAX_LISTED = 5_000_000
MAX_LEVELS = 64


class Level:
    def __init__(self, bits: np.ndarray, n_bits: int, n_hashes: int, salt: int):
        self.bits, self.n_bits, self.n_hashes, self.salt = bits, n_bits, n_hashes, salt

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in places(keys, self.n_bits, self.n_hashes, self.salt):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def places(keys: np.ndarray, n_bits: int, n_hashes: int, salt: int) -> Iterator[np.ndarray]:
    """The bits of each 64-bit key, one array for each hash function."""
    a = mix(keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(a + np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for _ in range(n_hashes):
        yield a % np.uint64(n_bits)
        a = a + b


def contains(levels: Sequence[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that lacks it."""
    out = np.zeros(len(keys), dtype=bool)
    left = np.arange(len(keys))
    for k, level in enumerate(levels):
        has = level.has(keys[left])
        out[left[~has]] = k % 2 == 1
        left = left[has]
        if not len(left):
            return out
    out[left] = len(levels) % 2 == 1
    return out


def _level(keys: np.ndarray, rate: float, salt: int) -> Level:
    """A filter of keys with so low a rate of mistakes."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_bits = max(64, math.ceil(len(keys) * 1.4427 * -math.log2(rate)))
    bits = np.zeros(-(-n_bits // 64), dtype=np.uint64)
    for at in places(keys, n_bits, n_hashes, salt):
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return Level(bits, n_bits, n_hashes, salt)


def build(lists: Sequence[np.ndarray], universe: DataFrame) -> list[list[Level]]:
    """A cascade for each list of keys, exact on the keys of universe (key long), which is distinct.

    The first level's rate of mistakes is about listed / universe, so about as many keys pass it by mistake as are listed; one pass over the
    universe by the executors finds these. Later levels have half as many each and are made from these two sets: in all about
    1.44 log2(universe / listed) + 5 bits for each listed key, whatever the size of the corpus.
    Raises OverflowError where more than MAX_LISTED keys are listed, and ValueError where keys can't be told apart.
    """
    if sum(map(len, lists)) > MAX_LISTED:
        raise OverflowError(f"more than {MAX_LISTED} keys are listed")
    n_all = universe.count()
    cascades = [[_level(keys, min(0.5, len(keys) / max(1, n_all)), 1)] if len(keys) else [] for keys in lists]
    sent = universe.sparkSession.sparkContext.broadcast([levels[:1] for levels in cascades])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for which, levels in enumerate(sent.value):
                if levels and len(found := keys[levels[0].has(keys)]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), which, dtype=np.int32)), pa.array(found.view(np.int64))], ["which", "key"])

    passed = cut(universe.mapInArrow(passing, "which int, key long"))  # listed keys and about as many mistakes
    if passed.count() > 64 + 4 * MAX_LISTED:
        raise OverflowError("too many keys pass the first level")
    table = passed.toPandas()
    for which, (levels, keys) in enumerate(zip(cascades, lists, strict=True)):
        if not levels:
            continue
        listed = np.unique(keys)
        found = table["key"][table["which"] == which].to_numpy(dtype=np.int64).view(np.uint64)
        sides = [listed, np.setdiff1d(found, listed)]
        while len(wrong := sides[len(levels) % 2][levels[-1].has(sides[len(levels) % 2])]):
            if len(levels) == MAX_LEVELS:
                raise ValueError("listed and other keys share hashes")
            sides[len(levels) % 2] = wrong
            levels.append(_level(wrong, 0.5, len(levels) + 1))
    return cascades


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, lower).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all that it is a subdomain of."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidate_rules(hosts: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Texts of all rules that could fit, the longest first (of two as long, that with the longer host)."""
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.length(path) >= n)
    made = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.struct((F.length(h) + n).alias("n"), F.length(h).alias("h"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.sort_array(made, asc=False), lambda x: x["key"])


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to urls.

    rules: (allow or block, host, path), the path empty or any start of paths. A rule fits its host and all subdomains where the URL's
    path starts with the rule's; the longest that fits decides. A URL that fits none has a null rule and the verdict otherwise.
    Null URLs and those without :// have an empty host and path and fit no rule. Repeated rows are judged alike; an empty table gives none.
    Columns of urls named like the four results are replaced.
    """
    spark = urls.sparkSession
    urls = urls.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url_col))
    lengths = sorted({len(p) for _, _, p in rules})
    parted = urls.withColumn("host", host).withColumn("path", path)
    if not rules:
        return parted.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    keys = spark.createDataFrame([(k, h, h + p) for k, h, p in rules], "kind string, host string, rule string").select("kind", F.xxhash64("host").alias("host"), F.xxhash64("rule").alias("key")).collect()

    def hashes(of: str, kind: str | None = None) -> np.ndarray:
        return np.array(sorted({r[of] % 2**64 for r in keys if kind in (None, r.kind)}), dtype=np.uint64)

    def hashed(column: str) -> Column:
        return F.transform(column, lambda k: F.xxhash64(k))

    asked = parted.withColumn("__hosts", suffixes(F.col("host"))).withColumn("__asked", hashed("__hosts"))
    of_hosts = build([hashes("host")], cut(asked.select(F.explode("__asked").alias("key")).distinct()))
    sent_hosts = spark.sparkContext.broadcast(of_hosts)  # bits for MAX_LISTED keys at most, as all cascades

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each host asked for, whether it has rules."""
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__asked"))
            listed = pa.array(contains(sent_hosts.value[0], lists.flatten().to_numpy().view(np.uint64)))
            offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, listed)], [*batch.schema.names, "__listed"])

    some = asked.mapInArrow(known, extended(asked.schema, __listed="array<boolean>"))
    some = some.withColumn("__hosts", F.filter("__hosts", lambda h, i: F.get("__listed", i))).drop("__asked", "__listed")
    given = some.withColumn("__keys", candidate_rules(F.col("__hosts"), F.col("path"), lengths)).drop("__hosts").withColumn("__hashes", hashed("__keys"))
    universe = cut(given.select(F.explode("__hashes").alias("key")).distinct())
    sent = spark.sparkContext.broadcast(build([hashes("key", kind) for kind in ("allow", "block")], universe))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place from 1 of the first listed key, and whether it's allowed."""
        allow, block = sent.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__hashes"))
            asked_for = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            allowed = contains(allow, asked_for) if allow else np.zeros(len(asked_for), dtype=bool)
            listed = allowed | contains(block, asked_for) if block else allowed
            at = np.flatnonzero(listed)
            rows, first = np.unique(row[at], return_index=True)
            start = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            place, good = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=bool)
            place[rows] = at[first] - start[rows] + 1
            good[rows] = allowed[at[first]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(good)], [*batch.schema.names, "__place", "__good"])

    found = given.mapInArrow(hits, extended(given.schema, __place="int", __good="boolean"))
    return found.select(
        *urls.columns, "host", "path",
        F.when(F.col("__place") > 0, F.element_at("__keys", F.greatest("__place", F.lit(1)))).alias("rule"),
        F.when(F.col("__place") == 0, F.lit(otherwise)).when(F.col("__good"), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"),
    )


#: Fixed values of the query: the kind, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN coalesce(contains(url, '://'), false) THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), rules(kind, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT page_id, rhost || rpath AS rule, kind,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM h LEFT JOIN fit ON fit.page_id = h.page_id AND n = 1
"""
