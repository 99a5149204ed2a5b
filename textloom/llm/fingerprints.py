"""Document fingerprints: bottom-k sketches of word shingle hashes, in SQL functions only.

A sketch is the k least distinct hashes of a text's runs of WIDTH words, ascending; a text with fewer words is one shingle, and a text without
words has an empty sketch. Sketches of parts merge to the sketch of the whole, and tell resemblance, containment and the number of distinct
shingles; sets of fewer than k shingles are in their sketch as a whole, so what it tells of them is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import GAP, partitions

WIDTH = 5
K = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text; null counts as empty."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)]))
        few = F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
        return F.when(F.size(w) >= WIDTH, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(words(text), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity: the part of the union's sketch that both sketches have. Two empty ones are alike."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles, exact below k."""
    rank = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has too; an empty a is in everything."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(rows: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """keys and the sketch of each group's union. Tasks drop repeated hashes and all but the k least before the shuffle."""
    single = rows.select(*keys, F.explode(sketch_col).alias("__h")).distinct()
    least = single.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__n") <= k)
    found = least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn(sketch_col, F.coalesce(sketch_col, F.array().cast("array<bigint>")))


def packed(a: Column) -> Column:
    """A sketch as text: its hashes, eight bytes each, in base 64. Equal sketches have equal texts, and unpacked() gives the sketch back to be merged or compared."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def unpacked(text: Column) -> Column:
    one = let(F.hex(F.unbase64(text)), lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 16).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 16 + 1, F.lit(16)), 16, -10).cast("long")))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(one)


#: Bytes of text that count as one more row where ranges of ids are made equal.
UNIT = 2048


def _range(id_col: Column, hash_col: Column, bounds: list[int]) -> Column:
    """The range of a row among those that ascending bounds make, by bisection. An id that is a bound several times has as many ranges, by its rows' hashes."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds])

    def place(strict: bool) -> Column:
        """Number of bounds below the id (strict) or up to it."""

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            at = F.get(table, mid)
            right = F.coalesce(at < id_col if strict else at <= id_col, F.lit(False)) & (s["lo"] < s["hi"])
            return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve)["lo"]

    share = (hash_col.cast("double") + 2.0**63) / 2.0**64
    pair = F.struct(place(True).alias("below"), place(False).alias("to"))
    return let(pair, lambda p: F.when(p["to"] - p["below"] > 1, F.least(p["to"], p["below"] + 1 + F.floor(share * (p["to"] - p["below"])).cast("int"))).otherwise(p["to"]))


def _salts(spark, n: int) -> list[int]:
    """For each of n partitions, a number whose hash leads there."""
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("salt")).withColumn("part", F.pmod(F.hash("salt"), F.lit(n)))
    found = {r.part: r.salt for r in rows.groupBy("part").agg(F.min("salt").alias("salt")).collect()}
    return [found.get(k, 0) for k in range(n)]


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, sketch of it as made here) with next_text and next_sketch, those of the next greater id; the first's after the last.

    Rows are dealt into as many ranges of ids as there are shuffle partitions, of about equal numbers of rows and bytes, each a partition. The first
    row of each range goes into the range before too, so one shuffle brings every row beside its next. Of equal ids, that with the smaller hash of the
    text comes first; an id with more rows than a range has several. Rows with a null id come last. Extra columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "text", F.xxhash64("text").alias("h"))
    weighed = keyed.select("k", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / UNIT).cast("int"))))
    bounds = weighed.agg(F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    dealt = keyed.withColumn("block", _range(F.col("k"), F.col("h"), sorted(bounds or [])))
    first = dealt.groupBy("block").agg(F.min(F.struct("k", "h")).alias("row"))
    heads = sorted((r.block, r.row.k, r.row.h) for r in first.collect())  # a row for each range
    guests = [(k, h, heads[i - 1][0]) for i, (_, k, h) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "k long, h long, before int") if guests else spark.createDataFrame([], "k long, h long, before int")
    dealt = dealt.join(F.broadcast(guests), ["k", "h"], "left")
    own = F.struct(F.lit(False).alias("guest"), F.col("block").alias("block"))
    guest = F.when(F.col("before").isNotNull(), F.struct(F.lit(True).alias("guest"), F.col("before").alias("block")))
    dealt = dealt.select("doc_id", "k", "h", "text", F.explode(F.array_compact(F.array(own, guest))).alias("at"))
    salt = F.get(F.array(*[F.lit(x) for x in _salts(spark, n)]), F.col("at.block"))
    placed = dealt.select("doc_id", "k", "h", "text", "at.guest", salt.alias("salt")).repartition(n, "salt").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("salt").orderBy("guest", "k", "h")
    led = placed.withColumn("__next", F.lead(F.struct("text", "sketch")).over(order)).where(~F.col("guest"))
    return led.select("doc_id", "text", "sketch", F.col("__next.text").alias("next_text"), F.col("__next.sketch").alias("next_sketch"))


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut_off = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut_off), F.substring(F.col("next_text"), F.lit(1), cut_off))
    led = led.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("sketch")).alias("fingerprint"), packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_distinct"), containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
    )
