"""Personal data: fixed formats, and what stands where such data stand, in SQL functions only.

Formats give e-mail addresses, IP addresses, payment cards and phone numbers. These are seeds of a bootstrap over lexical patterns: the two words
before a token, the one before it, the one after it. Other tokens with a digit are candidates. A graph of patterns and values is scored in rounds:
a pattern by the scores of the distinct values that it goes with, against their number and that of the plain words that it goes with; a candidate
by its patterns, seeds staying at 1. Candidates that go with patterns of enough seeds and a high score are found too, as what the pattern's seeds
mostly are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import GAP, cut
from textloom.llm.fingerprints import let

KINDS = ("email", "ip", "card", "phone")
#: Fixed formats. Lookbehinds and possessive loops keep matches the same and the search linear: a match could not start within a run either.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Whole chains of digits, each after a space or hyphen at most, of 14 to 19.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters, one for each kind, that take the place of found data where contexts are read; a text's own are replaced there.
MARKS = "\ufdd0\ufdd1\ufdd2\ufdd3"
#: Found data, or identifier-like: four characters at least, one of them a digit.
TOKEN = rf"([{MARKS}])\1*+|(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@._+-]{{3,}}(?<=[A-Za-z0-9])"
BEFORE_1 = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
BEFORE_2 = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
AFTER_1 = r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
#: Longer contexts are told by their digest.
MAX_CONTEXT = 100

ROUNDS = 3
#: Distinct seeds and score that a pattern needs.
MIN_SEEDS = 3
MIN_SCORE = 0.7
#: More patterns than these are joined by a shuffle.
MAX_BROADCAST_PATTERNS = 200_000
#: Characters of the pieces that a text is cut into to be read at any place.
CHUNK = 1024

_FOUND = "array<struct<start:int,end:int,value:string>>"
_TOKENS = "array<struct<start:int,end:int,kind:int,value:string,contexts:array<string>>>"


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of numbers from 0 on, those before it joined (added, say), 0 for the first. It goes by blocks of about the root of their number, as an array
    that grows in a fold is copied each time.
    """

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct(join(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: within(F.slice(v, k * width + 1, width)))
        done = let(blocks, lambda b: F.flatten(F.zip_with(b, within(F.transform(b, lambda x: x["at"]))["out"], lambda x, o: F.transform(x["out"], lambda y: join(y, o)))))
        return F.when(F.size(v) > 0, done).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def _split(text: Column, pattern: str) -> Column:
    return F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))


def _starts(x: Column) -> Column:
    """Where each match starts, of pieces and matches."""
    sizes = F.zip_with(F.slice(x["pieces"], 1, F.size(x["matches"])), x["matches"], lambda p, m: F.length(p) + F.length(m))
    return F.zip_with(before(sizes, lambda a, b: a + b), F.slice(x["pieces"], 1, F.size(x["matches"])), lambda s, p: s + F.length(p))


def found(text: Column, pattern: str) -> Column:
    """Matches from the left: start and end in code points and the match."""

    def places(x: Column) -> Column:
        rows = F.zip_with(_starts(x), x["matches"], lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
        return F.when(F.size(x["matches"]) > 0, rows).otherwise(F.array().cast(_FOUND))

    return let(_split(text, pattern), places)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b - 1 of a text that is cut into chunks, at a cost that doesn't grow with what stands before them."""
    some = F.array_join(F.slice(chunks, F.floor(a / CHUNK).cast("int") + 1, (F.floor((b - 1) / CHUNK) - F.floor(a / CHUNK)).cast("int") + 1), "")
    return F.when(b > a, F.substring(some, a % CHUNK + 1, b - a)).otherwise(F.lit(""))


def rewritten(text: Column, spans: Column, write: Callable[[Column, Column], Column]) -> Column:
    """text with its spans, ordered by start, replaced by write(span, length); spans that overlap are one, of which the first counts.

    Each span is read once and the text between spans is copied once, whatever their number.
    """

    def of(x: Column) -> Column:
        chunks, ahead, last = x["chunks"], x["ahead"], x["last"]
        paired = F.zip_with(spans, ahead, lambda s, m: F.struct(s.alias("s"), m.alias("m")))

        def join(heads: Column) -> Column:
            done = F.transform(heads, lambda h, i: F.concat(_part(chunks, h["m"], h["s"]["start"]), write(h["s"], F.coalesce(F.get(heads, i + 1)["m"], last) - h["s"]["start"])))
            return F.concat(F.array_join(done, ""), _part(chunks, last, x["size"]))

        return let(F.filter(paired, lambda p: p["s"]["start"] >= p["m"]), join)

    ends = F.transform(spans, lambda s: s["end"])
    facts = F.struct(
        _chunks(text).alias("chunks"), before(ends, lambda a, b: F.greatest(a, b)).alias("ahead"), F.array_max(ends).alias("last"), F.length(text).alias("size"),
    )
    return F.when(F.size(spans) > 0, let(facts, of)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def term(i: Column) -> Column:
            digit = F.substring(d, -1 - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, digit).otherwise(F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), term), F.lit(0), lambda s, x: s + x)

    return let(_digits(value), total) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        rest = F.regexp_replace(part, "^0+", "")
        return (F.length(rest) <= 3) & (F.when(F.length(rest).between(1, 3), rest).otherwise(F.lit("0")).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def formats(text: Column) -> dict[str, Column]:
    """Arrays of matches by kind; those that fail a kind's test are left out. Texts without a kind's marks aren't searched for it."""
    none = F.array().cast(_FOUND)

    def of(needs: Column, pattern: str, test: Callable[[Column], Column] | None = None) -> Column:
        matches = found(text, pattern)
        return F.when(needs, F.filter(matches, lambda m: test(m["value"])) if test else matches).otherwise(none)

    return {
        "email": of(F.contains(text, F.lit("@")), EMAIL),
        "ip": of(text.rlike(r"[0-9]\.[0-9]"), IP, _octets),
        "card": of(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, _luhn),
        "phone": of(F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
    }


def _tagged(matches: Column, rank: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def tokens(text: Column, base: Column) -> Column:
    """Found data and candidates, none of which overlap, with the patterns that they go with: the two words before, the word before and the word after.

    Words are lower-cased runs without white space; what is glued to a token is a word before it. Found data count as their kind in contexts. Of one
    unbroken run, no more than the last two tokens and what is about them is read.
    """
    marked = rewritten(F.translate(text, MARKS, "\ufffd" * len(MARKS)), base, lambda s, n: F.repeat(F.get(F.array(*[F.lit(m) for m in MARKS]), s["rank"]), n))

    def context(form: str, words: Column) -> Column:
        plain = F.regexp_replace(words, GAP, " ")
        return F.when(words != "", F.concat(F.lit(form + " "), F.when(F.length(plain) > MAX_CONTEXT, F.md5(plain)).otherwise(plain)))

    def of(x: Column) -> Column:
        pieces, matches = x["x"]["pieces"], x["x"]["matches"]

        def near(*parts: Column) -> Column:
            return F.lower(F.regexp_replace(F.concat_ws("", *parts), rf"([{MARKS}])\1++", "$1"))

        def one(start: Column, i: Column) -> Column:
            match = F.get(matches, i)
            sides = F.struct(
                near(F.get(pieces, i - 2), F.get(matches, i - 2), F.get(pieces, i - 1), F.get(matches, i - 1), F.get(pieces, i)).alias("left"),
                near(F.get(pieces, i + 1), F.get(matches, i + 1), F.get(pieces, i + 2)).alias("right"),
            )
            patterns = let(sides, lambda s: F.array_compact(F.array(
                context("2", F.regexp_extract(s["left"], BEFORE_2, 1)), context("1", F.regexp_extract(s["left"], BEFORE_1, 1)), context("3", F.regexp_extract(s["right"], AFTER_1, 1)),
            )))
            kind = F.instr(F.lit(MARKS), F.substring(match, 1, 1)) - 1
            value = F.when(kind < 0, match).otherwise(_part(x["chunks"], start, start + F.length(match)))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), kind.alias("kind"), F.lower(value).alias("value"), patterns.alias("contexts"))

        return F.when(F.size(matches) > 0, F.transform(x["starts"], one)).otherwise(F.array().cast(_TOKENS))

    chunks = F.when(F.size(base) > 0, _chunks(text)).otherwise(F.array().cast("array<string>"))
    split = let(_split(marked, TOKEN), lambda x: F.struct(x.alias("x"), _starts(x).alias("starts"), chunks.alias("chunks")))
    return F.when((F.size(base) > 0) | text.rlike("[0-9]"), let(split, of)).otherwise(F.array().cast(_TOKENS))


def surveyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, an array of matches for each kind, base (all of them in order) and tokens. Kept, as each text is searched once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in formats(F.col("text")).items()])
    rows = rows.withColumn("base", F.sort_array(F.concat(*[_tagged(F.col(k), n, k) for n, k in enumerate(KINDS)])))
    rows = rows.withColumn("tokens", tokens(F.col("text"), F.col("base")))
    return cut(rows.drop("text").withColumn("row", F.monotonically_increasing_id()))


def occurrences(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(pattern, seen): how often the words of the wanted patterns have another word at the pattern's place."""
    words = F.split(F.lower(F.col(text_col)), GAP, -1)
    rows = docs.where(F.col(text_col).isNotNull()).select(words.alias("w"))
    rows = rows.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("p")).select("p.a", "p.b").where("b IS NOT NULL AND b <> ''")
    keys = rows.select(F.explode(F.array(F.concat(F.lit("1 "), "a"), F.concat(F.lit("3 "), "b"), F.concat(F.lit("2 "), "a", F.lit(" "), "b"))).alias("pattern"))
    if wanted.count() <= MAX_BROADCAST_PATTERNS:
        wanted = F.broadcast(wanted)
    return keys.join(wanted, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("seen"))


def patterns(survey: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, kind, confidence) of the patterns that tell personal data, from a surveyed table and its documents."""
    rows = survey.select(F.explode("tokens").alias("t")).select(F.explode("t.contexts").alias("pattern"), F.col("t.value").alias("value"), F.col("t.kind").alias("kind"))
    # One row for each pattern and value: tasks combine copies before the shuffle.
    edges = cut(rows.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.count("*").alias("n")))
    counts = [F.struct(F.sum((F.col("kind") == k).cast("int")).alias("n"), F.lit(-k).alias("first"), F.lit(k).alias("kind")) for k in range(len(KINDS))]
    known = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("tokens"), F.sum((F.col("kind") >= 0).cast("int")).alias("seeds"), F.greatest(*counts).alias("most"))
    known = cut(known.where(F.col("seeds") >= MIN_SEEDS))
    if not known.limit(1).count():
        return known.select("pattern", F.lit("").alias("kind"), F.lit(0.0).alias("confidence"))
    plain = F.greatest(F.lit(0), F.coalesce("seen", F.lit(0)) - F.col("tokens"))
    known = cut(known.join(occurrences(docs, known.select("pattern"), text_col), "pattern", "left").withColumn("all", F.col("values") + plain + 1).select("pattern", "seeds", F.col("most.kind").alias("kind"), "all"))
    edges = edges.join(known.select("pattern"), "pattern", "left_semi")
    edges = cut(edges.select("pattern", "value", "kind", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0).alias("score")))
    for k in range(ROUNDS + 1):
        total = edges.groupBy("pattern").agg(F.sum("score").alias("total"))
        scored = known.join(total, "pattern").select("pattern", "seeds", "kind", (F.col("total") / F.col("all")).alias("confidence"))
        if k == ROUNDS:
            break
        better = edges.where("kind < 0").join(scored.select("pattern", "confidence"), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("better"))
        edges = cut(edges.join(better, "value", "left").select("pattern", "value", "kind", F.when(F.col("kind") >= 0, 1.0).otherwise(F.coalesce("better", F.lit(0.0))).alias("score")))
    good = scored.where((F.col("confidence") >= MIN_SCORE) & (F.col("seeds") >= MIN_SEEDS))
    return good.select("pattern", F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("kind"), "confidence")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, base, spans): matches of each kind, all of them, and all with what patterns found; a row for each of docs.

    A span has a start, an end (exclusive) in code points and a kind; spans are ordered by start, kind and end. A null text is empty and has none.
    Repeated rows have the same spans, and rows without an id are rows as any other. Other columns are ignored.
    """
    rows = surveyed(docs, id_col, text_col)
    loose = rows.select("row", F.explode(F.filter("tokens", lambda t: t["kind"] < 0)).alias("t")).select("row", "t.start", "t.end", F.explode("t.contexts").alias("pattern"))
    more = loose.join(patterns(rows, docs, text_col), "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    kind = F.col("best.kind")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int") - 1
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), kind.alias("kind"), "end")).alias("more"))
    both = rows.drop("tokens").join(more, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.coalesce("more", F.col("base")))))
    return both.select("doc_id", *KINDS, "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with spans, ordered by start, replaced by their kind in brackets; of spans that overlap, the first tells the kind."""
    return rewritten(text, spans, lambda s, n: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    rows = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
