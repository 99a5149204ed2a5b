"""Language ID by compression: the language whose raw-content zstandard dictionary makes a text smallest.

Texts are lower-cased and everything but letters becomes single spaces, so case, digits, symbols and markup tell nothing. A dictionary is
plain text of one language; what it shares with a text costs only references. Sizes that lie near each other tell little: such texts are
rejected. Texts to judge are compressed whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import extended

#: Bound of the training sample: different texts of each language, and characters that each gives to the dictionary, from a place anywhere in the
#: text that its hash tells. A dictionary holds all of these, so it has SAMPLE_DOCS * (STRETCH + 1) characters at most.
SAMPLE_DOCS = 160
STRETCH = 1024
SPARE = 8
LEVEL = 6
#: A text is rejected where the second smallest size is above the smallest by less than this part of it.
MIN_MARGIN = 0.002
UNDETERMINED = "und"
#: Margin at which the score is about 0.82.
SCALE = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, most common first, from a bounded sample: of each language the SAMPLE_DOCS different texts least by a hash,
    STRETCH characters of each. Null texts, texts without a letter and null languages teach nothing; copies of a text count once, whatever their ids.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("o"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("o").alias("kinds")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    stretches: dict[str, list[str]] = {}
    whole = False
    while left := [r for r in counts if r.lang not in stretches]:
        # Of each language, texts least by the hash are looked at, about SPARE times as many as the sample takes, or all where none of these is there.
        part = {r.lang: 1.0 if whole else min(1.0, SPARE * SAMPLE_DOCS / r.kinds) for r in left}
        parts = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])
        some = rows.where((F.col("o").cast("double") + 2.0**63) / 2.0**64 <= F.coalesce(parts[F.col("lang")], F.lit(-1.0)))
        start = F.pmod(F.xxhash64("o"), F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
        some = some.select("lang", "o", F.substring("text", start, F.lit(STRETCH)).alias("t")).groupBy("lang", "o").agg(F.min("t").alias("t"))
        first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "t"))).where(F.col("n") <= SAMPLE_DOCS)
        for r in sorted(first.collect(), key=lambda r: r.n):
            stretches.setdefault(r.lang, []).append(plain(r.t))
        if whole:
            break
        whole = True
    return {r.lang: (" " + joined).encode() for r in counts if (joined := " ".join(t for t in stretches.get(r.lang, ()) if t))}


class Classifier:
    """Compressors by language, built once for each worker process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        known = plain(text) if text else ""
        if not any(map(str.isalpha, known)) or not self.languages:
            return UNDETERMINED, 0.0, True
        data = f" {known} ".encode()
        sizes = [len(c.compress(data)) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        margin = min(s for i, s in enumerate(sizes) if i != best) / sizes[best] - 1
        return self.languages[best], 1 - 0.5 * math.exp(-margin / SCALE), margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to docs, from the text alone.

    Null texts and those without a letter are "und", score 0, rejected. Of languages equally near, the most common wins, and the text is
    rejected. Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # 4 * SAMPLE_DOCS * (STRETCH + 1) bytes a language at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(predict, extended(docs.schema, lang_pred="string", score="double", rejected="boolean"))


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(F.coalesce(fold("doc_id", 5) != 0, F.lit(True))))
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
