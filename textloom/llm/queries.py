"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from textloom.llm.fingerprints import op5_fingerprints
from textloom.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from textloom.llm.language_id import op4_language_id
from textloom.llm.mixing import op2_mix_sources
from textloom.llm.personal_data import op9_personal_data
from textloom.llm.pieces import op3_pieces
from textloom.llm.quality import op8_quality
from textloom.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from textloom.llm.url_filter import OP10_SQL, op10_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_pieces": op3_pieces,
        "op4_language_id": op4_language_id,
        "op5_fingerprints": op5_fingerprints,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_quality": op8_quality,
        "op9_personal_data": op9_personal_data,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op6_embedding_dedup": OP6_SQL,
        "op7_jaccard_join": OP7_SQL,
        "op10_url_filter": OP10_SQL,
    }
