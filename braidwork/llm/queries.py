"""The queries of the problems tagged llm: 4, 5, 6, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm.encode import decode_corpus, encode_corpus
from braidwork.llm.leakage import leaked_items
from braidwork.llm.linkage import REGISTERS, linked_records
from braidwork.llm.readability import reading_levels
from braidwork.llm.spellings import customer_spaces, variant_spellings
from braidwork.llm.survivors import survivors
from braidwork.session import cut, read_table


def _registers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, d, t) for t in REGISTERS}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_records(_registers(spark, d)).select("rec_a", "rec_b")


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linked_records(_registers(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(_registers(spark, d)).select("src_table", "rec_id")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return survivors(_registers(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_spellings(customer_spaces(_registers(spark, d)))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read_table(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(cut(encode_corpus(read_table(spark, d, "documents"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "level_labels")).select("doc_id", "level")


QUERIES = {"p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p5_values": p5_values, "p6_found": p6_found, "p8_ids": p8_ids, "p8_text": p8_text, "p9_found": p9_found, "p10_found": p10_found}
ORACLES: dict[str, str] = {
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
