"""The queries of the general problems 1, 2, 3 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.operators.drift import schema_changes, unified_feed
from braidwork.operators.instants import DATE_COLUMNS, table_instants
from braidwork.operators.rejects import rejected_lines
from braidwork.operators.units import normalise_prices
from braidwork.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_lines(read_table(spark, d, "feed_files"), read_table(spark, d, "feed_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = table_instants({n: read_table(spark, d, n) for n in DATE_COLUMNS})
    return found.where("status in ('resolved', 'ambiguous')").select("src_table", "rec_id", "utc_micros")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose own text names the unit: those it leaves one combination, and those where the residual picks one of several."""
    priced = normalise_prices(read_table(spark, d, "products"), read_table(spark, d, "fx_rates"))
    return priced.where("unit_status in ('known', 'ranked')").select("rec_id", "usd_cents")


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    """All rows with an amount, those that the residual ranks or leaves open too."""
    return normalise_prices(read_table(spark, d, "products"), read_table(spark, d, "fx_rates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(read_table(spark, d, "feed_files"), read_table(spark, d, "feed_lines"))


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return unified_feed(read_table(spark, d, "feed_files"), read_table(spark, d, "feed_lines"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_units": p3_units, "p7_found": p7_found, "p7_unified": p7_unified}
ORACLES: dict[str, str] = {}
