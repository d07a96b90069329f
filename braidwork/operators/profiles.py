"""Profiles of tables: one job for all columns, never one per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.kinds import DISTRIBUTED, simple_kind, value_labels
from braidwork.functions.naming import PATTERNS, header_pattern, normalize_name, semantic_type, standardize_header


def _per_column(df: DataFrame, columns: list[str], facts: dict[str, callable]) -> DataFrame:
    """column_name and the facts of each column: one aggregation, its single row turned into a row per column."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[f(F.col(f"`{c}`")).alias(k) for k, f in facts.items()]).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("x")).select("x.*")


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls, distinct values, min, max, mean, median and sample deviation of numeric columns, as doubles.

    Moments come from one pass; distinct values and median from the counts of each column's values, which combine before
    the shuffle. Counting several columns' distinct values in one aggregation would copy every row for each of them.
    """
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    d = lambda c: c.cast("double")
    moments = _per_column(df, columns, {"nulls": lambda c: F.count_if(c.isNull()), "min_value": lambda c: F.min(d(c)), "max_value": lambda c: F.max(d(c)), "mean_value": lambda c: F.avg(d(c)), "std_value": lambda c: F.stddev_samp(d(c))})
    whole = lambda c: F.col(f"`{c}`").cast("bigint") if isinstance(df.schema[c].dataType, T.IntegralType) else F.lit(None).cast("bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), whole(c).alias("whole"), d(F.col(f"`{c}`")).alias("v")) for c in columns])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("column_name", "whole", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.percentile("v", F.lit(0.5), F.col("n")).alias("median_value"))
    out = moments.join(ranks, "column_name", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return out.select("column_name", "nulls", "distinct_values", "min_value", "max_value", "mean_value", "median_value", "std_value")


def profile_string(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _per_column(df, columns, {
        "nulls": lambda c: F.count_if(c.isNull()), "distinct_values": lambda c: F.count_distinct(c), "min_length": lambda c: F.min(F.length(c)).cast("bigint"),
        "max_length": lambda c: F.max(F.length(c)).cast("bigint"), "avg_length": lambda c: F.avg(F.length(c)),
    })


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    return _per_column(df, columns, {"total": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(c.isNull()), "null_percent": lambda c: F.try_divide(100.0 * F.count_if(c.isNull()), F.count(F.lit(1)))})


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of cells that hold a value, in percent."""
    columns = columns or df.columns
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in columns[1:]), F.count_if(F.col(f"`{columns[0]}`").isNull()))
    return df.agg(nulls.alias("null_cells"), (F.count(F.lit(1)) * len(columns)).alias("cells")).select("null_cells", "cells", (100.0 - F.try_divide(100.0 * F.col("null_cells"), F.col("cells"))).alias("completeness"))


def quality_score(issues: Column, header_consistency: Column, inconsistent_columns: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 5 * issues - 20 * (1 - header_consistency) - 5 * inconsistent_columns))


def potential_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Uniqueness of each column over all rows, and its class: over 0.95 a primary key, else by name a foreign key, else none."""
    columns = columns or df.columns
    d = _per_column(df, columns, {"uniqueness": lambda c: F.try_divide(F.count_distinct(c), F.count(F.lit(1)))})
    named = F.lower("column_name").rlike("id|key|ref")
    return d.withColumn("key_class", F.when(F.col("uniqueness") > 0.95, "primary_key_candidate").when(named, "foreign_key_candidate").otherwise("none"))


def inclusion(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys, and how many of them the parent holds: evidence for a foreign key."""
    keys = child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("k")).distinct()
    held = keys.join(parent.select(F.col(parent_key).alias("k"), F.lit(1).alias("held")).distinct(), "k", "left")
    return held.agg(F.count(F.lit(1)).alias("child_keys"), F.count("held").alias("held_keys"))


def kinds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, kind, confidence by the rule that all values must fit."""
    columns = columns or df.columns
    return _per_column(df, columns, {"x": lambda c: simple_kind(c.cast("string"))}).select("column_name", "x.kind", "x.confidence")


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (text): a row per cell."""
    columns = columns or df.columns
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def label_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, label, uses of every label that non-null values fit."""
    return unpivoted(df, columns).where("value is not null").select("column_name", F.explode(value_labels(F.col("value"))).alias("label")).groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("uses"))


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, primary_type (most uses, then by name), consistency: its uses over non-null values."""
    counts = label_counts(df, columns)
    n = unpivoted(df, columns).groupBy("column_name").agg(F.count("value").alias("n"))
    top = counts.groupBy("column_name").agg(F.min_by(F.struct("label", "uses"), F.struct(-F.col("uses"), F.col("label"))).alias("t"))
    return top.join(n, "column_name").select("column_name", F.col("t.label").alias("primary_type"), F.try_divide(F.col("t.uses"), F.col("n")).alias("consistency"))


def pattern_semantics(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, values and how many of them fit each pattern, semantic: the first pattern of more than 0.8 of them, else by name."""
    cells = unpivoted(df, columns).where("value is not null")
    d = cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), *[F.count_if(F.col("value").rlike(p)).alias(f"n_{k}") for k, p in DISTRIBUTED.items()])
    first = None
    for k in DISTRIBUTED:
        hit = F.col(f"n_{k}") > 0.8 * F.col("n_values")
        first = F.when(hit, F.lit(k)) if first is None else first.when(hit, F.lit(k))
    hints = (("identifier", "id|key|code"), ("name", "name|desc|title"), ("date", "date|time|created|updated"), ("monetary", "amount|price|cost|total"), ("status", "status|state|flag"))
    for k, p in hints:
        first = first.when(F.lower("column_name").rlike(p), F.lit(k))
    return d.withColumn("semantic", first.otherwise(F.lit("general")))


def header_consistency(headers: DataFrame) -> DataFrame:
    """From headers(header): pattern, uses, dominant (the most used; of equals the first of PATTERNS), consistency."""
    d = headers.select(header_pattern(F.col("header")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
    place = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern"))
    best = d.agg(F.max_by("pattern", F.struct("uses", -place)).alias("dominant"), F.max("uses").alias("most"), F.sum("uses").alias("total"))
    return d.join(F.broadcast(best)).select("pattern", "uses", (F.col("pattern") == F.col("dominant")).alias("dominant"), F.try_divide(F.col("most"), F.col("total")).alias("consistency"))


def header_mapping(df: DataFrame) -> DataFrame:
    """original, normalized, standardized, semantic of each column of a table."""
    h = df.sparkSession.createDataFrame([(c,) for c in df.columns], "original string")
    return h.select("original", normalize_name(F.col("original")).alias("normalized"), standardize_header(F.col("original")).alias("standardized"), semantic_type(F.col("original")).alias("semantic"))


def header_collisions(df: DataFrame) -> DataFrame:
    """standardized, originals: columns of a table that fall together once standardized."""
    return header_mapping(df).groupBy("standardized").agg(F.sort_array(F.collect_list("original")).alias("originals")).where(F.size("originals") > 1)


def schema_facts(df: DataFrame) -> DataFrame:
    """column_name, type, nullable, as a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column_name string, type string, nullable boolean")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """field, change (added, removed or type_changed), old_type, new_type, from schema_facts of two tables."""
    a, b = old.select(F.col("column_name").alias("field"), F.col("type").alias("old_type")), new.select(F.col("column_name").alias("field"), F.col("type").alias("new_type"))
    d = a.join(b, "field", "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type_changed")
    return d.withColumn("change", change).where("change is not null").select("field", "change", "old_type", "new_type")


def recommendations(profile: DataFrame) -> DataFrame:
    """column_name, priority, advice from column_name, consistency, null_percent."""
    p = F.when(F.col("consistency") < 0.9, F.struct(F.lit("high").alias("priority"), F.lit("make the values uniform").alias("advice"))).when(F.col("null_percent") > 30, F.struct(F.lit("medium").alias("priority"), F.lit("fill or drop missing values").alias("advice")))
    return profile.select("column_name", p.alias("x")).where("x is not null").select("column_name", "x.*")


def narrowest_types(df: DataFrame) -> DataFrame:
    """column_name, min_value, max_value, suggested: the narrowest integer type that holds each integer column."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    d = _per_column(df, cols, {"min_value": lambda c: F.min(c).cast("bigint"), "max_value": lambda c: F.max(c).cast("bigint")})
    fits = lambda n: (F.col("min_value") > -(2**n)) & (F.col("max_value") < 2**n - 1)
    return d.withColumn("suggested", F.when(fits(7), "tinyint").when(fits(15), "smallint").when(fits(31), "int").otherwise("bigint"))
