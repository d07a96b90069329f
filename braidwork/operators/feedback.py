"""Review of mappings and what is learned from it, from an event log instead of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence_level(c: Column) -> Column:
    return F.when(c > 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def batch_decision(source: Column, target: Column, confidence: Column) -> Column:
    """Equal names or more than 0.9: approved; under 0.5: needs review; else pending."""
    return F.when((F.lower(source) == F.lower(target)) | (confidence > 0.9), "approved").when(confidence < 0.5, "needs_review").otherwise("pending")


def next_for_review(mappings: DataFrame, n: int = 1) -> DataFrame:
    return mappings.where("status = 'pending'").orderBy("confidence", "mapping_id").limit(n)


def latest_status(log: DataFrame) -> DataFrame:
    """The last event of each mapping_id by (at, event_id); folded by aggregation, so long logs of one mapping are no group."""
    return log.groupBy("mapping_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max(F.struct("at", "event_id"))["at"].alias("at"), F.count(F.lit(1)).alias("events"))


def progress(latest: DataFrame) -> DataFrame:
    """total, reviewed, approved, rejected, corrected, percent."""
    done = F.col("status").isin("approved", "rejected", "corrected")
    d = latest.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("reviewed"), *[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "rejected", "corrected")])
    return d.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("reviewed") / F.col("total")).otherwise(0.0))


def feedback_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.lower("source_field").alias("source_field"), F.lower("target_field").alias("target_field"), "status").agg(F.count(F.lit(1)).alias("n"))


def suggestions(counts: DataFrame) -> DataFrame:
    """source_field, suggestion, confidence: the most frequent correction, else the most approved target; of equals the first by name."""
    w = Window.partitionBy("source_field").orderBy(F.when(F.col("status") == "corrected", 0).otherwise(1), F.desc("n"), "target_field")
    top = counts.where("status in ('corrected', 'approved')").withColumn("place", F.row_number().over(w)).where("place = 1")
    sure = F.when(F.col("status") == "corrected", F.least(F.lit(0.9), 0.6 + 0.1 * F.col("n"))).otherwise(F.least(F.lit(0.85), 0.5 + 0.1 * F.col("n")))
    return top.select("source_field", F.col("target_field").alias("suggestion"), sure.alias("confidence"))


def retrained(log: DataFrame, least: int = 100) -> DataFrame:
    """pair, weight, n: share of correct feedback of each pair; empty until there are least rows in all."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    d = log.groupBy("pair").agg(F.avg(F.col("correct").cast("double")).alias("weight"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.partitionBy())).where(F.col("total") >= least).drop("total")


def adjusted(base: Column, weight: Column) -> Column:
    return 0.7 * base + 0.3 * F.coalesce(weight, F.lit(0.5))


def moving_average(df: DataFrame, by: str, order: list[str], value: Column, start: float = 0.5, alpha: float = 0.1) -> DataFrame:
    """by, ema: c := alpha * value + (1 - alpha) * c in order, from start.

    The fold is linear, so it is a sum of value times alpha (1 - alpha)^age: an aggregation that combines partially,
    after the ages are ranked. Values so old that their weight is under 1e-18 change nothing.
    """
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    aged = df.withColumn("_age", F.row_number().over(w) - 1)
    term = F.when(F.col("_age") < 400, value * alpha * F.pow(F.lit(1 - alpha), F.col("_age"))).otherwise(0.0)
    return aged.groupBy(by).agg((F.sum(term) + F.lit(start) * F.pow(F.lit(1 - alpha), F.count(F.lit(1)))).alias("ema"))


def online_weights(df: DataFrame, by: str, order: list[str], correct: Column, start: float = 0.5, rate: float = 0.01) -> DataFrame:
    """by, weight: w += rate (1 - w) if correct, else w -= rate w, in order: the moving average of the outcomes."""
    return moving_average(df, by, order, correct.cast("double"), start, rate).withColumnRenamed("ema", "weight")
