"""Measurements over time: percentiles, alerts, anomalies, trends, batches and chunks."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import cut


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """avg, min, max and exact p50, p95, p99 (linear between ranks) by group."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    d = df.groupBy(by).agg(F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), p.alias("p"))
    return d.select(by, "mean_value", "min_value", "max_value", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"))


def anomalies(series: DataFrame, by: str, at: str, value: str, rows: int = 7, least: float = 2.0, high: float = 3.0) -> DataFrame:
    """by, at, value, z, severity: values whose z-score in a trailing window of rows (itself included, population deviation) is over least; no full window, no case."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(-(rows - 1), 0)
    d = series.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w), "_n": F.count(F.lit(1)).over(w)})
    d = d.where(F.col("_n") == rows).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0))
    return d.where(F.abs("z") > least).select(by, at, value, "z", F.when(F.abs("z") > high, "high").otherwise("medium").alias("severity"))


def trend(daily: DataFrame, at: str, value: str, days: int = 7) -> DataFrame:
    """total, mean, first and last mean over days rows (half the rows if there are no more), and the change in percent."""
    d = daily.withColumns({"_up": F.row_number().over(Window.orderBy(at)), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    k = F.when(F.col("_n") > days, F.lit(days)).otherwise(F.floor(F.col("_n") / 2))
    first, last = F.avg(F.when(F.col("_up") <= k, F.col(value))), F.avg(F.when(F.col("_up") > F.col("_n") - k, F.col(value)))
    return d.agg(F.sum(value).alias("total"), F.avg(value).alias("mean_value"), first.alias("first_mean"), last.alias("last_mean")).withColumn("change_percent", F.when(F.col("first_mean") != 0, 100.0 * (F.col("last_mean") - F.col("first_mean")) / F.col("first_mean")))


def threshold_level(value: Column, warning: Column, critical: Column) -> Column:
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("ok")


def shares(df: DataFrame, by: str, value: str) -> DataFrame:
    """calls, total, mean, min, max and the share of the grand total, by group; the totals are summed from the groups."""
    d = df.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    whole = d.agg(F.sum("total").alias("whole"))
    return d.join(F.broadcast(whole)).withColumn("share", F.try_divide(100.0 * F.col("total"), F.col("whole"))).drop("whole")


def bottleneck(io: Column, cpu: Column, memory_mb: Column) -> Column:
    return F.when(io > 50, "io").when(cpu > 80, "cpu").when(memory_mb > 3500, "memory").otherwise("network")


def chunked(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Adds chunk, of rows each by order. Places are counted per range of the order and shifted by the ranges before, so no single task sorts the table."""
    # kept in the shared folder: computed twice, the sampled ranges could differ
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    sizes = ranged.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    d = ranged.withColumn("_place", place).join(F.broadcast(before), "_part")  # a row per partition
    return d.withColumn("chunk", F.floor((F.col("_place") + F.col("_before") - 1) / rows).cast("bigint")).drop("_part", "_place", "_before")


def batches(items: list[str], most: int = 20, most_cost: float = 4096, cost=lambda t: len(t) / 4) -> list[list[str]]:
    """Items in order, packed into batches of most items and cost; an item that is too large stands alone."""
    out: list[list[str]] = []
    spent = 0.0
    for t in items:
        c = cost(t)
        if not out or len(out[-1]) >= most or spent + c > most_cost:
            out.append([])
            spent = 0.0
        out[-1].append(t)
        spent += c
    return out


def repeated_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """first_id, copies of each text that is equal without case and outer blanks, with the text of the first."""
    k = F.lower(F.trim(F.col(text_col)))
    return df.where(F.col(text_col).isNotNull()).groupBy(F.md5(k.cast("binary")).alias("key")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min_by(text_col, id_col).alias("first_text"))


class Cache:
    """A bounded least-recently-used store for driver-side answers."""

    def __init__(self, most: int = 500) -> None:
        self.most, self.hits, self.asked = most, 0, 0
        self._kept: OrderedDict[str, object] = OrderedDict()

    @staticmethod
    def key(text: str) -> str:
        return hashlib.md5(text.encode()).hexdigest()

    def get(self, text: str) -> object | None:
        self.asked += 1
        k = self.key(text)
        if k not in self._kept:
            return None
        self.hits += 1
        self._kept.move_to_end(k)
        return self._kept[k]

    def put(self, text: str, value: object) -> None:
        k = self.key(text)
        self._kept[k] = value
        self._kept.move_to_end(k)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)

    def hit_rate(self) -> float:
        return self.hits / self.asked if self.asked else 0.0
