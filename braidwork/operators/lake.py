"""Tables that change: upserts, differences of snapshots, change logs and history, on plain columnar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Rows of the source replace those of the target with its key; columns of either side are kept. Repeated source keys are an error."""
    if check:
        twice = source.groupBy(key).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"the source holds {key} more than once")
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change_type and the row's columns: insert, delete, update_preimage, update_postimage. Rows are compared as a whole, nulls equal."""
    cols = [c for c in new.columns if c != key]
    a, b = old.select(F.col(key), F.struct(*cols).alias("o")), new.select(F.col(key), F.struct(*cols).alias("n"))
    d = a.join(b, key, "full_outer")
    row = lambda kind, img: F.struct(F.lit(kind).alias("change_type"), img.alias("row"))
    out = (
        F.when(F.col("o").isNull(), F.array(row("insert", F.col("n"))))
        .when(F.col("n").isNull(), F.array(row("delete", F.col("o"))))
        .when(~F.col("o").eqNullSafe(F.col("n")), F.array(row("update_preimage", F.col("o")), row("update_postimage", F.col("n"))))
    )
    return d.select(key, F.explode(out).alias("x")).select(key, "x.change_type", "x.row.*")


def applied(target: DataFrame, log: DataFrame, key: str, version: str) -> DataFrame:
    """The target after the log: the last change of each key by version; deletes remove it."""
    cols = [c for c in log.columns if c not in (key, version, "change_type")]
    last = log.where("change_type <> 'update_preimage'").groupBy(key).agg(F.max_by(F.struct("change_type", *cols), F.col(version)).alias("x")).select(key, "x.*")
    keep = target.join(last.select(key), key, "left_anti")
    return keep.unionByName(last.where("change_type <> 'delete'").drop("change_type"), allowMissingColumns=True)


def history(events: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """key, value, valid_from, valid_to, is_current: one row per run of equal values."""
    w = Window.partitionBy(key).orderBy(at, tie)
    begun = events.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value)))
    to = F.lead(at).over(w)
    return begun.select(key, value, F.col(at).alias("valid_from"), to.alias("valid_to"), to.isNull().alias("is_current"), F.col(tie).alias("event"))


def latest_schema_changes(log: DataFrame, kinds: tuple[str, ...] = ("added", "removed", "type_changed")) -> DataFrame:
    return log.where(F.col("change").isin(*kinds)).orderBy(F.desc("at"), "field")


def rescued(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose rescue column holds something at the path, with it."""
    d = df.withColumn("rescued", F.get_json_object(column, path))
    return d.where("rescued is not null")
