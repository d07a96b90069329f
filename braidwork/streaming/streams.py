"""Streams of records: message logs as files, field statistics, evolving schemas, windows and running weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.naming import name_similarity
from braidwork.session import checkpoint_dir


def message_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A directory as a message log: each file a batch. The source's own checkpoint holds the offsets."""
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def ingest(spark: SparkSession, source: str, target: str, schema: T.StructType, checkpoint: str):
    """Continuous ingestion of delimited files into a table, with ingestion time and source file; ends when all files are read."""
    s = spark.readStream.schema(schema).option("header", True).csv(source)
    s = s.withColumns({"ingestion_time": F.current_timestamp(), "source_file": F.col("_metadata.file_path")})
    return s.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is available through a streaming aggregation, into a table of the session."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def field_statistics(records: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, nulls, emails, urls, identifiers: a streaming or batch aggregation with bounded state for each field."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    v = F.col("value")
    d = records.select(cell.alias("x")).select("x.*")
    return d.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v.contains("@")).alias("emails"), F.count_if(v.startswith("http")).alias("urls"),
        F.count_if((F.length(v) > 5) & v.rlike(r"^[A-Z]{3}\d+")).alias("identifiers"),
    )


def windowed(records: DataFrame, at: str, value: str, length: str = "5 minutes", late: str | None = None, by: list[str] | None = None) -> DataFrame:
    """n, nulls, mean by window and keys; with late, rows older than the watermark are dropped in streams."""
    d = records.withColumn(at, F.col(at).cast("timestamp"))
    d = d.withWatermark(at, late) if late else d
    g = d.groupBy(F.window(at, length), *(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.avg(value).alias("mean_value")).select(F.col("window.start").alias("window_start"), *(by or []), "n", "nulls", "mean_value")


def watermarks(records: DataFrame, source: str, at: str) -> DataFrame:
    return records.groupBy(source).agg(F.max(at).alias("watermark"))


@dataclass
class SchemaRegistry:
    """Versions of each source's schema (field to type), with a compatibility mode: BACKWARD, FORWARD, FULL or NONE."""

    mode: str = "BACKWARD"
    on_incompatible: str = "log"
    versions: dict[str, list[dict[str, str]]] = field(default_factory=dict)
    log: list[dict[str, object]] = field(default_factory=list)

    def compatible(self, old: dict[str, str], new: dict[str, str]) -> bool:
        backward, forward = set(old) <= set(new), set(new) <= set(old)
        return {"BACKWARD": backward, "FORWARD": forward, "FULL": backward and forward, "NONE": True}[self.mode]

    def register(self, source: str, schema: dict[str, str]) -> str:
        known = self.versions.setdefault(source, [])
        if known:
            old = known[-1]
            ok = self.compatible(old, schema)
            if not ok and self.on_incompatible == "reject":
                raise ValueError(f"{source}: the new schema is not {self.mode.lower()} compatible")
            self.log.append({"source": source, "added": sorted(set(schema) - set(old)), "removed": sorted(set(old) - set(schema)), "type_changed": sorted(f for f in set(old) & set(schema) if old[f] != schema[f]), "compatible": ok})
        known.append(dict(schema))
        return f"{source}_v{len(known)}"

    def unified(self) -> dict[str, list[str]]:
        """field to the sources whose current schema has it."""
        out: dict[str, list[str]] = {}
        for s in sorted(self.versions):
            for f in self.versions[s][-1]:
                out.setdefault(f, []).append(s)
        return out


def backward_compatible(old: Column, new: Column) -> Column:
    """Whether every old field (array) is among the new ones."""
    return F.size(F.array_except(old, new)) == 0


def cross_pairs(fields: DataFrame) -> DataFrame:
    """source_a, field_a, source_b, field_b, similarity of every pair of fields of two sources; fields(source, field) is a table of names."""
    a, b = fields.toDF("source_a", "field_a"), fields.toDF("source_b", "field_b")
    d = a.join(F.broadcast(b), F.col("source_a") < F.col("source_b"))
    return d.withColumn("similarity", name_similarity(F.col("field_a"), F.col("field_b")))
