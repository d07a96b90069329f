"""Readers for inconsistent files, and writers."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys under which a wrapper object may hold its rows, and names of an external catalogue's types.
ROW_KEYS = ("data", "records", "items", "products", "warehouses")
EXTERNAL_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "INTEGER": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(),
    "DECIMAL": T.DecimalType(18, 2), "ARRAY": T.ArrayType(T.StringType()), "MAP": T.MapType(T.StringType(), T.StringType()), "STRUCT": T.StringType(),
}


def detect_encoding(spark: SparkSession, path: str, head: int = 10_000) -> str:
    """By byte order mark, then strict UTF-8, else latin-1, from the first bytes of the first file."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, head).alias("b")).limit(1).collect()
    b = bytes(row[0]["b"]) if row else b""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if b.startswith(mark):
            return name
    try:
        b[: max(0, len(b) - 3)].decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8", lines: int = 50) -> str:
    """By the standard sniffer on the first lines; else the most frequent of comma, tab, pipe and semicolon."""
    text = "\n".join(r["value"] for r in spark.read.option("encoding", encoding).text(path).limit(lines).collect())[:5000]
    try:
        return csv.Sniffer().sniff(text, delimiters=",\t|;").delimiter
    except csv.Error:
        return max(",\t|;", key=text.count)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, encoding: str | None = None, bad: str = "keep") -> DataFrame:
    """A delimited file with header. bad: keep puts lines that don't parse into _corrupt_record, drop leaves them out.

    Without a schema all columns are text: types are inferred from a profile once and passed as a schema later on.
    """
    encoding = encoding or detect_encoding(spark, path)
    sep = sep or detect_delimiter(spark, path, encoding)
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("nullValue", "")
    if schema is None:
        head = r.csv(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in head])
    if bad == "drop":
        return r.option("mode", "DROPMALFORMED").schema(schema).csv(path)
    return r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON file: rows of an array, or of the first array under ROW_KEYS of a wrapper object, else the object as a row."""
    r = spark.read.option("multiLine", True)
    df = (r.schema(schema) if schema else r).json(path)
    for k in ROW_KEYS:
        if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType):
            rows = df.select(F.explode(k).alias("row"))
            return rows.select("row.*") if isinstance(rows.schema["row"].dataType, T.StructType) else rows
    return df


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def read_source(spark: SparkSession, path: str, kind: str | None = None, **options: object) -> DataFrame:
    """By kind (csv, tsv, json, xml, parquet, orc) or the path's ending."""
    kind = kind or os.path.splitext(path)[1].lstrip(".").lower()
    if kind == "csv":
        return read_delimited(spark, path, **options)
    if kind == "tsv":
        return read_delimited(spark, path, sep="\t", **options)
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "xml":
        return read_xml(spark, path, **options)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown kind of source: {kind}")


def external_schema(document: dict) -> T.StructType:
    """A Spark schema from a catalogue document with fields of name, type and nullable; unknown types are text."""
    return T.StructType([T.StructField(f["name"], EXTERNAL_TYPES.get(str(f.get("type", "")).upper(), T.StringType()), bool(f.get("nullable", True))) for f in document.get("fields", [])])


def write_documentation(profile: DataFrame, path: str, summary: dict) -> None:
    """A profile as JSON lines, and a small summary beside it."""
    profile.write.mode("overwrite").json(path)
    target = f"{path.rstrip('/')}_summary.json"
    profile.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(target)
