import json

import pytest
from pyspark.sql import types as T

from braidwork.sources import readers as R
from braidwork.streaming import streams as W


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("id;name\n1;J\xfcrg\n2;\"a;b\"\n".encode("latin-1"))
    assert R.detect_encoding(spark, str(p)) == "ISO-8859-1" and R.detect_delimiter(spark, str(p), "ISO-8859-1") == ";"
    df = R.read_source(spark, str(p))
    assert sorted((r["id"], r["name"]) for r in df.collect()) == [("1", "J\xfcrg"), ("2", "a;b")]
    q = tmp_path / "b.csv"
    q.write_text("id,name\n1,x\n2,y,z,extra\n")
    assert R.read_delimited(spark, str(q), bad="drop").count() >= 1
    assert R.read_delimited(spark, str(q)).cache().where("_corrupt_record is not null").count() == 1


def test_json_and_xml(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"total": 2, "products": [{"id": "a", "price": {"amount": 1.5, "currency": "EUR"}}, {"id": "b", "price": None}]}))
    df = R.read_source(spark, str(p))
    assert df.count() == 2 and isinstance(df.schema["price"].dataType, T.StructType)
    x = tmp_path / "x.xml"
    x.write_text("<d><REC><A>1</A></REC><REC><A>2</A></REC></d>")
    assert R.read_source(spark, str(x), row_tag="REC").count() == 2
    with pytest.raises(ValueError):
        R.read_source(spark, "x.unknown")
    assert R.external_schema({"fields": [{"name": "n", "type": "LONG"}, {"name": "x", "type": "odd"}]}).simpleString() == "struct<n:bigint,x:string>"


def test_stream_equals_batch(spark, tmp_path):
    data = [(i, f"2024-01-01 00:{i % 60:02d}:00", None if i % 7 == 0 else float(i), f"u{i}@x") for i in range(200)]
    df = spark.createDataFrame(data, "id int, ts string, value double, mail string")
    df.repartition(4).write.parquet(str(tmp_path / "log"))
    s = W.message_stream(spark, str(tmp_path / "log"), df.schema, per_trigger=1)
    got = W.run_once(W.field_statistics(s, ["value", "mail"]), "stats")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.field_statistics(df, ["value", "mail"]).collect()))
    w = W.run_once(W.windowed(s, "ts", "value", "5 minutes"), "win")
    assert w.count() == 12 and w.agg({"n": "sum"}).first()[0] == 200


def test_registry():
    r = W.SchemaRegistry()
    assert r.register("s", {"id": "int", "value": "int"}) == "s_v1" and r.register("s", {"id": "int", "value": "text", "ts": "time"}) == "s_v2"
    assert r.log[-1] == {"source": "s", "added": ["ts"], "removed": [], "type_changed": ["value"], "compatible": True}
    r.register("t", {"id": "int"})
    assert r.unified()["id"] == ["s", "t"]
    strict = W.SchemaRegistry("FULL", "reject", {"s": [{"id": "int"}]})
    with pytest.raises(ValueError):
        strict.register("s", {"id": "int", "x": "int"})


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,name\n1,x\n2,y\n")
    W.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and {"ingestion_time", "source_file"} <= set(out.columns)
