import csv
import io
import re

from conftest import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions.delimited import fields, quoting_broken, unquoted
from braidwork.operators.rejects import loadable_lines, rejected_lines

FILES = "file_id bigint, feed string, channel_id bigint, file_seq int, delim string"
LINES = "line_id bigint, file_id bigint, line_no int, raw_text string"


def broken(line: str, d: str) -> bool:
    """Brute force: a reader that goes from character to character."""
    i, n = 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return True
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        i += 2
                        continue
                    i += 1
                    break
                i += 1
            if i < n and line[i] != d:
                return True
        else:
            while i < n and line[i] != d:
                if line[i] == '"':
                    return True
                i += 1
        if i >= n:
            return False
        i += 1


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='a",;\n ', max_size=12), min_size=20, max_size=60), st.sampled_from([",", ";"]))
def test_quoting_and_cells_like_a_reader_by_character(spark, lines, delim):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").withColumn("d", F.lit(delim))
    cells = F.transform(fields(F.col("x"), F.col("d")), lambda c: unquoted(c, F.col("d")))
    got = {r["i"]: (r["b"], r["c"]) for r in df.select("i", quoting_broken(F.col("x"), F.col("d")).alias("b"), cells.alias("c")).collect()}
    for i, x in enumerate(lines):
        assert got[i][0] == broken(x, delim), x
        if not got[i][0] and x and "\n" not in x.replace('"', ""):
            assert got[i][1] == next(csv.reader(io.StringIO(x, newline=""), delimiter=delim)), x


def reasons(spark, rows, feed="customers_v1", delim=","):
    files = spark.createDataFrame([(1, feed, 1, 1, delim)], FILES)
    lines = spark.createDataFrame([(i, 1, i, x) for i, x in enumerate(rows, 1)], LINES)
    return {r["line_id"]: r["reason"] for r in rejected_lines(files, lines).collect()}


def test_reasons(spark):
    head = "Customer_ID,Full_Name,Email_Address,Registration_Date,Account_Status"
    rows = [
        head, "C1,Ann Lee,a@b.c,2024-02-29,Active", 'C1,"Lee, Ann",a@b.c,2024-02-29,Active', 'C1,"Ann\nLee",,,', 'C1,Ann "Jo" Lee,,,', 'C1,"Ann Lee,,,', "C1,Ann Lee,,", "C1,Ann Lee,,,,", "C1,,x,,",
        "C1,***,x,,", "C1,An�,x,,", "C1,An\x07n,x,,", "C1,Ann,x,2023-02-29,", "C1,Ann,x,13/45/2024,", "C1,Ann,x,soon,", "C1,Ann,x,1643525417647,", None, 'C1,"Ann ""Jo"" Lee",,,', "C1,Ann\tLee,x,00-00-0000,",
    ]
    assert reasons(spark, rows) == {5: "quoting", 6: "quoting", 7: "column_count", 8: "column_count", 9: "bad_value", 10: "bad_value", 11: "bad_value", 12: "bad_value", 13: "bad_value", 14: "bad_value", 15: "bad_value", 17: "column_count", 19: "bad_value"}


def test_day_order_by_feed(spark):
    assert reasons(spark, ["CustID|CustomerName|SignupDate", "1|Ann|12/25/2024", "1|Ann|25/12/2024"], "customers_v2", "|") == {3: "bad_value"}
    assert reasons(spark, ["client_number|name|created_at", "1|Ann|12-25-2024", "1|Ann|25-12-2024"], "customers_v3", "|") == {2: "bad_value"}


def test_empty_extra_columns_and_long_text(spark):
    files, lines = spark.createDataFrame([], FILES), spark.createDataFrame([], LINES)
    assert rejected_lines(files, lines).count() == 0
    files = spark.createDataFrame([(1, "customers_v1", 1, 1, ",", "x", 9)], FILES + ", reason string, value int")
    lines = spark.createDataFrame([(1, 1, 1, "Full_Name,x", "r"), (2, 1, 2, "A" * 200_000 + ",1", "r"), (2, 1, 2, "A" * 200_000 + ",1", "r"), (3, 1, 3, '"' + "a," * 50_000 + '",1', "r"), (4, None, 2, "a", "r")], LINES + ", reason string")
    assert rejected_lines(files, lines).count() == 0
    assert loadable_lines(files, lines).select("line_id").distinct().count() == 2


def test_whole_feed_against_brute_force(spark):
    files = {r["file_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.01/feed_files.parquet").collect()}
    lines = spark.read.parquet(f"{DATA}/sf0.01/feed_lines.parquet")
    heads, expect = {}, {}
    names = {"fullname", "customername", "name", "customerfullname", "displayname", "party", "clientname", "custname"}
    for r in lines.orderBy("file_id", "line_no").collect():
        f = files[r["file_id"]]
        row = next(csv.reader(io.StringIO(r["raw_text"], newline=""), delimiter=f["delim"]))
        if r["line_no"] == 1:
            heads[r["file_id"]] = [re.sub("[^a-z0-9]", "", h.lower()) for h in row]
        elif broken(r["raw_text"], f["delim"]):
            expect[r["line_id"]] = "quoting"
        elif len(row) != len(heads[r["file_id"]]):
            expect[r["line_id"]] = "column_count"
        else:
            name = next(v for k, v in zip(heads[r["file_id"]], row) if k in names)
            if not any(c.isalpha() for c in name) or "�" in name or any(ord(c) < 32 and c not in "\t\n\r" or 127 <= ord(c) < 160 for c in name):
                expect[r["line_id"]] = "bad_value"
    got = {r["line_id"]: r["reason"] for r in rejected_lines(spark.read.parquet(f"{DATA}/sf0.01/feed_files.parquet"), lines).collect()}
    by_date = {k for k in got if k not in expect}
    assert {k: v for k, v in got.items() if k not in by_date} == expect
    assert all(got[k] == "bad_value" for k in by_date)
