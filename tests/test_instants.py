import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from braidwork.operators.instants import InstantRules, fit_mixtures, normalise_instants


def micros(y, mo, d, h=0, mi=0, s=0, us=0, zone="UTC", fold=0):
    t = dt.datetime(y, mo, d, h, mi, s, us, tzinfo=ZoneInfo(zone), fold=fold)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


CASES = [
    ("v1", "2024-02-29", None, micros(2024, 2, 29)),
    ("v1", "2024-02-29", "Asia/Kolkata", micros(2024, 2, 29, zone="Asia/Kolkata")),
    ("v1", "2023-02-29", None, None),
    ("v1", "20220108", "Europe/Berlin", micros(2022, 1, 8, zone="Europe/Berlin")),
    ("v1", "20220129T134524Z", "Asia/Tokyo", micros(2022, 1, 29, 13, 45, 24)),
    ("v1", "1643030025", "Asia/Tokyo", 1643030025 * 10**6),
    ("v1", "1642083515290", None, 1642083515290 * 1000),
    ("v1", "1642030759294025", None, 1642030759294025),
    ("v1", "2022-01-23 14:39:50.753", "America/New_York", micros(2022, 1, 23, 14, 39, 50, 753000, "America/New_York")),
    ("v1", "2022-01-13 03:16:04,229", None, micros(2022, 1, 13, 3, 16, 4, 229000)),
    ("v1", "2022-01-30 02:44:24.333+1100", None, micros(2022, 1, 29, 15, 44, 24, 333000)),
    ("v1", "2022-01-29 05:54:42+01", None, micros(2022, 1, 29, 4, 54, 42)),
    ("v1", "Mon, 14 Feb 2022 23:15:56 +0100", None, micros(2022, 2, 14, 22, 15, 56)),
    ("v1", "2 May 2022", "UTC", micros(2022, 5, 2)),
    ("v1", "February 16, 2022", None, micros(2022, 2, 16)),
    ("v1", "2022-05-11 14:32:31 EDT", "America/New_York", micros(2022, 5, 11, 18, 32, 31)),
    ("v1", "2022-11-06 01:30:00 EST", "America/New_York", micros(2022, 11, 6, 6, 30)),
    ("v1", "2022-11-06 01:30:00 EDT", "America/New_York", micros(2022, 11, 6, 5, 30)),
    ("v1", "2022-04-13 01:18:35 IST", "Asia/Kolkata", micros(2022, 4, 12, 19, 48, 35)),
    ("v1", "2022-02-28 22:56:56 America/New_York", "UTC", micros(2022, 2, 28, 22, 56, 56, zone="America/New_York")),
    ("v1", "2022-02-15T16:42:48+01:00[Europe/Berlin]", None, micros(2022, 2, 15, 15, 42, 48)),
    ("v1", "2022-10-30 02:30:00", "Europe/Berlin", micros(2022, 10, 30, 2, 30, zone="Europe/Berlin", fold=0)),
    ("v1", "2022-03-27 02:30:00", "Europe/Berlin", micros(2022, 3, 27, 1, 30)),
    ("v2", "2/5/2022 12:03:04 AM", None, micros(2022, 2, 5, 0, 3, 4)),
    ("v2", "02/05/2022 12:03 PM", None, micros(2022, 2, 5, 12, 3)),
    ("v2", "25/12/2022", None, None),
    ("v3", "05-02-2022", None, micros(2022, 2, 5)),
    ("v3", "15.01.22", None, micros(2022, 1, 15)),
    ("v3", "12/25/2022", None, None),
    ("v3", "03.02.2022 21:47:01", "Asia/Tokyo", micros(2022, 2, 3, 21, 47, 1, zone="Asia/Tokyo")),
    *[("v1", x, None, None) for x in (None, "", "  ", "pending", "12-2024", "2024-05-05T25:61:00", "0000-00-00", "2024-13-05", "x" * 5000, "2022-01-01 10:00:00 Mars/Base")],
    ("v1", "2022-01-01 10:00:00", "Nowhere/Land", None),
]


def test_cases_against_the_standard_library(spark):
    df = spark.createDataFrame([(i, *c[:3], "x") for i, c in enumerate(CASES)], "i int, s string, v string, z string, status string")
    got = {r["i"]: r["utc_micros"] for r in normalise_instants(df, "s", "v", "z", ["i"], InstantRules(declared={"v2": "mdy", "v3": "dmy"})).collect()}
    assert [(c[:3], got[i]) for i, c in enumerate(CASES) if got[i] != c[3]] == []


def test_mixture_tells_the_order_without_declaration():
    both = ("mdy", "dmy")
    post = fit_mixtures([("a", both, 400), ("a", ("mdy",), 300), ("b", both, 400), ("b", ("dmy",), 300), ("c", both, 10)], InstantRules())
    assert post["a", both][0][0] == "mdy" and post["a", both][0][1] > 0.98
    assert post["b", both][0][0] == "dmy" and post["b", both][0][1] > 0.98
    assert post["c", both][0][1] == pytest.approx(0.5)


def test_ambiguous_and_empty(spark):
    df = spark.createDataFrame([(1, "c", "03/04/2022", None), (1, "c", "03/04/2022", None)], "i int, s string, v string, z string")
    assert [r["status"] for r in normalise_instants(df, "s", "v", "z", ["i"]).collect()] == ["ambiguous"] * 2
    assert normalise_instants(df.limit(0), "s", "v", "z", ["i"]).count() == 0


def test_a_rare_format_keeps_its_values_in_a_large_table(spark):
    df = spark.range(25_000).selectExpr("id", "'v2' AS s", "CASE WHEN id < 5 THEN 'March 5, 2024' WHEN id < 10 THEN '1642030759294025' WHEN id = 10 THEN '25/12/2022' ELSE '2024-01-02' END AS v", "CAST(NULL AS string) AS z")
    got = {r["id"]: r for r in normalise_instants(df, "s", "v", "z", ["id"], InstantRules(declared={"v2": "mdy"})).where("id < 11").collect()}
    assert [got[i]["utc_micros"] for i in range(10)] == [micros(2024, 3, 5)] * 5 + [1642030759294025] * 5
    assert {got[i]["status"] for i in range(10)} == {"resolved"} and got[10]["status"] == "off_format"


def test_a_value_reads_alike_at_every_table_size(spark):
    for n in (10, 1_500, 5_000):
        df = spark.range(n).selectExpr("id", "'v1' AS s", "CASE WHEN id = 0 THEN '20240102' ELSE '2024-01-02' END AS v", "CAST(NULL AS string) AS z")
        r = normalise_instants(df, "s", "v", "z", ["id"]).where("id = 0").first()
        assert (r["utc_micros"], r["status"], r["posterior"]) == (micros(2024, 1, 2), "resolved", 1.0), n
