"""Hand-computed values of the scalar functions, and operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.functions import kinds as K
from braidwork.functions import naming as N
from braidwork.functions import similarity as S
from braidwork.operators import entities as E
from braidwork.operators import feedback as V
from braidwork.operators import lake as L
from braidwork.operators import mapping as M
from braidwork.operators import monitoring as Q
from braidwork.operators import profiles as P
from braidwork.operators import unify as U


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_names(spark):
    heads = ["Customer_ID", "CustID", "MFG_DT", "FLD01"]
    assert list(one(spark, *[N.standardize_header(F.lit(h)) for h in heads])) == ["customer_id", "cust_id", "dt", "fld01"]
    assert list(one(spark, N.semantic_type(F.lit("Account_Status")), N.semantic_type(F.lit("Account_Status"), "v2"))) == ["quantity", "quantity"]
    assert one(spark, N.name_tokens(F.lit("CustID")))[0] == ["customer", "identifier"]
    sim = lambda a, b: N.token_similarity(N.name_tokens(F.lit(a)), N.name_tokens(F.lit(b)))
    assert list(one(spark, sim("Customer_ID", "CustID"), sim("Customer_ID", "client_number"), sim("", "x"))) == [1.0, 0.0, 0.0]


def test_similarities(spark):
    jw = [("john smith", "jon smith", 0.97333), ("martha", "marhta", 0.96111), ("dwayne", "duane", 0.84), ("", "x", 0), (None, "x", 0), ("a", "a", 1)]
    for a, b, want in jw:
        assert S.jaro_winkler_value(a, b) == pytest.approx(want, abs=1e-5)
        assert S.jaro_winkler_value(b, a) == pytest.approx(want, abs=1e-5)
    codes = {"Pfister": "P123", "Ashcraft": "A261", "john smith": "J525", "Tymczak": "T520", "123 main": "1500", "a1b2": "A100", "": "0000"}
    assert list(one(spark, *[S.phonetic_code(F.lit(x)) for x in codes])) == list(codes.values())
    assert list(one(spark, S.exact(F.lit(" A\t"), F.lit("a")), S.levenshtein(F.lit(""), F.lit("")), S.token_jaccard(F.lit(""), F.lit(" ")), S.numeric(F.lit("100"), F.lit("100.5")), S.dates(F.lit("2024-01-01"), F.lit("2024-01-16")), S.numeric(F.lit("x"), F.lit("1")))) == pytest.approx([1, 0, 1, 1 - 0.5 / 100.5, 0.5, 0])


def test_labels(spark):
    lab = lambda x: one(spark, K.value_labels(F.lit(x)))[0]
    assert lab("1") == ["integer", "boolean"] and lab("N/A") == ["null"] and lab("hello") == ["string"] and lab("2024-01-02") == ["date_iso"] and lab("a@b.co") == ["email"] and lab("$1,200.50") == ["currency"]
    df = spark.createDataFrame([("1", "a", "yes", "", "2024-01-02"), ("2", "b", "no", "NULL", "2024-03-04"), (None, None, None, None, None)], "i string, s string, b string, n string, d string")
    assert {r[0]: r[1] for r in P.kinds(df).collect()} == {"i": "integer", "s": "string", "b": "boolean", "n": "null", "d": "date"}


def test_components_like_union_find(spark):
    rnd = random.Random(5)
    for n, m in ((30, 20), (40, 60), (12, 0)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n - 1)] if m == 60 else [])
        up = list(range(n))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        v = spark.range(n)
        e = spark.createDataFrame(edges, "a bigint, b bigint")
        assert {r["id"]: r["component"] for r in E.components(v, e).collect()} == {i: top(i) for i in range(n)}


def test_golden_record(spark):
    r = spark.createDataFrame([(1, "Ann", None), (2, "Ann Lee", ""), (3, "Bo", "x@y")], "id bigint, name string, mail string")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id bigint, component bigint")
    got = {x["component"]: (x["representative"], x["size"], x["name"], x["mail"]) for x in E.golden_records(r, c, ["name", "mail"]).collect()}
    assert got == {1: (1, 2, "Ann Lee", None), 3: (3, 1, "Bo", "x@y")}


def test_trained_weights():
    w = E.trained_weights([({"name": 1.0, "id": 1.0}, True), ({"name": 1.0}, False)])
    assert sum(w.values()) == pytest.approx(1) and w["name"] > E.WEIGHTS["name"]


def test_folds_in_order(spark):
    rnd = random.Random(1)
    data = [(k, i, rnd.random()) for k in "ab" for i in range(700)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    want = {}
    for k, _, v in data:
        want[k] = 0.1 * v + 0.9 * want.get(k, 0.5)
    assert {r["k"]: r["ema"] for r in V.moving_average(df, "k", ["i"], F.col("v")).collect()} == pytest.approx(want)
    w = V.online_weights(spark.createDataFrame([("p", 1, True), ("q", 1, False)], "k string, i int, ok boolean"), "k", ["i"], F.col("ok"))
    assert {r["k"]: r["weight"] for r in w.collect()} == pytest.approx({"p": 0.505, "q": 0.495})


def test_suggestions(spark):
    c = spark.createDataFrame([("cust_id", "customer_id", "approved", 1), ("amt", "total_amount", "corrected", 1), ("amt", "x", "approved", 9)], "source_field string, target_field string, status string, n bigint")
    assert {r[0]: (r[1], round(r[2], 6)) for r in V.suggestions(c).collect()} == {"cust_id": ("customer_id", 0.6), "amt": ("total_amount", 0.7)}


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "b", 1), (3, "C", 1), (4, "d", None)], "k int, s string, n int")
    log = L.changes(old, new, "k")
    assert sorted((r["k"], r["change_type"]) for r in log.collect()) == [(1, "delete"), (3, "update_postimage"), (3, "update_preimage"), (4, "insert")]
    assert sorted(map(tuple, L.applied(old, log.withColumn("v", F.lit(1)), "k", "v").collect())) == sorted(map(tuple, new.collect()))
    with pytest.raises(ValueError):
        L.upsert(old, new.union(new), "k")


def test_union_widens_and_registry(spark):
    a, b = spark.createDataFrame([("x1", 1)], "id string, n int"), spark.createDataFrame([(5, 2.5, True)], "id int, n double, ok boolean")
    u = U.united({"a": a, "b": b})
    assert dict(u.dtypes) == {"id": "string", "n": "double", "_source": "string", "ok": "boolean"} and u.count() == 2
    with pytest.raises(ValueError):
        U.renamed(b, {"id": "n"})
    reg = U.Registry(spark)
    reg.register("a", a, {"id": "key"})
    reg.correct("a", "n", "count")
    assert set(reg.bind("v").columns) == {"key", "count", "_source"}
    assert reg.query("SELECT broken FROM v", strict=False).count() == 0 and "Plan" in reg.explain("SELECT * FROM v")


def test_sql_helpers():
    p = U.parsed_select("SELECT a, count(*) FROM t WHERE a > 1 AND b = 'X'\nGROUP BY a ORDER BY a LIMIT 5")
    assert p == {"fields": ["a", "count(*)"], "tables": ["t"], "conditions": ["a > 1", "b = 'X'"], "group_by": ["a"], "order_by": ["a"], "limit": 5}
    assert U.rewritten("id = 'id' AND id2 > 1", {"id": "CustID"}) == "CustID = 'id' AND id2 > 1"
    assert len(U.advice("SELECT * FROM t", 2)) == 3 and U.advice("SELECT 1", 0.01) == ["fast enough"]
    assert U.Assistant().to_sql("how many orders per status", "v", ["status"]).endswith("GROUP BY status")
    assert M.view_sql("u", ["id", "x"], {"t": {"id": "CustID"}}) == "CREATE OR REPLACE TEMP VIEW `u` AS SELECT `CustID` AS `id`, NULL AS `x` FROM `t`"
    assert [len(b) for b in Q.batches(["x" * 8] * 5, most=2)] == [2, 2, 1] and Q.batches(["x" * 99999], most=2) == [["x" * 99999]]


def test_cache():
    c = Q.Cache(2)
    for k in "abac":
        if c.get(k) is None:
            c.put(k, k)
    assert c.get("a") == "a" and c.get("b") is None and c.hit_rate() == pytest.approx(2 / 6)


def test_one_to_one(spark):
    s = spark.createDataFrame([("a", "x", 0.95, 1), ("b", "x", 0.99, 2), ("b", "y", 0.7, 2), ("c", "z", 0.3, 3)], "source_field string, target_field string, score double, source_place int")
    assert sorted(tuple(r)[:2] + (r["mapping_type"],) for r in M.one_to_one(s).collect()) == [("a", "x", "direct"), ("b", "y", "fuzzy")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id bigint, a bigint, b bigint, value double")
    assert E.components(e.select("id"), e.select("a", "b")).count() == 0
    assert P.profile_numeric(e).count() == 4 and P.completeness(e).first()["cells"] == 0
