"""The pairs of the similarity queries are held against every pair."""

import datetime as dt
import random

from pyspark.sql import functions as F

from braidwork.operators import entities as E
from braidwork.plans import reference_queries as R
from braidwork.plans.reference_queries import QUERIES


def test_orders_of_a_customer_that_are_not_consecutive(spark, tmp_path):
    rnd = random.Random(5)
    first = dt.datetime(2020, 1, 1)
    data = [(i, i % 3, rnd.choice([0.0, 100.0, 100.9, 101.0, 101.1, -100.0, rnd.uniform(90, 120)]), first + dt.timedelta(days=rnd.randint(0, 400))) for i in range(120)]
    spark.createDataFrame(data, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for i, ci, x, s in data:
        for j, cj, y, t in data:
            if i < j and ci == cj:
                price = 1.0 if x == y else 1 - abs(x - y) / max(abs(x), abs(y))
                price, gap = price if price >= 0.99 else 0.0, abs((s - t).days)
                date = 1 - gap / 30 if gap <= 30 else 0.0
                if price > 0 or date > 0:
                    want[i, j] = (round(price, 6), round(date, 6))
    out = QUERIES["numeric_date_pairs"](spark, str(tmp_path)).collect()
    got = {(r["id1"], r["id2"]): (r["price_score"], r["date_score"]) for r in out}
    assert len(out) == len(got) and got == want
    consecutive = {(r["id1"], r["id2"]) for r in QUERIES["numeric_date_similarity"](spark, str(tmp_path)).collect()}
    assert want.keys() - consecutive


def test_candidates_and_links_of_all_surveyed_keys(spark, tmp_path):
    rnd = random.Random(6)
    names = ["red bolt", "bolt red", "red bolts", "xed bolt", "old gear", "zq", "", None]
    data = [(i, rnd.choice(names), rnd.choice(["Brand#1", "Brand#2", "Other#1", None]), rnd.choice(["A", "B"]), rnd.choice([3, 7, 250, -250, 950])) for i in range(1, 71)]
    spark.createDataFrame(data, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    blocks = R._part_blocks(spark, str(tmp_path))
    every = {tuple(r) for r in E.candidate_pairs(blocks).collect()}
    assert {tuple(r) for r in E.salted_pairs(blocks, 4).collect()} == every
    held = {}
    for r in blocks.collect():
        held.setdefault(r["id"], set()).add(r["block"])
    first = {}
    for i in sorted(held):
        first.setdefault(frozenset(held[i]), i)
    want = {}
    for i, j in every:
        at = tuple(sorted((first[frozenset(held[i])], first[frozenset(held[j])])))
        want[at] = want.get(at, 0) + 1
    assert {(r["class1"], r["class2"]): r["pairs"] for r in QUERIES["candidate_class_pairs"](spark, str(tmp_path)).collect()} == want
    name, top = {i: n for i, n, *_ in data}, {i: i for i, *_ in data}
    df = spark.createDataFrame([(i, j, name[i], name[j]) for i, j in every if name[i] and name[j]], "i bigint, j bigint, a string, b string")
    linked = [(r["i"], r["j"]) for r in df.where(E.name_score(F.col("a"), F.col("b"), with_jaro=False) >= 0.7).collect()]
    while any(top[i] != top[j] for i, j in linked):
        for i, j in linked:
            top[i] = top[j] = min(top[i], top[j])
    assert {r["id"]: r["component"] for r in QUERIES["er_pipeline"](spark, str(tmp_path)).collect()} == top


def test_names_that_differ_in_their_first_letters(spark, tmp_path):
    names = ["red bolt", "bolt red", "erd bolt", "red bolt", "Xed", None]
    spark.createDataFrame(list(enumerate(names)), "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {(a, b) for a in names for b in names if a and b and a < b}
    for q in ("jaro_winkler_pairs", "levenshtein_all_pairs", "token_jaccard_all_pairs"):
        got = {(r["a"], r["b"]): r["score"] for r in QUERIES[q](spark, str(tmp_path)).collect()}
        assert got.keys() == want, q
    assert got["bolt red", "red bolt"] == 1.0
