from conftest import DATA

import numpy as np

from braidwork.llm.readability import LevelRules, fit_levels, fit_trees, is_english_prose, reading_levels, sentences


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = 2.0 * (x[:, 1] > 0) + (x[:, 3] > 1)
    model = fit_trees(x[:400], y[:400], LevelRules(rounds=80))
    assert np.abs(model.predict(x[400:]) - y[400:]).mean() < 0.15


def test_language():
    en = "The customer found the same list in the drawer and then it was sent to the office. " * 3
    assert is_english_prose(sentences(en), 30) and not is_english_prose(sentences(en[:60]), 30)
    assert not is_english_prose(sentences("Die Mappe fehlt noch, und die alte Liste liegt im Schrank, sagt der Fahrer. " * 4), 30)
    assert not is_english_prose(sentences("id;name;since 12;CUST9;2024 " * 20), 30) and not is_english_prose(sentences(""), 30)


def test_held_out_accuracy(spark):
    d = f"{DATA}/sf0.1"
    report = fit_levels(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/level_labels.parquet")).report
    assert report["rated"] > 700 and report["exact"] > 0.9 and report["within_one"] > 0.98


def test_served_like_trained(spark):
    d = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/level_labels.parquet")
    got = {r["doc_id"]: r["level"] for r in reading_levels(docs, labels).collect()}
    rated = {r["doc_id"]: r["level"] for r in labels.collect()}
    assert np.mean([got[i] == y for i, y in rated.items() if i in got]) > 0.85 and set(got.values()) == {1, 2, 3, 4, 5}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "s", 1), (3, "The list was in the drawer and it was not the list of the shop. " * 2000, "s", 1), (3, "The list was in the drawer and it was not the list of the shop. " * 4, None, 1)], "doc_id bigint, text string, source string, level int")
    none = spark.createDataFrame([], "doc_id bigint, level int")
    assert [r["level"] for r in reading_levels(docs, none).collect()] == [3, 3]
    assert reading_levels(docs.limit(0), none).count() == 0
    few = spark.createDataFrame([(3, 2), (3, 2), (9, None), (1, 7)], "doc_id bigint, level int")
    assert {r["level"] for r in reading_levels(docs, few).collect()} == {2}
