from braidwork.operators.units import normalise_prices
from braidwork.plans import core_queries

P = "rec_id bigint, id string, description string, price struct<amount:double,currency:string>, rate double, combos int"


def priced(spark, rows):
    rates = spark.createDataFrame([("USD", 1.0, "x"), ("EUR", 1.1, "x"), ("GBP", 1.3, "x"), ("JPY", 0.007, "x"), ("KWD", 3.0, "x"), ("CHF", 1.2, "x"), ("BAD", None, "x")], "currency_code string, usd_per_unit double, id string")
    df = spark.createDataFrame([(i, p, t, None if a == "none" else (a, c), 1.0, 1) for i, (p, a, c, t) in enumerate(rows)], P)
    return {r["rec_id"]: (r["unit_status"], r["usd_cents"]) for r in normalise_prices(df, rates).collect()}


def test_units_and_scales(spark):
    rows = [
        ("a", 10.0, "USD", None), ("a", 1000.0, "US cents", None), ("a", 0.01, "thousand USD", ""), ("a", 5.0, " EUR", ""), ("a", 500.0, "Eurocent", ""), ("a", 500.0, "p", ""), ("a", 5.0, "GBP ", ""), ("a", 500.0, "GBp", ""),
        ("a", 1000.0, "yen", ""), ("a", 1.0, "kJPY", ""), ("a", 2000.0, "fils", ""), ("a", 0.002, "KD '000", ""), ("a", 100.0, "Rp.", ""), ("a", 3.0, "$", ""), ("a", 100.0, "EUR", "Shop system keeps the price as whole cents."),
        ("a", 0.005, "EUR", "The price figure is x1000."), ("a", 7.0, "N/A", "Price quoted in Swiss francs. Slot fits yen and dollar notes."), ("a", 7.0, "", "Unit of price: USD Thousands sold since spring."),
        ("a", 0.7, None, "Amount is given in units of 1,000 yen."), ("a", 70.0, "see text", "(all figures: cents of a US dollar)"), ("a", 4.0, "EUR", "Weighs only a few hundredths of a kilo. Each carton of a thousand is sealed."),
    ]
    want = [1000, 1000, 1000, 550, 550, 650, 650, 650, 700, 700, 600, 600, 120, 300, 110, 550, 840, 700, 490, 70, 440]
    assert priced(spark, rows) == {i: ("known", w) for i, w in enumerate(want)}


def test_rows_without_unit(spark):
    got = priced(spark, [("a", 10.0, "USD", ""), ("a", 1000.0, "XXX", ""), ("b", 5.0, "??", ""), ("b", None, "USD", ""), ("b", "none", None, ""), (None, 2.0, "USD", ""), ("a", float("nan"), "USD", ""), ("a", -1.0, "?", "")])
    assert got == {0: ("known", 1000), 1: ("inferred", got[1][1]) if got[1][0] == "inferred" else ("non_unique", None), 2: ("unknown", None), 5: ("known", 200), 7: ("unknown", None)}


def test_empty_tables(spark):
    assert priced(spark, []) == {}


def test_query_of_all_rows(spark, tmp_path):
    rows = [(i, "a", "", (10.0, "USD")) for i in range(3)] + [(3, "a", "", (10.0, "?")), (4, "b", "", (5.0, "?")), (5, "b", "", None)]
    spark.createDataFrame(rows, "rec_id bigint, id string, description string, price struct<amount:double,currency:string>").write.parquet(f"{tmp_path}/products.parquet")
    spark.createDataFrame([("USD", 1.0), ("JPY", 0.007)], "currency_code string, usd_per_unit double").write.parquet(f"{tmp_path}/fx_rates.parquet")
    got = {r["rec_id"]: r.asDict() for r in core_queries.QUERIES["p3_units"](spark, str(tmp_path)).collect()}
    assert {i: r["unit_status"] for i, r in got.items()} == {0: "known", 1: "known", 2: "known", 3: "inferred", 4: "unknown"}
    assert (got[3]["currency"], got[3]["scale"], got[3]["usd_cents"]) == ("USD", 1.0, 1000) and got[3]["residual"] < 0.01


def test_units_that_the_residual_decides(spark, tmp_path):
    both = "Held in cents. The price figure is x1000."
    rows = [("a", 10.0, "USD", "")] * 3 + [
        ("a", 0.009, "EUR", both), ("a", 900.0, "EUR", both), ("a", 3.0, "yen", "Price quoted in KWD."), ("a", 1500.0, "yen", "Price quoted in KWD."), ("a", 9.0, "EUR", "Price quoted in GBP. Feed counts in 1,000 GBP."),
        ("a", 9.0, "EUR", "Price quoted in US dollars."), ("b", 9.0, "EUR", both), ("a", 900.0, "cents", ""), ("a", -9.0, "EUR", both), ("a", 900.0, "EUR", "Price quoted in cents."), ("a", 140000.0, "?", "Held in cents."), ("a", 950.0, "?", "Held in cents."),
    ]
    want = [("known", 1000)] * 3 + [
        ("ranked", 990), ("ranked", 990), ("ranked", 900), ("ranked", 1050), ("non_unique", None),
        ("non_unique", None), ("non_unique", None), ("non_unique", None), ("non_unique", None), ("known", 990), ("inferred", 980), ("non_unique", None),
    ]
    assert priced(spark, rows) == dict(enumerate(want))
    spark.createDataFrame([(i, p, t, (a, c)) for i, (p, a, c, t) in enumerate(rows)], "rec_id bigint, id string, description string, price struct<amount:double,currency:string>").write.parquet(f"{tmp_path}/products.parquet")
    spark.createDataFrame([("USD", 1.0), ("EUR", 1.1), ("GBP", 1.3), ("JPY", 0.007), ("KWD", 3.0), ("CHF", 1.2)], "currency_code string, usd_per_unit double").write.parquet(f"{tmp_path}/fx_rates.parquet")
    assert {tuple(r) for r in core_queries.QUERIES["p3_found"](spark, str(tmp_path)).collect()} == {(i, w[1]) for i, w in enumerate(want) if w[0] in ("known", "ranked")}
