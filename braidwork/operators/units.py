"""Quantities recorded in different units: prices in unlike currencies and scales, brought to US cents.

The identity among the columns is amount x scale x rate = value in US dollars. What the row says about its unit (the
currency text, clauses of the description) bars combinations of currency and scale; among those left, the combination
with the least log residual against the value that the other rows of the same product agree on is chosen. That holds for
rows whose statements leave several combinations, too, as for those that state none. Rows for which no combination is
clearly nearest are flagged as non-unique.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut

# How whole units, small units and no unit at all are written, after lower-casing and squeezing blanks.
WHOLE = {
    "USD": ("usd", "us dollars", "us dollar", "u.s. dollar", "u.s. dollars", "dollar (us)", "dollars (us)", "us$", "$", "dollars", "dollar"),
    "EUR": ("eur", "euro", "euros", "€"),
    "GBP": ("gbp", "pound sterling", "pounds sterling", "british pounds", "british pound", "£", "pounds", "pound"),
    "CHF": ("chf", "swiss francs", "swiss franc", "fr.", "sfr.", "francs"),
    "JPY": ("jpy", "yen", "japanese yen", "¥"),
    "KWD": ("kwd", "kd", "kuwaiti dinar", "kuwaiti dinars", "dinars"),
}
SMALL = {
    "USD": ("¢", "usc", "us-cent", "us-cents", "us cent", "us cents", "usd cent", "usd cents", "cents (usd)", "cents (us)", "cents of a us dollar"),
    "EUR": ("eurocent", "eurocents", "euro cent", "euro cents", "eur cents", "eur-cent", "eur-cents", "cent €", "cents €", "ct (eur)", "cents (eur)"),
    "GBP": ("p", "gbx", "pence", "penny", "pence sterling", "penny (gb)", "penny sterling"),
    "CHF": ("rappen", "rp.", "centimes (chf)", "centimes", "cents (chf)"),
    "KWD": ("fils", "fils (kwd)", "kuwaiti fils"),
}
# Small units of several currencies.
SHARED_SMALL = {a: ("USD", "EUR") for a in ("cent", "cents", "ct", "cts")}
SMALL_PER_WHOLE = {"USD": 100, "EUR": 100, "GBP": 100, "CHF": 100, "KWD": 1000}
# Phrases that state the unit of the price, before the unit; and phrases that state a scale only.
UNIT_PHRASES = (
    "listed in", "price quoted in", "quoted in", "unit of price:", "feed counts in", "all figures:", "figure shown is in", "figures shown are in", "preis in",
    "charged in", "price is stated in", "prices on this sheet are", "amount given in", "amount is given in", "catalogue figure:", "figure in", "stated in", "priced in",
)
HUNDREDTH_PHRASES = (r"(?:price|amount|figure) is (?:entered |held |given )?in hundredths", r"held in cents", r"price as whole cents", r"price field counts the small coin, 100 to one")
THOUSAND_PHRASES = (r"(?:price|amount|figure) (?:is (?:entered |held |given )?)?in thousands", r"price figure is x ?1,?000")


def _aliases() -> dict[str, tuple[str, float]]:
    """Every way of writing a unit of one currency, with that currency and how many whole units one of it is, thousands included."""
    out = {a: (c, 1.0) for c, names in WHOLE.items() for a in names}
    out |= {a: (c, 1 / SMALL_PER_WHOLE[c]) for c, names in SMALL.items() for a in names}
    for c, names in WHOLE.items():
        for a in names:
            forms = (f"k{a}", f"t{a}", f"thousand {a}", f"thousands of {a}", f"1000 {a}", f"1,000 {a}", f"{a} '000", f"{a} x1000", f"{a} (thousands)", f"{a} thousands", f"units of 1,000 {a}", f"units of 1000 {a}")
            out |= {f: (c, 1000.0) for f in forms if f not in out}
            if c in SMALL_PER_WHOLE:
                n = SMALL_PER_WHOLE[c]
                out |= {f: (c, 1 / n) for f in (f"{a}/{n}", f"1/{n} {a}") if f not in out}
    return out


ALIASES = _aliases()


@dataclass(frozen=True)
class UnitRules:
    """margin: least distance in log residual between the best and the next reading of a row whose text bars neither."""

    margin: float = 0.7
    scales: tuple[float, ...] = (1.0, 0.01, 0.001, 1000.0)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _reading(currency: str | Column, scale: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(currency).alias("currency"), lit(scale).alias("scale"))


def _alias_map() -> Column:
    readings = {a: [unit] for a, unit in ALIASES.items()} | {a: [(c, 1 / SMALL_PER_WHOLE[c]) for c in cs] for a, cs in SHARED_SMALL.items()}
    return F.create_map(*itertools.chain.from_iterable((F.lit(a), F.array(*[_reading(c, s) for c, s in units])) for a, units in readings.items()))


def _regex(text: str) -> str:
    return "".join("\\" + ch if ch in r".()$'/^+*?[]{}|\\" else ch for ch in text)


def stated_units(products: DataFrame) -> DataFrame:
    """rec_id, product, amount, readings, scales: what each row's own text leaves of currency and scale.

    readings (currency, scale): all that the currency text and the unit clauses of the description leave, empty if they
    name no unit. Their currency is what all of them allow, or any that one of them names if they contradict each other.
    A scale that the description states replaces the one that the currency text implies; if it states several, each
    is a reading. scales: those stated by themselves, empty if there are none.
    """
    amap = _alias_map()
    raw = F.trim("price.currency")
    # pence are told from pounds by the case of one letter
    field = F.when(raw == "GBp", F.array(_reading("GBP", 0.01))).otherwise(F.try_element_at(amap, _squeezed(raw)))
    text = F.concat(F.lit(" "), _squeezed(F.coalesce("description", F.lit(""))), F.lit(" "))
    # in running text a scale word stands before its unit; after it, it may begin another sentence
    spoken = [a for a in (*ALIASES, *SHARED_SMALL) if not a.endswith(("'000", "x1000", "thousands", "(thousands)"))]
    names = "|".join(_regex(a) for a in sorted(spoken, key=lambda a: (-len(a), a)))
    clauses = F.transform(F.regexp_extract_all(text, F.lit(rf"(?:{'|'.join(_regex(p) for p in UNIT_PHRASES)}) ({names})(?![a-z0-9])"), F.lit(1)), lambda c: F.try_element_at(amap, c))
    scales = F.array_compact(F.array(F.when(text.rlike("|".join(HUNDREDTH_PHRASES)), F.lit(0.01)), F.when(text.rlike("|".join(THOUSAND_PHRASES)), F.lit(1000.0))))
    d = products.select("rec_id", F.col("id").alias("product"), F.col("price.amount").alias("amount"), field.alias("field"), clauses.alias("clauses"), scales.alias("scales"))
    d = d.withColumn("said", F.concat("clauses", F.array_compact(F.array("field"))))
    codes = lambda units: F.transform(units, lambda u: u["currency"])
    named = F.array_distinct(F.flatten(F.transform("said", codes)))
    common = F.filter(named, lambda c: F.forall("said", lambda units: F.exists(units, lambda u: u["currency"] == c)))
    of = lambda units, c: F.array_distinct(F.transform(F.filter(units, lambda u: u["currency"] == c), lambda u: u["scale"]))
    told = lambda c: of(F.flatten("clauses"), c)
    scale = lambda c: F.when(F.size("scales") > 0, F.col("scales")).when(F.size(told(c)) > 0, told(c)).otherwise(of(F.col("field"), c))
    every = F.flatten(F.transform(F.when(F.size(common) > 0, common).otherwise(named), lambda c: F.transform(scale(c), lambda s: _reading(c, s))))
    plain = F.col("field").isNotNull() & (F.size("clauses") == 0) & (F.size("scales") == 0)
    return d.select("rec_id", "product", "amount", F.when(plain, F.col("field")).otherwise(every).alias("readings"), "scales")


def normalise_prices(products: DataFrame, rates: DataFrame, rules: UnitRules = UnitRules()) -> DataFrame:
    """rec_id, currency, scale, usd_cents, residual, unit_status of each row with an amount.

    unit_status: known (the row's text leaves one combination), ranked (it names several, and one is nearer to the
    value of the other rows of its product than any other by rules.margin), inferred (the same, but it names no
    currency), non_unique, or unknown (it names no currency and there are no rows to compare, or none with a rate).
    usd_cents is rounded to the nearest whole number and null where no combination is chosen. residual is the log of
    the value over the median of the product's known values, null without such.
    Rows with a null price or amount, or one that isn't finite, have no case. Repeated rows come out each; a currency
    without a positive rate counts as none; empty tables give no rows; extra columns are ignored.
    """
    rate = rates.where("usd_per_unit > 0 and currency_code is not null").groupBy("currency_code").agg(F.max("usd_per_unit").alias("rate"))
    rate = rate.where(F.col("currency_code").isin(*WHOLE))  # at most the currencies of WHOLE
    d = stated_units(products.where("price.amount is not null and not isnan(price.amount) and abs(price.amount) < 1e300"))
    one, several = F.size("readings") == 1, F.size("readings") > 1
    # the texts are parsed once; rows of one reading carry no lists
    d = cut(d.select("rec_id", "product", "amount", F.when(one, F.col("readings")[0]["currency"]).alias("currency"), F.when(one, F.col("readings")[0]["scale"]).alias("scale"), F.when(several, F.col("readings")).alias("readings"), F.when(~one & ~several & (F.size("scales") > 0), F.col("scales")).alias("scales")))
    known = d.join(F.broadcast(rate), F.col("currency") == F.col("currency_code"), "left")
    known = known.withColumn("usd", F.col("amount") * F.col("scale") * F.col("rate"))
    level = (
        known.where("usd > 0 and product is not null")
        .groupBy("product")
        .agg(F.percentile_approx(F.ln("usd"), 0.5).alias("level"))
    )
    known = known.join(level, "product", "left")
    settled = known.where("usd is not null").select(
        "rec_id", "currency", "scale", F.round(F.col("usd") * 100).cast("bigint").alias("usd_cents"),
        F.when(F.col("usd") > 0, F.ln("usd") - F.col("level")).alias("residual"), F.lit("known").alias("unit_status"),
    )
    # what the text leaves open: the combinations that it doesn't bar, ranked by their log residual
    priced = F.broadcast(rate.agg(F.collect_list(F.struct("currency_code", "rate")).alias("rates")))
    open_ = known.where("usd is null").select("rec_id", "amount", "level", F.when(F.col("currency").isNotNull(), F.array(_reading(F.col("currency"), F.col("scale")))).otherwise(F.col("readings")).alias("readings"), "scales").join(priced)
    value = lambda k, s: F.col("amount") * k["rate"] * s
    tried = lambda k, s: F.struct(F.abs(F.ln(value(k, s)) - F.col("level")).alias("gap"), k["currency_code"].alias("currency"), s.alias("scale"), value(k, s).alias("usd"))
    named = F.flatten(F.transform("readings", lambda r: F.transform(F.filter("rates", lambda k: k["currency_code"] == r["currency"]), lambda k: tried(k, r["scale"]))))
    every = F.flatten(F.transform("rates", lambda k: F.transform(F.coalesce("scales", F.array(*map(F.lit, rules.scales))), lambda s: tried(k, s))))
    stated, comparable = F.col("readings").isNotNull(), (F.col("amount") > 0) & F.col("level").isNotNull()
    open_ = open_.withColumns({"tried": F.array_sort(F.when(stated, named).otherwise(every)), "stated": stated, "comparable": F.coalesce(comparable, F.lit(False))})
    best, nxt, n = F.get("tried", F.lit(0)), F.get("tried", F.lit(1)), F.size("tried")
    unique = (n == 1) & F.col("stated") | F.col("comparable") & (n >= 1) & (nxt.isNull() | (nxt["gap"] - best["gap"] >= rules.margin))
    status = F.when(unique & F.col("stated"), F.lit("ranked")).when(unique, F.lit("inferred")).when((n >= 1) & (F.col("stated") | F.col("comparable")), F.lit("non_unique")).otherwise(F.lit("unknown"))
    left = open_.select(
        "rec_id", F.when(unique, best["currency"]).alias("currency"), F.when(unique, best["scale"]).alias("scale"), F.when(unique, F.round(best["usd"] * 100).cast("bigint")).alias("usd_cents"),
        F.when(unique, best["gap"]).alias("residual"), status.alias("unit_status"),
    )
    return settled.unionByName(left)
