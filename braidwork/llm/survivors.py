"""Best representative of each group of duplicate records, field by field.

A two-sided latent quality model weighs the values: every value that some record of a customer claims is true or not,
an entry channel (trust rank) claims true values with its sensitivity and stays away from false ones with its
specificity. Expectation-maximisation runs over counts of claim patterns, a table whose size depends on the number of
channels only. Several values of one field may be judged true, and all of them are kept.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.linkage import REGISTERS
from braidwork.llm.names import ABSENT
from braidwork.operators.instants import table_instants
from braidwork.session import cut

# The field that survives in each register.
SURVIVING = {"customers_v1": "Account_Status", "customers_v2": "SignupDate", "customers_v3": "email_addr"}
_CHANNELS = 63


@dataclass(frozen=True)
class SurvivorRules:
    """judged_true: least posterior of a value that is kept in the list of true values."""

    judged_true: float = 0.5
    rounds: int = 40
    prior: float = 0.5


def usable_status(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))).isin(*ABSENT)


def usable_address(c: Column) -> Column:
    """One @ between a name and a host that contains a dot; wrapping and outer blanks don't count."""
    bare = F.regexp_replace(c, r"^\s*(?i:mailto:)?[<\s]*|[>\s]*$", "")
    return F.coalesce(bare.rlike(r"^[^@]*[^@\s][^@]*@[^@]+$") & F.substring_index(bare, "@", -1).contains("."), F.lit(False))


def surviving_claims(tables: dict[str, DataFrame]) -> DataFrame:
    """src_table, number, rec_id, trust_rank, updated_at, value, usable: each record with a number, with its surviving field as compared."""
    parts = []
    dates = None
    if "customers_v2" in tables:
        dates = table_instants({"customers_v2": tables["customers_v2"]}).where("status in ('resolved', 'ambiguous')").select("rec_id", F.col("utc_micros").cast("string").alias("instant")).dropDuplicates(["rec_id"])
    for t, field in SURVIVING.items():
        if t not in tables:
            continue
        digits = F.regexp_replace(F.regexp_replace(F.col(REGISTERS[t][0]).cast("string"), r"\D", ""), "^0+(?=.)", "")
        d = tables[t].select(F.lit(t).alias("src_table"), digits.alias("number"), "rec_id", "trust_rank", "updated_at", F.col(field).cast("string").alias("raw"))
        if t == "customers_v2":
            d = d.join(dates, "rec_id", "left").select("src_table", "number", "rec_id", "trust_rank", "updated_at", F.col("instant").alias("value"), F.col("instant").isNotNull().alias("usable"))
        elif t == "customers_v1":
            d = d.select("src_table", "number", "rec_id", "trust_rank", "updated_at", F.lower(F.trim("raw")).alias("value"), usable_status(F.col("raw")).alias("usable"))
        else:
            bare = F.lower(F.regexp_replace("raw", r"^\s*(?i:mailto:)?[<\s]*|[>\s]*$", ""))
            d = d.select("src_table", "number", "rec_id", "trust_rank", "updated_at", bare.alias("value"), usable_address(F.col("raw")).alias("usable"))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("number is not null and number <> ''")


def fit_channels(patterns: list[tuple[str, int, int, int]], rules: SurvivorRules) -> dict[tuple[str, int, int], float]:
    """Posterior that a value is true, per table, channels that claim it and channels that claim anything for its customer."""
    by = defaultdict(list)
    for t, claimed, present, n in patterns:
        by[t].append((claimed, present, n))
    out = {}
    for t, rows in by.items():
        sens, spec, prior = [0.8] * _CHANNELS, [0.8] * _CHANNELS, rules.prior
        post = {}
        for _ in range(rules.rounds):
            for claimed, present, _n in rows:
                a, b = prior, 1 - prior
                for i in range(_CHANNELS):
                    if present >> i & 1:
                        c = claimed >> i & 1
                        a *= sens[i] if c else 1 - sens[i]
                        b *= 1 - spec[i] if c else spec[i]
                post[claimed, present] = a / (a + b) if a + b else prior
            total = sum(n for _, _, n in rows)
            prior = min(0.99, max(0.01, sum(post[c, p] * n for c, p, n in rows) / total))
            for i in range(_CHANNELS):
                tp, t_all, tn, f_all = 4.0, 5.0, 4.0, 5.0
                for c, p, n in rows:
                    if p >> i & 1:
                        q = post[c, p]
                        t_all, f_all = t_all + q * n, f_all + (1 - q) * n
                        tp, tn = tp + q * n * (c >> i & 1), tn + (1 - q) * n * (1 - (c >> i & 1))
                sens[i], spec[i] = min(0.99, tp / t_all), min(0.99, tn / f_all)
        out |= {(t, c, p): q for (c, p), q in post.items()}
    return out


def judged_values(claims: DataFrame, rules: SurvivorRules = SurvivorRules()) -> DataFrame:
    """src_table, number, value, posterior: every usable value of every customer number, with the probability that it is true."""
    bit = F.expr(f"shiftleft(1L, cast(least(greatest(coalesce(trust_rank, 0), 0), {_CHANNELS - 1}) AS int))")
    by_value = claims.where("usable").groupBy("src_table", "number", "value").agg(F.bit_or(bit).alias("claimed"))
    by_number = by_value.groupBy("src_table", "number").agg(F.bit_or("claimed").alias("present"))
    d = by_value.join(by_number, ["src_table", "number"])
    seen = d.groupBy("src_table", "claimed", "present").count().collect()  # at most tables x 2^channels x 2^channels, few channels are ever seen together
    post = fit_channels([(r["src_table"], r["claimed"], r["present"], r["count"]) for r in seen], rules)
    table = claims.sparkSession.createDataFrame([(t, c, p, float(q)) for (t, c, p), q in post.items()], "src_table string, claimed bigint, present bigint, posterior double")
    return d.join(F.broadcast(table), ["src_table", "claimed", "present"]).select("src_table", "number", "value", "posterior")


def survivors(tables: dict[str, DataFrame], rules: SurvivorRules = SurvivorRules()) -> DataFrame:
    """src_table, number, rec_id, value, posterior, judged_rec_id, judged_value, true_values of each customer number with two or more records and a usable value.

    rec_id is the record that supplies the surviving value: of those with a usable one, the lowest trust_rank, then the
    latest updated_at, then the lowest rec_id; nulls come last. posterior is the quality model's for its value.
    judged_rec_id is the record that the model prefers: one with the value of the highest posterior, equal ones in the
    same order. true_values are all values judged true. Groups are folded by aggregation, so a number may hold any share
    of the rows. A record delivered twice counts twice. Numbers without a digit, and groups without usable value, have
    no case; tables may be empty; extra columns are ignored.
    """
    claims = cut(surviving_claims(tables))
    judged = judged_values(claims, rules)
    order = F.struct(F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("t"), F.coalesce(-F.unix_micros("updated_at"), F.lit(2**62)).alias("u"), F.col("rec_id").alias("r"))
    counts = claims.groupBy("src_table", "number").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    # of the records of one value only the first in order matters; the values then meet with their posteriors
    first = claims.where("usable").groupBy("src_table", "number", "value").agg(F.min(order).alias("o"))
    rated = first.join(judged, ["src_table", "number", "value"])
    best = rated.groupBy("src_table", "number").agg(
        F.min(F.struct("o", "value", "posterior")).alias("best"), F.min(F.struct((-F.col("posterior")).alias("doubt"), "o", "value")).alias("liked"),
        F.array_sort(F.collect_list(F.when(F.col("posterior") >= rules.judged_true, F.col("value")))).alias("true_values"),
    )
    return best.join(counts, ["src_table", "number"]).select("src_table", "number", F.col("best.o.r").alias("rec_id"), "best.value", "best.posterior", F.col("liked.o.r").alias("judged_rec_id"), F.col("liked.value").alias("judged_value"), "true_values")
