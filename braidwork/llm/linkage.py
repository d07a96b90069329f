"""Matching customers across registers without keys: soft-logic linkage solved by distributed alternating directions.

Each register's customer number is one customer of that register. Candidate pairs share a block key, however
many customers hold it; those without evidence are told apart where they meet. Every pair is a variable in
[0, 1]. Weighted evidence pulls it to the odds that its names, addresses and dates give, as estimated from the tables at
hand; exclusivity (a customer has one number in a register) and transitivity are hinge potentials. The sum is convex;
ADMM solves it, one row per potential and variable, so no component is gathered. Potentials come in as they are violated
until none is left, so the solution is that of all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.names import GIVEN, email_key, fulls, is_given, parse
from braidwork.operators.instants import DATE_COLUMNS, DECLARED, InstantRules, normalise_instants
from braidwork.session import cut, discard, map_batches, release, store

# The columns of each register.
REGISTERS = {"customers_v1": ("Customer_ID", "Full_Name", "Email_Address"), "customers_v2": ("CustID", "CustomerName", "ContactEmail"), "customers_v3": ("client_number", "name", "email_addr")}
DAY = 86_400
BAND = 40 * DAY
#: Levels of agreement, from the least to the most. Absent: one side has no value.
NAMES = ("conflict", "absent", "initial", "full")
ADDRESSES = ("absent", "unlike", "near", "same")
DATES = ("absent", "far", "month", "week", "day", "second")


@dataclass(frozen=True)
class LinkRules:
    """hot: in candidate_pairs only, a block key with more customers of one register than this gives way to narrower keys.

    exclusive, transitive: weights of the rules. rho, relax, tolerance, rounds: step, over-relaxation, largest primal
    and dual residual, and most rounds of the solver. least: confidence of a link. sure: confidence of evidence that implies further pairs.
    piece: a customer of more distinct records than this is compared in several pieces.
    """

    hot: int = 100
    exclusive: float = 8.0
    transitive: float = 8.0
    rho: float = 1.0
    relax: float = 1.6
    tolerance: float = 0.005
    rounds: int = 200
    least: float = 0.5
    sure: float = 0.73
    piece: int = 64


def numbered_records(tables: dict[str, DataFrame]) -> DataFrame:
    """src_table, register (1, 2, ...), rec_id, customer, name, email, date (as written), src_zone: all records of the registers.

    customer is register:number, the number without prefix, marks and leading zeros; a record without any digit in its
    number is a customer of its own.
    """
    parts = []
    for i, (t, (num, name, email)) in enumerate(REGISTERS.items(), 1):
        if t in tables:
            digits = F.regexp_replace(F.regexp_replace(F.col(num).cast("string"), r"\D", ""), "^0+(?=.)", "")
            own = F.when(F.coalesce(digits, F.lit("")) == "", F.concat(F.lit("r"), F.col("rec_id"))).otherwise(digits)
            date = F.col(DATE_COLUMNS[t]).cast("string").alias("date")
            parts.append(tables[t].select(F.lit(t).alias("src_table"), F.lit(i).alias("register"), F.col("rec_id").cast("bigint").alias("rec_id"), F.concat_ws(":", F.lit(i), own).alias("customer"), F.col(name).cast("string").alias("name"), F.col(email).cast("string").alias("email"), date, "src_zone"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def customer_records(tables: dict[str, DataFrame]) -> DataFrame:
    """src_table, register, rec_id, customer, name, email, second: the numbered records. second is null where the date can't be read."""
    keep = ["src_table", "register", "rec_id", "customer", "name", "email"]
    read = normalise_instants(numbered_records(tables), "src_table", "date", "src_zone", keep, InstantRules(declared=DECLARED))
    return read.select(*keep, F.floor(F.col("utc_micros") / 1_000_000).cast("bigint").alias("second"))


# --- block keys ---------------------------------------------------------------------------------------------------


def _skeleton(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiouy\W]", "", word))


def _name_keys(kind: str, family: str, given: str) -> list[str]:
    """A firm's own word; a person's family name, or a part of it, with each full given name."""
    if kind == "firm":
        return [f"f:{family}"]
    if kind != "person" or not family or not given or given.endswith("."):
        return []
    return [f"n:{part}|{g}" for part in dict.fromkeys((family, *family.split("-"))) if part for g in sorted(fulls(given))]


def _initials(kind: str, given: str) -> list[str]:
    return ["#"] if kind == "firm" else sorted({g[:1] for g in fulls(given)}) if given else [""]


def _loose_keys(kind: str, family: str, given: str) -> tuple[list[str], list[str]]:
    """Keys that pair with any other, and keys that pair with those only: the first and the last three consonants of the
    family name, of which one slip leaves one as it is, with the given name, or its initial where one side has no more
    or a given name that may be a slip.
    """
    if kind == "absent" or not (family or given):
        return [], []
    bones = _skeleton(family) or family
    ends = [f"a:{bones[:3]}", f"z:{bones[-3:]}"]
    short = [f"{e}|{i}" for e in ends for i in _initials(kind, given)]
    if kind == "firm" or len(given.rstrip(".")) < 2 or given.endswith("."):
        return short, []
    full = [f"{e}||{g}" for e in ends for g in sorted(fulls(given))]
    return (full, short) if is_given(given) else (full + short, [])


def _half(n: int) -> int:
    return 2 * (n // 4) if n >= 8 else max(1, n // 2)


def _address_keys(email: str, kind: str, given: str) -> list[str]:
    """The address; its letters in order of the alphabet; and its first and last half with an initial, one of which a slip leaves as it is.

    Each length that a slip makes has halves in common with the others.
    """
    local, host = email.split("@")
    bare = re.sub(r"[\W_]", "", local) or local
    halves = {_half(n) for n in (len(bare) - 1, len(bare), len(bare) + 1)}
    return [f"e:{email}", f"l:{''.join(sorted(bare))}@{host[:2]}"] + [f"{side}{k}:{part}@{host}|{i}" for k in sorted(halves) for side, part in (("p", bare[:k]), ("s", bare[-k:])) for i in _initials(kind, given)]


_NAME = "struct<kind:string,family:string,given:string,dotted:boolean,known:boolean,fulls:array<string>,rest:array<string>>"
_VARIANT = f"customer string, register int, name {_NAME}, email string, second bigint, sigs array<struct<f:string,bits:bigint>>, nk array<string>, ak array<string>, ik array<string>, jk array<string>"


def _signature(kind: str, family: str, given: str, email: str | None) -> tuple[str | None, int]:
    """Family name or firm's word, null where there is none; and 62 bits: 20 for a given name's full forms, 1 for a firm, 6 for the address's host, 30 for the letters before the host and 5 for their number, 0 if there is no address.

    A given name that is short, missing or may be a slip has all bits of persons, no name has all 21.
    """
    if kind == "absent":
        bits = (1 << 21) - 1
    elif kind == "firm":
        bits = 1 << 20
    else:
        bits = sum({1 << crc32(f.encode()) % 20 for f in fulls(given)}) if given in GIVEN and len(given) > 1 else (1 << 20) - 1
    local, host = email.split("@") if email else ("", "")
    letters = 0
    for ch in local:
        letters |= 1 << ord(ch) % 30
    place = crc32(host.encode()) % 64 << 35 | letters << 5 | min(len(local), 31) if email else 0
    return None if kind == "absent" or not family else family, bits << 41 | place


def _whole_customers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, ordered by customer, in batches that part no customer."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = (b["customer"] == b["customer"].iloc[-1]).to_numpy()
        if not last.all():
            yield pd.concat([*kept, b[~last]], ignore_index=True)
            kept = [b[last]]
        elif kept and kept[-1]["customer"].iloc[-1] != b["customer"].iloc[-1]:
            yield pd.concat(kept, ignore_index=True)
            kept = [b]
        else:
            kept.append(b)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _whole_customers(batches):
        names, emails, sig, nk, ak, ik, jk = [], [], [], [], [], [], []
        for n, e in zip(b["name"], b["email"]):
            kind, family, given, rest = parse(n)
            e = email_key(e)
            bare = given.rstrip(".")
            names.append(None if kind == "absent" else {"kind": kind, "family": family, "given": bare, "dotted": given.endswith("."), "known": bare in GIVEN, "fulls": sorted(fulls(given)) if given else [], "rest": list(rest)})
            emails.append(e)
            sig.append(_signature(kind, family, given, e))
            nk.append(_name_keys(kind, family, given))
            free, short = _loose_keys(kind, family, given)
            ik.append(free)
            jk.append(short)
            ak.append(_address_keys(e, kind, given) if e else [])
        of: dict[str, set[tuple[str | None, int]]] = {}
        for c, x in zip(b["customer"], sig):
            of.setdefault(c, set()).add(x)
        # a customer of many signatures is compared with all that it meets
        sigs = {c: [{"f": f, "bits": bits} for f, bits in (x if len(x) <= 16 else {_signature("absent", "", "", None)})] for c, x in of.items()}
        yield pd.DataFrame({"customer": b["customer"], "register": b["register"], "name": names, "email": emails, "second": b["second"].astype("Int64"), "sigs": b["customer"].map(sigs), "nk": nk, "ak": ak, "ik": ik, "jk": jk})


def read_variants(records: DataFrame) -> DataFrame:
    """The distinct records of each customer with their names taken apart, addresses without wrapping, and a signature of their letters, and block keys nk (name), ak (address), ik and jk (loose name; jk pairs with ik only)."""
    rows = records.select("customer", "register", "name", "email", "second").repartition("customer").distinct().sortWithinPartitions("customer")
    return store(rows.transform(map_batches, _read, _VARIANT))


def _row(used: str, base: Column, level: int, value: Column, free: bool = True) -> Column:
    return F.struct(F.lit(used).alias("used"), base.alias("base"), F.lit(level).alias("dates"), F.xxhash64(base, F.lit(level), value).alias("key"), F.lit(free).alias("free"))


def _when_values(second: Column, level: int) -> Column:
    """The values of a date key: bands of 40 days (1), days (2) or seconds (3), each with its successor, so that near dates share one."""
    at = F.floor(second / {1: BAND, 2: DAY, 3: 1}[level]).cast("bigint")
    return F.when(second.isNotNull(), F.array(at, at + 1)).otherwise(F.array().cast("array<bigint>"))


def block_rows(variants: DataFrame, *others: str) -> DataFrame:
    """customer, register, others, used, base, dates, key, free: used names the attributes of a key (N name, A address, I loose name), dates how finely the date is in it.

    Of two rows with one key that make a pair, one must be free.

    A time on a whole quarter of an hour tells no more than its day and gives no key by itself.
    """
    zero = F.lit(0).cast("bigint")
    h = lambda kind: lambda k: F.xxhash64(F.lit(kind), k)
    loose = [F.flatten(F.transform(c, lambda k: F.transform(_when_values(F.col("second"), 1), lambda v: _row("I", h("I")(k), 1, v, free)))) for c, free in (("ik", True), ("jk", False))]  # noqa: B023
    rows = F.concat(
        F.transform("nk", lambda k: _row("N", h("N")(k), 0, zero)), F.transform("ak", lambda k: _row("A", h("A")(k), 0, zero)), *loose,
        F.when(F.col("second") % 900 != 0, F.array(_row("", zero, 3, F.col("second")))).otherwise(F.array().cast("array<struct<used:string,base:bigint,dates:int,key:bigint,free:boolean>>")),
    )
    return variants.select("customer", "register", *others, F.explode(rows).alias("k")).select("customer", "register", *others, "k.*")


def _hot(rows: DataFrame, hot: int) -> DataFrame:
    """key, register, held of the keys that more than hot customers of a register hold."""
    many = cut(rows.groupBy("key", "register").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key", "register"))
    if many.isEmpty():
        return many.withColumn("held", F.lit(0).cast("bigint"))
    # rows of one customer count once
    return cut(rows.join(many, ["key", "register"], "left_semi").select("key", "register", "customer").distinct().groupBy("key", "register").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot))


def _narrower(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """For each row of a hot key, rows of keys that join it with an attribute it lacks, or with a finer date."""
    of = lambda c, kind, free: F.transform(c, lambda k: F.struct(F.lit(kind).alias("with"), F.xxhash64(F.lit(kind), k).alias("other"), F.lit(free).alias("too")))
    own = variants.select("customer", F.explode(F.concat(of("ak", "A", True), of("ik", "I", True), of("jk", "I", False))).alias("o")).select("customer", "o.*").distinct()
    lacks = F.when(F.col("with") == "A", ~F.col("used").contains("A")).otherwise(~F.col("used").rlike("[NI]"))
    # the date's part of the old key goes along in the new one
    joined = rows.join(own, "customer").where(lacks).select("customer", "register", F.concat("used", "with").alias("used"), F.xxhash64("base", "other").alias("base"), "dates", F.xxhash64("key", "other").alias("key"), (F.col("free") & F.col("too")).alias("free"))
    times = variants.where("second is not null").select("customer", "second").distinct()
    dated = rows.where("dates < 3").join(times, "customer")
    step = F.when(F.col("dates") == 0, _when_values(F.col("second"), 1)).when(F.col("dates") == 1, _when_values(F.col("second"), 2)).otherwise(_when_values(F.col("second"), 3))
    dated = dated.select("customer", "register", "used", "base", (F.col("dates") + 1).alias("dates"), F.explode(step).alias("v"), "free").select("customer", "register", "used", "base", "dates", F.xxhash64("base", "dates", "v").alias("key"), "free")
    return joined.unionByName(dated).distinct()


def _pairs_of(rows: DataFrame) -> DataFrame:
    """a, b: pairs of customers of different registers that share a key. No key of rows holds more than hot customers of a register."""
    held = rows.groupBy("key").agg(F.collect_set(F.struct("register", "customer", "free")).alias("held"))
    held = held.where(F.array_min("held")["register"] < F.array_max("held")["register"])
    a = held.select("held", F.explode("held").alias("x"))
    return a.select(F.col("x.customer").alias("a"), F.explode(F.filter("held", lambda y: (y["register"] > F.col("x.register")) & (y["free"] | F.col("x.free")))).alias("y")).select("a", F.col("y.customer").alias("b"))


def candidate_pairs(variants: DataFrame, rules: LinkRules = LinkRules()) -> tuple[DataFrame, DataFrame | None]:
    """a, b (a in the lower register) of customers that share a block key; and name key counts of customers of hot names, if there are any.

    A short list for looking at hot keys. The linkage doesn't use it: it leaves pairs out, meeting_pairs does not.

    A hot key gives no pairs with the registers in which it is hot. It is replaced by the same key joined with each
    attribute that it lacks and with the date, ever finer. Pairs of a hot
    key that share no narrower key are left out.
    """
    rows, found, crowd = block_rows(variants), None, None
    for level in range(6):
        over = _hot(rows, rules.hot)
        if over.isEmpty():
            some, rows = rows, None
        else:
            some = rows.join(over.select("key", "register"), ["key", "register"], "left_anti")
            if level == 0:
                names = rows.where("used = 'N'").join(over, ["key", "register"]).groupBy("key").agg(F.max("held").alias("held"))
                crowd = rows.where("used = 'N'").join(names, "key").groupBy("customer").agg(F.max("held").alias("crowd"))
            rows = cut(_narrower(rows.join(over.select("key").distinct(), "key", "left_semi"), variants))
        pairs = _pairs_of(some)
        found = pairs if found is None else found.unionByName(pairs)
        if rows is None:
            break
    return found.distinct(), crowd


def _may_be_near(x: Column, y: Column) -> Column:
    """False only where _near is, told from two texts' letters and lengths: an edit changes two letters and one of the length at most."""
    nx, ny = x.bitwiseAND(31), y.bitwiseAND(31)
    least, others = F.least(nx, ny), F.bit_count(F.shiftright(x.bitwiseXOR(y), 5))
    return F.when(least >= 8, (others <= 4) & (F.abs(nx - ny) <= 3)).when(least >= 4, (others <= 2) & (F.abs(nx - ny) <= 1)).otherwise(others == 0)


def meeting_pairs(variants: DataFrame, share: int = 700_000) -> DataFrame:
    """a, b (a in the lower register): all pairs of customers of different registers that share a block key, however many
    hold it, but those whose letters show that neither names nor addresses are near: they are no evidence.

    A key is never cut short: its pairs are formed by a join that splits a key of many customers over tasks, and are
    told apart where they meet, before any of them moves. Above share records the keys are taken in several parts, one
    after another, so that the rows of one part only are on disk.
    """
    sa, sb = F.col("sa.bits"), F.col("sb.bits")
    fa, fb = F.col("sa.f"), F.col("sb.f")
    names = (fa.isNull() | fb.isNull() | (_families(fa, fb) > 0)) & (F.shiftright(sa.bitwiseAND(sb), 41) != 0)
    low = lambda c, bits: c.bitwiseAND((1 << bits) - 1)
    place_a, place_b = low(sa, 41), low(sb, 41)
    host = F.shiftright(place_a.bitwiseXOR(place_b), 35) == 0
    addresses = (place_a > 0) & (place_b > 0) & ((low(sa, 35) == low(sb, 35)) | (host & _may_be_near(low(sa, 35), low(sb, 35))))
    parts, found = max(1, math.ceil(variants.count() / share)), None
    for i in range(parts):
        rows = block_rows(variants, "sigs").where(F.pmod("key", F.lit(parts)) == i).select("customer", "key", "free", F.explode("sigs").alias("sig"))
        x, y = rows.toDF("a", "key", "fa", "sa"), rows.toDF("b", "key", "fb", "sb")
        met = x.join(y, "key").where((_register("a") < _register("b")) & (F.col("fa") | F.col("fb")) & (names | addresses)).select("a", "b").repartition("a").distinct()
        met = store(met)
        found = met if found is None else found.unionByName(met)
    return found if parts == 1 else found.repartition("a").distinct()


# --- evidence -----------------------------------------------------------------------------------------------------


def _near(a: Column, b: Column) -> Column:
    """Whether one may be a slip of the other: one slip from 4 letters, two from 8. A swap is one slip; it costs two edits and leaves the letters as they are."""
    n, d = F.least(F.length(a), F.length(b)), F.levenshtein(a, b, 4)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    others = F.levenshtein(letters(a), letters(b), 2)
    return (a == b) | F.when(d == -1, False).when(n >= 8, (d <= 2) | ((d == 3) & others.between(0, 2)) | (others == 0)).when(n >= 4, (d == 1) | ((d == 2) & (others == 0))).otherwise(False)


def _given_agree(x: Column, y: Column) -> Column:
    gx, gy = x["given"], y["given"]
    cut_off = lambda s, t: s["dotted"] & F.exists(t["fulls"], lambda f: f.startswith(s["given"]) | _near(F.substring(f, F.lit(1), F.length(s["given"])), s["given"]))
    slip = lambda s, t: ~s["known"] & F.exists(t["fulls"], lambda f: _near(s["given"], f))
    first = lambda s: F.transform(s["fulls"], lambda f: F.substring(f, 1, 1))
    return (
        F.when((gx == "") | (gy == ""), 0.5)
        .when((gx == gy) & (F.length(gx) > 1), 1.0)
        .when((F.length(gx) == 1) | (F.length(gy) == 1), F.when(F.arrays_overlap(first(x), first(y)), 0.6).otherwise(0.0))
        .when(F.arrays_overlap(x["fulls"], y["fulls"]), 1.0)
        .when(cut_off(x, y) | cut_off(y, x), 0.8)
        .when(slip(x, y) | slip(y, x), 0.95)
        .otherwise(0.0)
    )


def _families(fx: Column, fy: Column) -> Column:
    split = lambda c: F.split(c, "-")
    plain = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    return F.when(fx == fy, 1.0).when(_near(fx, fy), 0.9).when(fx.contains("-") != fy.contains("-"), F.when(F.arrays_overlap(split(fx), split(fy)), 0.85).otherwise(0.0)).when(fx.contains("-") & _near(plain(fx), plain(fy)), 0.9).otherwise(0.0)


def names_agree(x: Column, y: Column) -> Column:
    """How far two names (structs of read_variants) may be one: 0 in conflict, up to 1."""
    fx, fy = x["family"], y["family"]
    clash = (F.size(x["rest"]) > 0) & (F.size(y["rest"]) > 0) & ~F.exists(x["rest"], lambda p: F.exists(y["rest"], lambda q: _near(p, q)))
    firms = F.when(~_near(fx, fy), 0.0).when(clash, 0.1).otherwise(1.0)
    person = F.when((fx == "") | (fy == ""), 0.5).otherwise(_families(fx, fy)) * _given_agree(x, y)
    return F.when((x["kind"] == "firm") & (y["kind"] == "firm"), firms).when((x["kind"] == "firm") | (y["kind"] == "firm"), 0.0).otherwise(person)


def _addresses_near(x: Column, y: Column) -> Column:
    part = lambda c, i: F.substring_index(c, "@", i)
    hx, hy = part(x, -1), part(y, -1)
    return ((hx == hy) & _near(part(x, 1), part(y, 1))) | ((part(x, 1) == part(y, 1)) & F.levenshtein(hx, hy, 2).between(0, 2))


def _packed(name: Column) -> Column:
    """A name of read_variants as one text, which takes a third of the room in a shuffle."""
    parts = [name["kind"], name["family"], name["given"], name["dotted"].cast("string"), name["known"].cast("string"), F.array_join(name["fulls"], "\x1e"), F.array_join(name["rest"], "\x1e")]
    return F.when(name.isNotNull(), F.concat_ws("\x1f", *parts))


def _unpacked(text: Column) -> Column:
    part = F.split(text, "\x1f")
    words = lambda c: F.filter(F.split(c, "\x1e"), lambda w: w != "")
    of = {"kind": part[0], "family": part[1], "given": part[2], "dotted": part[3] == "true", "known": part[4] == "true", "fulls": words(part[5]), "rest": words(part[6])}
    return F.struct(*[c.alias(k) for k, c in of.items()])


def _facts(variants: DataFrame, rules: LinkRules) -> DataFrame:
    """customer, piece, names, emails, seconds: distinct values, at most rules.piece records to a row."""
    many = cut(variants.groupBy("customer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.piece))
    v = variants.withColumn("piece", F.lit(0)) if many.isEmpty() else variants.join(many, "customer", "left").withColumn("piece", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("name", "email", "second"), F.ceil(F.col("n") * 2 / rules.piece)).cast("int")))
    return v.groupBy("customer", "piece").agg(F.collect_set(_packed(F.col("name"))).alias("names"), F.collect_set("email").alias("emails"), F.collect_set("second").alias("seconds"))


def compared(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """a, b, l, e, d of each pair: its levels of NAMES, ADDRESSES and DATES, the best over both customers' values."""
    fa = facts.select(F.col("customer").alias("a"), F.col("names").alias("na"), F.col("emails").alias("ea"), F.col("seconds").alias("sa"))
    fb = facts.select(F.col("customer").alias("b"), F.col("names").alias("nb"), F.col("emails").alias("eb"), F.col("seconds").alias("sb"))
    each = lambda p, q, f: F.flatten(F.transform(p, lambda x: F.transform(q, lambda y: f(x, y))))
    written = lambda x: (F.length(x["given"]) > 1) & ~x["dotted"]
    names = each(F.transform("na", _unpacked), F.transform("nb", _unpacked), lambda x, y: F.struct(names_agree(x, y).alias("agree"), (written(x) & written(y)).alias("written")))
    address = F.when((F.size("ea") == 0) | (F.size("eb") == 0), None).when(F.arrays_overlap("ea", "eb"), 3).when(F.exists("ea", lambda x: F.exists("eb", lambda y: _addresses_near(x, y))), 2).otherwise(1)
    gap = F.array_min(each("sa", "sb", lambda x, y: F.abs(x - y)))
    both = pairs.join(fa, "a").join(fb, "b").select("a", "b", names.alias("names"), address.alias("address"), gap.alias("gap"))
    # null if a side has no name; an initial doesn't count where names written out conflict
    both = both.select("a", "b", "address", "gap", F.array_max("names")["agree"].alias("name"), F.exists("names", lambda n: n["written"] & (n["agree"] < 0.4)).alias("clash"))
    best = both.groupBy("a", "b").agg(F.max("name").alias("name"), F.max("address").alias("address"), F.min("gap").alias("gap"), F.bool_or("clash").alias("clash"))
    level = F.when(F.col("name").isNull(), 1).when(F.col("name") >= 0.7, 3).when((F.col("name") >= 0.4) & ~F.col("clash"), 2).otherwise(0)
    date = F.when(F.col("gap").isNull(), 0).when(F.col("gap") <= 1, 5).when(F.col("gap") <= 1.1 * DAY, 4).when(F.col("gap") <= 8 * DAY, 3).when(F.col("gap") <= BAND, 2).otherwise(1)
    return best.select("a", "b", level.alias("l"), F.coalesce("address", F.lit(0)).alias("e"), date.alias("d"))


def _register(c: str | Column) -> Column:
    return F.substring_index(c, ":", 1)


def with_rivals(levels: DataFrame, crowd: DataFrame | None) -> DataFrame:
    """Adds n: how many customers of one register agree with the pair's other side as far as it does, itself included (powers of two from 8).

    Customers of a hot name have as many rivals by name as the register holds of that name.
    """
    near = F.col("e") >= 2
    flags = {"nf": near & (F.col("l") == 3), "ni": near & (F.col("l") >= 2), "na": near, "of": F.col("l") == 3, "oi": F.col("l") >= 2, "oa": F.col("l") == 1}
    d = levels
    # a customer's pairs with one register
    for side, other in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(side, _register(F.col(other)))
        d = d.withColumns({f"{side}_{k}": F.count_if(v).over(w) for k, v in flags.items()})
    n = {k: F.greatest(f"a_{k}", f"b_{k}") for k in flags}
    d = d.withColumn("n", F.when(near, F.when(F.col("l") == 3, n["nf"]).when(F.col("l") == 2, n["ni"]).otherwise(n["na"])).otherwise(F.when(F.col("l") == 3, n["of"]).when(F.col("l") == 2, n["oi"]).otherwise(n["oa"])))
    d = d.select("a", "b", "l", "e", "d", F.greatest("n", F.lit(1)).alias("n"))
    if crowd is not None:
        for side in ("a", "b"):
            d = d.join(crowd.select(F.col("customer").alias(side), F.col("crowd").alias(f"{side}_crowd")), side, "left")
        d = d.withColumn("n", F.when(~near & (F.col("l") >= 2), F.greatest("n", F.coalesce("a_crowd", F.lit(0)), F.coalesce("b_crowd", F.lit(0)))).otherwise(F.col("n")))
    rounded = F.when(F.col("n") <= 8, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))))
    return d.select("a", "b", "l", "e", "d", rounded.cast("int").alias("n"))


# Prior shares of the date levels among pairs that are one customer and among others, and prior odds, for one rival, of
# each level of name and address; they count for a few pairs only and hold where the tables show nothing.
_SAME_DATES = (0.06, 0.04, 0.15, 0.10, 0.38, 0.27)
_OTHER_DATES = (0.06, 0.85, 0.045, 0.025, 0.015, 0.005)
_ODDS = ((1e-4, 1e-5, 0.02, 0.05), (0.01, 0.001, 2.0, 5.0), (0.2, 0.03, 5.0, 10.0), (1.0, 0.2, 20.0, 50.0))


@dataclass(frozen=True)
class Evidence:
    """odds[l][e]: odds of a pair with one rival by name and address; ratio[d]: what its dates multiply them with."""

    odds: tuple[tuple[float, ...], ...] = _ODDS
    ratio: tuple[float, ...] = tuple(x / y for x, y in zip(_SAME_DATES, _OTHER_DATES))

    def log_odds(self) -> Column:
        cells = F.array(*[F.lit(math.log(x)) for row in self.odds for x in row])
        dates = F.array(*[F.lit(math.log(x)) for x in self.ratio])
        return F.element_at(cells, (F.col("l") * 4 + F.col("e") + 1).cast("int")) - F.log(F.col("n").cast("double")) + F.element_at(dates, (F.col("d") + 1).cast("int"))


def fit_evidence(counts: list[tuple[int, int, int, int, int]], every: float, rounds: int = 60, weight: float = 8.0) -> Evidence:
    """Odds and ratios by expectation-maximisation over counts of (name, address, rivals, date) levels; no labels.

    A pair of n rivals is one customer with odds of its cell over n; its date comes from the shares of either kind. The
    shares are learned from pairs of full names: these meet by name, so every date is there. Pairs of other names and
    no near address meet by their dates, so only their near dates count, against the shares of near dates. Pairs that
    agree in name and address are told from chance by independence: of every pairs, so many agree in the address though
    their names conflict, and as large a share of the different customers who agree in the name does so by chance.
    """
    m, u = list(_SAME_DATES), list(_OTHER_DATES)
    odds = [list(row) for row in _ODDS]
    cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for l, e, n, d, k in counts:
        cells.setdefault((l, e), []).append((n, d, k))
    size = {c: sum(k for _, _, k in rows) for c, rows in cells.items()}
    rate = {e: size.get((0, e), 0) / max(every, 1.0) for e in (2, 3)}
    other = dict.fromkeys((2, 3), 0.0)
    for _ in range(rounds):
        mm, uu = [weight * x for x in _SAME_DATES], [weight * x for x in _OTHER_DATES]
        unlike = dict.fromkeys((2, 3), 0.0)
        for (l, e), rows in cells.items():
            met = range(2, 6) if l < 3 and e < 2 else range(6)
            part_m, part_u = sum(m[d] for d in met), sum(u[d] for d in met)
            here = odds[l][e] * part_m / part_u
            prior = _ODDS[l][e] * part_m / part_u
            mass, seen = 2 * prior / (1 + prior), [(1, 2.0)]
            for n, d, k in rows:
                if d in met:
                    o = here / n * (m[d] / part_m) / (u[d] / part_u)
                    r = o / (1 + o)
                    mass += k * r
                    seen.append((n, k))
                    if l >= 2 and e < 2:
                        unlike[l] += k * (1 - r)
                    if l == 3:
                        mm[d] += k * r
                        uu[d] += k * (1 - r)
            if l >= 2 and e >= 2:
                odds[l][e] = max(1.0, size[l, e] / (other[l] * rate[e] + 0.5))
                continue
            lo, hi = -20.0, 20.0
            for _ in range(50):
                mid = (lo + hi) / 2
                x = math.exp(mid)
                lo, hi = (mid, hi) if sum(k * x / (x + n) for n, k in seen) < mass else (lo, mid)
            odds[l][e] = min(max(math.exp(lo), 1e-6), 1e6) * part_u / part_m
        other = unlike
        m, u = [x / sum(mm) for x in mm], [x / sum(uu) for x in uu]
    return Evidence(tuple(tuple(row) for row in odds), tuple(x / y for x, y in zip(m, u)))


def scored_candidates(records: DataFrame, rules: LinkRules = LinkRules()) -> tuple[DataFrame, Evidence, DataFrame]:
    """a, b, l, e, d, n, odds (log) of the candidate pairs; the evidence they were weighed by; and the customers' facts."""
    variants = read_variants(records)
    facts = store(_facts(variants, rules))
    pairs = meeting_pairs(variants)
    discard(variants)
    levels = compared(pairs, facts).where("l > 0 or e >= 2")  # unlike names with unlike or no addresses are no evidence
    levels = cut(with_rivals(cut(levels), None))
    discard(pairs)
    counts = levels.groupBy("l", "e", "n", "d").count().collect()  # levels and powers of two: some thousand rows at most
    sizes = [r["count"] for r in facts.where("piece = 0").groupBy(_register("customer")).count().collect()]  # a row per register
    every = (sum(sizes) ** 2 - sum(n * n for n in sizes)) / 2
    evidence = fit_evidence(sorted((r["l"], r["e"], r["n"], r["d"], r["count"]) for r in counts), every)
    return levels.withColumn("odds", evidence.log_odds()), evidence, facts


# --- the convex problem ------------------------------------------------------------------------------------------


def potentials(variables: DataFrame, rules: LinkRules) -> DataFrame:
    """pot, var, coef, weight: all hinge potentials weight * max(0, sum of coef * x - 1)^2 that can bind.

    Exclusivity: a customer and a register, over all its pairs into it. Transitivity: three pairs of three customers,
    each way round.
    """
    v = variables.select("var", "a", "b")
    sides = v.select("var", F.xxhash64("a", _register("b")).alias("pot")).unionByName(v.select("var", F.xxhash64("b", _register("a")).alias("pot")))
    loads = sides.groupBy("pot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pot")
    one = F.lit(1.0)
    exclusive = sides.join(loads, "pot").select("pot", "var", one.alias("coef"), F.lit(rules.exclusive).alias("weight"))
    x, y, z = v.toDF("v1", "a", "b"), v.toDF("v2", "b", "c"), v.toDF("v3", "a", "c")
    tri = x.join(y, "b").join(z, ["a", "c"])
    ways = F.array(*[F.struct(F.lit(k).alias("way"), F.array(*[F.struct(F.col(f"v{i}").alias("var"), F.lit(-1.0 if i == k else 1.0).alias("coef")) for i in (1, 2, 3)]).alias("terms")) for k in (1, 2, 3)])
    tri = tri.select("a", "b", "c", F.explode(ways).alias("w"))
    transitive = tri.select(F.xxhash64("a", "b", "c", "w.way").alias("pot"), F.explode("w.terms").alias("t")).select("pot", "t.var", "t.coef", F.lit(rules.transitive).alias("weight"))
    return exclusive.unionByName(transitive)


def _alternate(state: DataFrame, rules: LinkRules) -> DataFrame:
    """Rounds of ADMM over pot, var, coef, weight, p, z, u until both residuals are under rules.tolerance.

    Every potential holds copies of its variables; a copy moves to the minimum of its potential near the consensus, the
    consensus to the mean of its copies and its evidence (weight 1), within [0, 1].
    """
    rho, pot, var, step = rules.rho, Window.partitionBy("pot"), Window.partitionBy("var"), 5
    state = state.withColumns({"norm": F.sum(F.col("coef") * F.col("coef")).over(pot), "apart": F.lit(0.0)})
    c = {k: F.col(k) for k in ("coef", "weight", "p", "z", "u", "norm", "over", "x")}
    x = c["z"] - c["u"] - F.when(c["over"] > 0, 2 * c["weight"] * c["over"] / (rho + 2 * c["weight"] * c["norm"]) * c["coef"]).otherwise(0.0)
    ahead = rules.relax * c["x"] + (1 - rules.relax) * c["z"]
    mean = (2 * c["p"] + rho * F.sum(ahead + c["u"]).over(var)) / (2 + rho * F.count(F.lit(1)).over(var))
    keep = ["pot", "var", "coef", "weight", "p", "norm"]
    for _ in range(0, rules.rounds, step):
        for _ in range(step):
            # the partitions are the pairs of one customer with one register, or one pair's potentials
            moved = state.select(*keep, "z", "u", (F.sum(c["coef"] * (c["z"] - c["u"])).over(pot) - 1).alias("over")).select(*keep, "z", "u", x.alias("x"))
            moved = moved.select(*keep, "z", (c["u"] + ahead).alias("v"), "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("z2"))
            state = moved.select(*keep, F.col("z2").alias("z"), (F.col("v") - F.col("z2")).alias("u"), F.greatest(F.abs(c["x"] - F.col("z2")), rho * F.abs(F.col("z2") - c["z"])).alias("apart"))
        state = cut(state)
        release(state.sparkSession)
        if (state.agg(F.max("apart")).first()[0] or 0.0) < rules.tolerance:
            break
    return state.drop("apart", "norm")


def solve(variables: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """var, a, b, p, x: the minimum of sum (x - p)^2 and all potentials, within [0, 1].

    Only potentials that the evidence, or a solution without them, violates, and their neighbours, are held; further ones come in until a
    solution violates none of the others, which makes it the minimum of the whole.
    """
    # numbers in place of the texts, which would go along in every round
    texts = cut(variables.withColumn("id", F.xxhash64("var")))
    variables = texts.select(F.col("id").alias("var"), "a", "b", "p")
    terms = cut(potentials(variables, rules))
    x, held, state = variables.select("var", "p", F.col("p").alias("x")), None, None
    while True:
        at = terms.join(x, "var")
        broken = at.groupBy("pot").agg(F.sum(F.col("coef") * F.col("x")).alias("load")).where(F.col("load") > 1 + 1e-6).select("pot")
        if held is not None:
            broken = broken.join(held, "pot", "left_anti")
        broken = cut(broken)
        if broken.isEmpty():
            break
        if held is None:
            # those that share a variable with a violated one come in at once
            near = terms.join(terms.join(broken, "pot").select("var").distinct(), "var").select("pot").distinct()
            broken = cut(near)
        held = broken if held is None else held.unionByName(broken)
        fresh = at.join(broken, "pot").select("pot", "var", "coef", "weight", "p", F.col("x").alias("z"), F.lit(0.0).alias("u"))
        if state is not None:
            # the consensus of a variable is the same in all its potentials
            fresh = state.unionByName(fresh)
        state = _alternate(cut(fresh), rules)
        solved = state.groupBy("var").agg(F.first("z").alias("z"))
        x = cut(variables.join(solved, "var", "left").select("var", "p", F.coalesce("z", "p").alias("x")))
        release(variables.sparkSession)
    return texts.join(x.select(F.col("var").alias("id"), "x"), "id").select("var", "a", "b", "p", "x")


def linked_customers(records: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """a, b, confidence: pairs of customers of two registers that are one, at rules.least or more.

    Pairs that two sure links imply are variables too, even if they share no key.
    """
    scored, evidence, facts = scored_candidates(records, rules)
    # evidence under one in a thousand neither reaches least, lifted by two sure links, nor takes a link its place
    strong = scored.where(F.col("odds") > math.log(0.001))
    sure = strong.where(F.col("odds") > math.log(rules.sure / (1 - rules.sure)))
    ways = sure.select(F.col("a").alias("m"), F.col("b").alias("o")).unionByName(sure.select(F.col("b").alias("m"), F.col("a").alias("o")))
    two = ways.toDF("m", "o1").join(ways.toDF("m", "o2"), "m").where(_register("o1") < _register("o2")).select(F.col("o1").alias("a"), F.col("o2").alias("b")).distinct()
    implied = compared(two.join(strong, ["a", "b"], "left_anti"), facts).withColumn("n", F.lit(1)).withColumn("odds", evidence.log_odds())
    every = strong.unionByName(implied).withColumns({"p": 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), "odds")))), "var": F.concat_ws("~", "a", "b")})
    every = cut(every.select("var", "a", "b", "p"))
    discard(facts)
    return solve(every, rules).where(F.col("x") >= rules.least).select("a", "b", F.col("x").alias("confidence"))


def linked_records(tables: dict[str, DataFrame], rules: LinkRules = LinkRules()) -> DataFrame:
    """rec_a, rec_b, confidence: each pair of records of two registers that mean one customer, rec_a < rec_b.

    Nulls and marks of absence in names, addresses and dates count as unknown. Equal scores keep both pairs unless
    exclusivity lowers them under rules.least. Repeated records count each; tables may be empty or left out; extra
    columns are ignored. Long texts are compared whole.
    """
    links, records = linked_customers(customer_records(tables), rules), numbered_records(tables)
    left = records.select(F.col("customer").alias("a"), F.col("rec_id").alias("ra"))
    right = records.select(F.col("customer").alias("b"), F.col("rec_id").alias("rb"))
    pairs = links.join(left, "a").join(right, "b")
    return pairs.select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"), "confidence").distinct()
