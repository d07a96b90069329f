"""Mixed timestamp formats and time zones, normalised to instants.

Every value is read under each format whose parts name a real day or instant. Per source, expectation-maximisation
over the mixture of formats weighs the readings; the posterior chooses one, and what stays open is marked as ambiguous.
The sufficient statistic of the mixture is a count per source and set of valid formats, so the corpus is aggregated to
a table whose size depends on the number of formats only.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.calendar import epoch_day, is_calendar_day, to_int

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_MONTH = r"([A-Za-z]{3,9})\.?"
_US = "\x01"

#: Each family: a pattern and the numbers of its groups for a, b, c (the date's parts as written), hour, minute, second, fraction, half of the day, zone, bracketed zone.
_FAMILIES = {
    "iso": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]{_TIME}(?: ?([AaPp][Mm])(?![A-Za-z]))?(?: ?{_ZONE})?(?:\[([^\]]+)\])?)?$", (1, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))? ?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    "last": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[T ]{_TIME}(?: ?([AaPp][Mm])(?![A-Za-z]))?(?: ?{_ZONE})?(?:\[([^\]]+)\])?)?$", (1, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    "day_name": (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})(?: {_TIME}(?: ?([AaPp][Mm])(?![A-Za-z]))?(?: ?{_ZONE})?)?$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
    "name_day": (rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}})(?: {_TIME}(?: ?([AaPp][Mm])(?![A-Za-z]))?(?: ?{_ZONE})?)?$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
}
_PARTS = ("a", "b", "c", "hour", "minute", "second", "fraction", "half", "zone", "bracket")
_EPOCH = {"epoch_s": (9, 10, 1_000_000), "epoch_ms": (12, 13, 1_000), "epoch_us": (15, 16, 1)}

#: The formats of the mixture. ymd2 is a two-digit year first.
FORMATS = ("iso", "compact", "mdy", "dmy", "ymd2", "text", *_EPOCH)


@dataclass(frozen=True)
class InstantRules:
    """declared: the order of numeric dates with the year last that a source is known to use; it bars the other order there.

    sure: least posterior of a chosen reading; below it the value is ambiguous.
    """

    declared: dict[str, str] = field(default_factory=dict)
    sure: float = 0.9
    rounds: int = 60
    smoothing: float = 0.5


def _tokens(value: Column) -> Column:
    """Array family, a, b, c, hour, ... of the first family that matches, by one replacement each; null if none does."""
    out = None
    for name, (pattern, groups) in _FAMILIES.items():
        line = _US.join([name, *(f"${g}" if g else "" for g in groups)])
        cut = F.split(F.regexp_replace(value, pattern, line), _US, -1)
        out = F.when(value.rlike(pattern), cut) if out is None else out.when(value.rlike(pattern), cut)
    return out.when(value.rlike(r"^\d{9,16}$"), F.array(F.lit("epoch"), value, *[F.lit("")] * 9))


def _month_number(name: Column) -> Column:
    short = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    n = F.lower(name)
    out = F.when(n == "sept", F.lit(9))
    for i, (s, f) in enumerate(zip(short, full), 1):
        out = out.when((n == s) | (n == f), F.lit(i))
    return out


def zone_offsets(spark: SparkSession) -> DataFrame:
    """zone, letters, seconds: the offsets that a zone's abbreviations stand for, by the zone database, and each zone once with letters ''.

    Some thousand rows whatever the data, so the table may be broadcast. Of several meanings the latest holds.
    """
    java = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows = []
    for z in sorted(available_timezones() & java):
        rows.append((z, "", 0))
        seen = {}
        for year in (1990, 2000, 2010, 2020, 2024):
            for month in (1, 7):
                at = dt.datetime(year, month, 15, 12, tzinfo=ZoneInfo(z))
                if at.tzname() and at.tzname().isalpha():
                    seen[at.tzname()] = int(at.utcoffset().total_seconds())
        rows += [(z, k, v) for k, v in seen.items()]
    return spark.createDataFrame(rows, "zone string, letters string, seconds int")


def _readings(parsed: DataFrame) -> DataFrame:
    """Adds the parts as integers and formats: those under which the value names a real day or instant.

    The columns are added in steps, so that no expression is repeated in the generated code.
    """
    at = {p: F.get("tk", F.lit(i + 1)) for i, p in enumerate(_PARTS)}
    d = parsed.withColumns({"fam": F.get("tk", F.lit(0)), "sa": at["a"], "sb": at["b"], "sc": at["c"], "half": F.upper(at["half"]), "zone_text": at["zone"], "bracket": at["bracket"], "has_time": at["hour"] != "", "fraction": at["fraction"], "hh": to_int(at["hour"]), "mi": to_int(at["minute"]), "ss": F.coalesce(to_int(at["second"]), F.lit(0))}).drop("tk")
    month = F.when(F.col("fam") == "day_name", _month_number(F.col("sb"))).when(F.col("fam") == "name_day", _month_number(F.col("sa")))
    d = d.withColumns({"a": to_int(F.col("sa")), "b": to_int(F.col("sb")), "c": to_int(F.col("sc")), "month": month, "n": F.when(F.col("fam") == "epoch", F.col("sa").try_cast("bigint")), "digits": F.length("sa"), "short": F.length("sc") == 2})
    d = d.withColumn("c4", F.when(F.col("short"), F.col("c") + 2000).otherwise(F.col("c")))
    hh, half = F.col("hh"), F.col("half")
    ok = F.when(~F.col("has_time"), True).otherwise((F.col("mi") <= 59) & (F.col("ss") <= 59) & F.when(half == "", hh <= 23).otherwise(hh.between(1, 12)))
    hour = F.when(half == "", hh).when(half == "AM", hh % 12).otherwise(hh % 12 + 12)
    clock = (hour.cast("bigint") * 3600 + F.col("mi") * 60 + F.col("ss")) * 1_000_000 + F.coalesce(to_int(F.substring(F.rpad("fraction", 9, "0"), 1, 6)), F.lit(0))
    d = d.withColumns({"ok": ok, "clock": F.when(F.col("has_time"), clock).otherwise(F.lit(0).cast("bigint"))})
    fam, digits = F.col("fam"), F.col("digits")
    ymd = is_calendar_day(F.col("a"), F.col("b"), F.col("c"))
    valid = {
        "iso": (fam == "iso") & ymd,
        "compact": (fam == "compact") & ymd,
        "mdy": (fam == "last") & is_calendar_day(F.col("c4"), F.col("a"), F.col("b")),
        "dmy": (fam == "last") & is_calendar_day(F.col("c4"), F.col("b"), F.col("a")),
        "ymd2": (fam == "last") & F.col("short") & (F.col("digits") == 2) & is_calendar_day(F.col("a") + 2000, F.col("b"), F.col("c")),
        "text": F.when(fam == "day_name", is_calendar_day(F.col("c"), F.col("month"), F.col("a"))).when(fam == "name_day", is_calendar_day(F.col("c"), F.col("month"), F.col("b"))),
    }
    named = [F.when(F.col("ok") & v, F.lit(k)) for k, v in valid.items()]
    named += [F.when((fam == "epoch") & digits.between(lo, hi), F.lit(k)) for k, (lo, hi, _) in _EPOCH.items()]
    return d.withColumn("formats", F.when(fam.isNotNull(), F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>")))


def _local_micros(chosen: DataFrame) -> DataFrame:
    """Adds local: the microseconds of the local time that the chosen format reads."""
    f, a, b, c = F.col("format"), F.col("a"), F.col("b"), F.col("c")
    ymd, text = f.isin("iso", "compact", "ymd2"), f == "text"
    y = F.when(f == "ymd2", a + 2000).when(ymd, a).when(text, c).otherwise(F.col("c4"))
    m = F.when(ymd | (f == "dmy"), b).when(text, F.col("month")).otherwise(a)
    d = F.when(ymd, c).when(text & (F.col("fam") == "name_day"), b).when(text | (f == "dmy"), a).otherwise(b)
    out = chosen.withColumns({"y": y, "m": m, "d": d})
    out = out.withColumn("day", epoch_day(F.col("y"), F.col("m"), F.col("d")))
    unit = F.create_map(*[x for k, (_, _, u) in _EPOCH.items() for x in (F.lit(k), F.lit(u))])
    return out.withColumn("local", F.when(F.col("is_epoch"), F.when(f.isNotNull(), F.col("n") * F.try_element_at(unit, f))).when(f.isNotNull(), F.col("day") * 86_400_000_000 + F.col("clock")))


def fit_mixtures(counts: list[tuple[str, tuple[str, ...], int]], rules: InstantRules) -> dict[tuple[str, tuple[str, ...]], list[tuple[str, float]]]:
    """Posteriors of the formats, per source and set of valid formats, by expectation-maximisation.

    A format that the source's declared order bars gets no weight. Without any data a source's weights are equal.
    """
    by = defaultdict(list)
    for source, formats, n in counts:
        by[source].append((formats, n))
    out = {}
    for source, sets in by.items():
        barred = {"mdy": {"dmy", "ymd2"}, "dmy": {"mdy", "ymd2"}}.get(rules.declared.get(source), set())
        use = [f for f in FORMATS if f not in barred]
        w = dict.fromkeys(use, 1 / len(use))
        for _ in range(rules.rounds):
            mass = dict.fromkeys(use, rules.smoothing / max(len(use), 1))
            for formats, n in sets:
                z = sum(w[f] for f in formats if f in w)
                for f in formats:
                    if f in w and z > 0:
                        mass[f] += n * w[f] / z
            z = sum(mass.values())
            w = {f: m / z for f, m in mass.items()}
        for formats, _ in sets:
            p = {f: w[f] for f in formats if f in w}
            z = sum(p.values())
            out[source, formats] = sorted(((f, x / z) for f, x in p.items()), key=lambda x: (-x[1], x[0]))
    return out


def normalise_instants(df: DataFrame, source: str, value: str, zone: str, keep: list[str], rules: InstantRules = InstantRules()) -> DataFrame:
    """keep, utc_micros, format, posterior, status of each row of df. source, value, zone name its columns.

    status: resolved; ambiguous (no reading reaches rules.sure; the best one is still given); off_format (readable only
    in a format that the source's declared order bars); unreadable (absent, partial, impossible, or in an unknown zone). utc_micros is
    null unless resolved or ambiguous. A value without zone is local time of the zone column, UTC if that is null; zone
    letters are those of that zone; an offset wins over a bracketed zone name. A day means its first moment. A time that
    occurs twice is the earlier one, a skipped one is read with the offset before the change.
    Nulls, empty texts and texts that are no date are unreadable, whatever their length; repeated rows come out as often as they are; an empty table
    gives no rows. Columns of other names are not touched; keep must not contain names of the result.
    """
    spark = df.sparkSession
    d = df.select(*[F.col(k) for k in keep], F.col(source).alias("_src"), F.trim(F.col(value)).alias("_v"), F.col(zone).alias("_home"))
    d = _readings(d.withColumn("tk", _tokens(F.col("_v"))))
    seen = d.groupBy("_src", "formats").count().collect()  # at most the sets of FORMATS for each source
    post = fit_mixtures([(r["_src"], tuple(r["formats"]), r["count"]) for r in seen if r["formats"]], rules)
    rows = [(s, list(f), p[0][0] if p else None, float(p[0][1]) if p else None) for (s, f), p in post.items()]
    schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("_set", T.ArrayType(T.StringType())), T.StructField("format", T.StringType()), T.StructField("posterior", T.DoubleType())])
    chosen = F.broadcast(spark.createDataFrame(rows, schema))
    d = d.join(chosen, F.col("_src").eqNullSafe(F.col("_of")) & (F.col("formats") == F.col("_set")), "left")
    d = _local_micros(d.withColumn("is_epoch", F.coalesce(F.col("fam") == "epoch", F.lit(False))))
    z = F.col("zone_text")
    off = r"^([+-])(\d{2}):?(\d{2})?$"
    seconds = F.when(z.rlike(off), F.when(F.regexp_extract(z, off, 1) == "-", -1).otherwise(1) * (to_int(F.regexp_extract(z, off, 2)) * 3600 + F.coalesce(to_int(F.regexp_extract(z, off, 3)), F.lit(0)) * 60))
    seconds = F.when(F.col("is_epoch") | z.isin("Z", "UTC"), F.lit(0)).otherwise(seconds)
    home = F.coalesce("_home", F.lit("UTC"))
    letters = z.rlike(r"^[A-Z]{2,5}$") & ~z.isin("UTC")
    named = F.when(z.contains("/"), z).when((z == "") & (F.col("bracket") != ""), F.col("bracket")).otherwise(home)
    d = d.withColumns({"fixed": seconds, "letters": F.when(letters & seconds.isNull(), z).otherwise(F.lit("")), "named": named})
    zones = F.broadcast(zone_offsets(spark).toDF("known", "known_letters", "seconds"))
    d = d.join(zones, (F.col("named") == F.col("known")) & (F.col("letters") == F.col("known_letters")), "left")
    # letters that mean the same everywhere hold without a zone
    shift = F.coalesce("fixed", F.when(F.col("letters") != "", F.coalesce("seconds", F.when(F.col("letters") == "GMT", F.lit(0)))))
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local"), F.coalesce(F.when(F.col("letters") == "", F.col("known")), F.lit("UTC"))))
    micros = F.when(shift.isNotNull(), F.col("local") - shift.cast("bigint") * 1_000_000).when(F.col("known").isNotNull() & (F.col("letters") == ""), by_zone)
    d = d.withColumn("utc_micros", micros)
    status = (
        F.when((F.size("formats") > 0) & F.col("format").isNull(), F.lit("off_format"))
        .when(F.col("utc_micros").isNull(), F.lit("unreadable"))
        .when(F.col("posterior") < rules.sure, F.lit("ambiguous"))
        .otherwise(F.lit("resolved"))
    )
    # through a generated row no filter on the result is pushed; in the parsing expressions it would be repeated many times over
    row = F.struct("utc_micros", "format", "posterior", status.alias("status"))
    return d.select(*keep, F.explode(F.array(row)).alias("_x")).select(*keep, "_x.utc_micros", "_x.format", "_x.posterior", "_x.status")


# The date column of each table, and the order its numeric dates with the year last have.
DATE_COLUMNS = {"customers_v1": "Registration_Date", "customers_v2": "SignupDate", "customers_v3": "created_at", "products": "last_updated"}
DECLARED = {"customers_v2": "mdy", "customers_v3": "dmy"}


def table_instants(tables: dict[str, DataFrame], rules: InstantRules = InstantRules(declared=DECLARED)) -> DataFrame:
    """src_table, rec_id, utc_micros, format, posterior, status of the date columns of DATE_COLUMNS in the given tables."""
    parts = [
        t.select(F.lit(n).alias("src_table"), F.col("rec_id").cast("bigint").alias("rec_id"), F.col(DATE_COLUMNS[n]).cast("string").alias("value"), "src_zone") for n, t in tables.items()
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return normalise_instants(every, "src_table", "value", "src_zone", ["src_table", "rec_id"], rules)
