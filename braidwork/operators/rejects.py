"""Rows that fail to parse: damaged lines come out apart, with their reason, while the others load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.calendar import is_calendar_day, to_int
from braidwork.functions.delimited import fields, header_names, quoting_broken, unquoted
from braidwork.session import cut

# Header names (letters and digits only, lower case) under which the feeds carry the two checked fields.
NAME_HEADERS = ("fullname", "customername", "name", "customerfullname", "displayname", "party", "clientname", "custname")
DATE_HEADERS = ("registrationdate", "signupdate", "createdat", "regdt", "datecreated", "since", "joinedon", "signupday")


@dataclass(frozen=True)
class RejectRules:
    """name_headers, date_headers: keys of the checked columns. month_first, day_first: feeds whose numeric dates with the year last are read so; others may be either."""

    name_headers: tuple[str, ...] = NAME_HEADERS
    date_headers: tuple[str, ...] = DATE_HEADERS
    month_first: tuple[str, ...] = ("customers_v2",)
    day_first: tuple[str, ...] = ("customers_v3",)


def header_key(name: Column) -> Column:
    """A header name without case, quotes, blanks and marks."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def feed_headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, feed, delim, header (names), header_keys, n_fields: one row per file with a header line.

    If a file carries several lines numbered 1, the one with the lowest line_id is its header.
    """
    f = files.select("file_id", "feed", F.coalesce("delim", F.lit(",")).alias("delim"))
    h = lines.where("line_no = 1").groupBy("file_id").agg(F.min_by(F.coalesce("raw_text", F.lit("")), "line_id").alias("raw"))
    h = h.join(f, "file_id").withColumn("header", header_names(F.col("raw"), F.col("delim")))
    return h.select("file_id", "feed", "delim", "header", F.transform("header", header_key).alias("header_keys"), F.size("header").alias("n_fields"))


def parsed_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every line with line_no > 1 of a file with a header: line_id, the header's columns, raw, structural (quoting, column_count or null), cells (null unless sound)."""
    head = feed_headers(files, lines)
    body = lines.where("line_no > 1").select("line_id", "file_id", "line_no", F.coalesce("raw_text", F.lit("")).alias("raw"))
    d = body.join(head, "file_id")
    d = d.withColumn("broken", quoting_broken(F.col("raw"), F.col("delim")))
    d = d.withColumn("cells", F.when(~F.col("broken"), fields(F.col("raw"), F.col("delim"))))
    reason = F.when(F.col("broken"), F.lit("quoting")).when(F.size("cells") != F.col("n_fields"), F.lit("column_count"))
    d = d.withColumn("structural", reason)
    return d.withColumn("cells", F.when(F.col("structural").isNull(), F.col("cells"))).drop("broken")


def checked_lines(files: DataFrame, lines: DataFrame, rules: RejectRules = RejectRules()) -> DataFrame:
    """line_id, feed, structural, name, date of every line with line_no > 1 of a file with a header; the values only of structurally sound lines. Kept, so that lines are parsed once."""
    parsed = parsed_lines(files, lines)
    keys, delim = F.col("header_keys"), F.col("delim")
    first = lambda names: F.array_position(F.transform(keys, lambda k: k.isin(*names)), True).cast("int")
    cell = lambda pos: F.when(F.col("structural").isNull() & (F.col(pos) > 0), unquoted(F.try_element_at("cells", F.col(pos)), delim))
    d = parsed.withColumns({"pn": first(rules.name_headers), "pd": first(rules.date_headers)})
    return cut(d.select("line_id", "feed", "structural", cell("pn").alias("name"), cell("pd").alias("date")))


def _values(checked: DataFrame) -> DataFrame:
    """line_id, feed, role, value of the checked columns of the sound lines."""
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("value")) for r in ("name", "date")])
    return checked.where("structural is null").select("line_id", "feed", F.explode(pairs).alias("x")).select("line_id", "feed", "x.role", "x.value").where("value is not null")


def invalid_value(feed: Column, role: Column, value: Column, rules: RejectRules) -> Column:
    """Why a value is invalid, or null. Names: empty, no_letter, bad_character. Dates: not_a_day, for values written as a day only, and for words without any digit in a day's place."""
    name = (
        F.when(F.trim(F.regexp_replace(value, r"\s+", " ")) == "", F.lit("empty"))
        .when(value.rlike(r"[\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"), F.lit("bad_character"))
        .when(~value.rlike(r"\p{L}"), F.lit("no_letter"))
    )
    v = F.trim(value)
    iso, last = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?:[T ].*)?$"
    part = lambda p, i: to_int(F.regexp_extract(v, p, i))
    yl = part(last, 3)
    year = F.when(yl < 100, yl + 2000).otherwise(yl)
    # a written year 0000 has to stay impossible
    year = F.when(F.regexp_extract(v, last, 3) == "0000", F.lit(0)).otherwise(year)
    mdy, dmy = is_calendar_day(year, part(last, 1), part(last, 2)), is_calendar_day(year, part(last, 2), part(last, 1))
    by_feed = F.when(feed.isin(*rules.month_first), mdy).when(feed.isin(*rules.day_first), dmy).otherwise(mdy | dmy)
    date = F.when(v.rlike(iso), ~is_calendar_day(part(iso, 1), part(iso, 2), part(iso, 3))).when(v.rlike(last), ~by_feed).otherwise(F.lit(False))
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    date = F.when(v.rlike(compact), ~is_calendar_day(part(compact, 1), part(compact, 2), part(compact, 3))).otherwise(date)
    date = date | (v.rlike(r"\p{L}") & ~v.rlike(r"\p{N}"))
    return F.when(role == "name", name).when(date, F.lit("not_a_day"))


def invalid_dictionary(values: DataFrame, rules: RejectRules) -> DataFrame:
    """feed, role, value, why: each distinct value is checked once; only invalid ones stay."""
    d = values.groupBy("feed", "role", "value").agg(F.count(F.lit(1)).alias("uses"))
    return d.withColumn("why", invalid_value(F.col("feed"), F.col("role"), F.col("value"), rules)).where("why is not null")


def _bad_values(checked: DataFrame, rules: RejectRules) -> DataFrame:
    """line_id of the sound lines with an invalid value; a line may come out for each."""
    values = _values(checked)
    return values.join(invalid_dictionary(values, rules).select("feed", "role", "value"), ["feed", "role", "value"], "left_semi").select("line_id")


def rejected_lines(files: DataFrame, lines: DataFrame, rules: RejectRules = RejectRules()) -> DataFrame:
    """line_id, reason (quoting, column_count or bad_value) of every line that must not load.

    Structural checks run on the line itself. Of the sound lines, each distinct value of the checked columns is judged
    once; the dictionary of invalid values joins back. Null lines count as empty ones, files without header line or
    files row have no case, a null separator is a comma. Empty tables give no rows; extra columns are ignored.
    Repeated line_ids come out once, with the gravest reason. Values of any length are judged whole.
    """
    checked = checked_lines(files, lines, rules)
    grave = F.when(F.col("structural") == "quoting", 1).otherwise(2)
    out = checked.where("structural is not null").select("line_id", grave.alias("code")).unionByName(_bad_values(checked, rules).select("line_id", F.lit(3).alias("code")))
    return out.groupBy("line_id").agg(F.min("code").alias("code")).select("line_id", F.element_at(F.array(*map(F.lit, ("quoting", "column_count", "bad_value"))), F.col("code")).alias("reason"))


def loadable_lines(files: DataFrame, lines: DataFrame, rules: RejectRules = RejectRules()) -> DataFrame:
    """The lines that load: line_id, file_id, feed, header, values (without quotes)."""
    bad = _bad_values(checked_lines(files, lines, rules), rules).distinct()
    good = parsed_lines(files, lines).where("structural is null").join(bad, "line_id", "left_anti")
    return good.select("line_id", "file_id", "line_no", "feed", "header", F.transform("cells", lambda c: unquoted(c, F.col("delim"))).alias("values"))
