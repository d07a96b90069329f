"""What kind of values a text column holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for null, and the pattern of each label, in order of precedence.
NULL_WORDS = ("", "null", "NULL", "None", "none", "N/A", "n/a", "#N/A", "-", "--")
LABELS = {
    "integer": r"^-?\d+$",
    "float": r"^(-?\d+\.\d+|-?\d+\.?\d*[eE][+-]?\d+)$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "date_eu": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "boolean": r"^(true|false|yes|no|y|n|0|1|active|inactive)$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[+]?[(]?[0-9]{3}[)]?[-\s.]?[0-9]{3}[-\s.]?[0-9]{4,6}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "currency": r"^([$£€]\s*[\d,]+\.?\d*|[\d,]+\.?\d*\s*[$£€])$",
}
DISTRIBUTED = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^[+]?[\d\s()-]{7,}$", "date": r"^\d{4}-\d{2}-\d{2}", "identifier": r"^[A-Z]{2,}-?\d+$", "url": r"^https?://"}


def null_if_word(c: Column) -> Column:
    return F.when(~c.isin(*NULL_WORDS), c)


def value_labels(c: Column) -> Column:
    """All labels a text fits, in the order of LABELS; [null] for a null word, [string] if none fits; null for null."""
    fits = F.array_compact(F.array(*[F.when(c.rlike("(?i)" + p), F.lit(k)) for k, p in LABELS.items()]))
    return F.when(c.isNull(), None).when(c.isin(*NULL_WORDS), F.array(F.lit("null"))).when(F.size(fits) == 0, F.array(F.lit("string"))).otherwise(fits)


def simple_kind(c: Column) -> Column:
    """Aggregate: struct kind, confidence of all values of a text column: null, integer, float, date, boolean or string."""
    v = F.when(~c.isin("", "NULL"), c)
    every = lambda test: F.coalesce(F.bool_and(F.when(v.isNotNull(), test)), F.lit(False))
    none = F.count(v) == 0
    date = [every(v.rlike(p)) for p in (r"^\d{4}-\d{2}-\d{2}", r"^\d{1,2}/\d{1,2}/\d{4}", r"^\d{1,2}-\d{1,2}-\d{4}")]
    kind = (
        F.when(none, F.lit("null")).when(every(v.rlike(r"^\s*[+-]?\d+\s*$")), F.lit("integer")).when(every(v.try_cast("double").isNotNull()), F.lit("float"))
        .when(date[0] | date[1] | date[2], F.lit("date")).when(every(F.lower(v).isin("true", "false", "yes", "no", "1", "0", "y", "n")), F.lit("boolean")).otherwise(F.lit("string"))
    )
    sure = F.create_map(*[x for k, s in (("null", 1.0), ("integer", 0.9), ("float", 0.9), ("date", 0.85), ("boolean", 0.8), ("string", 0.7)) for x in (F.lit(k), F.lit(s))])
    return F.struct(kind.alias("kind"), F.try_element_at(sure, kind).alias("confidence"))
