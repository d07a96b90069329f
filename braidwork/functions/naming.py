"""Field names: normal forms, classes of writing, meaning and similarity, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of business field names that mean the same, and abbreviations with what they stand for.
SYNONYMS = {
    "customer": ("client", "buyer", "purchaser", "consumer", "account"),
    "identifier": ("id", "key", "code", "number", "ref", "reference"),
    "product": ("item", "article", "sku", "merchandise", "goods"),
    "quantity": ("qty", "amount", "count", "units", "volume"),
    "price": ("cost", "rate", "fee", "charge", "amount"),
    "date": ("time", "timestamp", "datetime", "when", "period"),
    "status": ("state", "condition", "flag", "active", "enabled"),
    "name": ("title", "label", "description", "desc"),
    "address": ("location", "place", "site", "destination"),
    "email": ("mail", "contact", "electronic_mail"),
    "phone": ("telephone", "tel", "mobile", "cell", "contact_number"),
    "order": ("purchase", "transaction", "sale", "invoice"),
    "supplier": ("vendor", "provider", "manufacturer", "source"),
    "warehouse": ("depot", "storage", "facility", "distribution_center", "dc"),
    "shipment": ("delivery", "consignment", "cargo", "freight"),
}
ABBREVIATIONS = {
    "cust": "customer", "qty": "quantity", "amt": "amount", "dt": "date", "id": "identifier", "ref": "reference", "desc": "description", "addr": "address", "tel": "telephone", "wh": "warehouse",
    "dc": "distribution_center", "sku": "stock_keeping_unit", "po": "purchase_order", "inv": "inventory", "mfg": "manufacturing", "prd": "product", "sup": "supplier", "shp": "shipment", "dlv": "delivery",
}
# Parts of names that tell a meaning, in order of precedence, for both rule sets.
MEANINGS = {
    "v1": (
        ("identifier", "id|key|code|number"), ("timestamp", "date|time|created|updated|modified"), ("monetary", "amount|price|cost|total|sum"), ("quantity", "quantity|qty|count|number"),
        ("status", "status|state|flag|active"), ("text", "name|title|description"), ("email", "email|mail"), ("phone", "phone|tel|mobile"), ("location", "address|location|city|country"),
    ),
    "v2": (
        ("identifier", "id|key|code|number"), ("timestamp", "date|time|created|updated"), ("monetary", "amount|price|cost|total"), ("quantity", "quantity|qty|count"),
        ("status", "status|state|flag"), ("email", "email|mail"), ("phone", "phone|tel"), ("location", "address|city|country"),
    ),
}
PATTERNS = ("snake_case", "camelCase", "PascalCase", "UPPER_CASE", "mixed")


def normalize_name(c: Column) -> Column:
    """Lower case, runs of other characters as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def header_pattern(c: Column) -> Column:
    """The first class of PATTERNS that fits; null and empty names are mixed."""
    return (
        F.when((c == F.lower(c)) & c.contains("_"), F.lit("snake_case"))
        .when(c.rlike("^[a-z].*[A-Z]"), F.lit("camelCase"))
        .when(c.rlike("^[A-Z].*[A-Z]"), F.lit("PascalCase"))
        .when((c == F.upper(c)) & (c != ""), F.lit("UPPER_CASE"))
        .otherwise(F.lit("mixed"))
    )


def header_words(c: Column) -> Column:
    """Word parts of a header; where none is found, the parts between blanks."""
    plain = F.regexp_replace(c, r"[^\w\s]", "")
    parts = F.regexp_extract_all(plain, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b))"), F.lit(1))
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.split(F.trim(plain), r"\s+"), lambda x: x != ""))


def standardize_header(c: Column, style: str = "snake_case") -> Column:
    """A header in snake_case, camelCase or PascalCase."""
    w = header_words(c)
    if style == "snake_case":
        return F.lower(F.array_join(w, "_"))
    capital = F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
    if style == "PascalCase":
        return capital
    if style == "camelCase":
        return F.concat(F.lower(F.substring(capital, 1, 1)), F.substring(capital, F.lit(2), F.length(capital)))
    raise ValueError(f"unknown style {style}")


def semantic_type(c: Column, ruleset: str = "v1", sample: Column | None = None) -> Column:
    """Meaning of a field by its name; rule set v1 then looks at a sample value."""
    out = None
    for meaning, pattern in MEANINGS[ruleset]:
        hit = F.lower(c).rlike(pattern)
        out = F.when(hit, F.lit(meaning)) if out is None else out.when(hit, F.lit(meaning))
    if ruleset == "v1" and sample is not None:
        out = out.when(sample.contains("@"), F.lit("email")).when(sample.rlike(r"^[A-Z]{2,}-?\d+"), F.lit("identifier")).when(sample.rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit("timestamp"))
    return out.otherwise(F.lit("general"))


def name_tokens(c: Column) -> Column:
    """Lower-case words of a field name, abbreviations written out."""
    t = F.regexp_replace(F.regexp_replace(c, r"[_\-.]", " "), r"([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    long = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ABBREVIATIONS.items()))
    words = F.filter(F.split(F.lower(F.trim(t)), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(long, w), w))


def token_similarity(a: Column, b: Column) -> Column:
    """Of two token arrays: shared words over the longer; else synonym pairs times 0.8; else contained words times 0.6."""
    longer = F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    groups = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in SYNONYMS.values()])
    count = lambda test: F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: test(x, y))))
    meant = count(lambda x, y: F.exists(groups, lambda g: F.array_contains(g, x) & F.array_contains(g, y)))
    within = count(lambda x, y: (F.length(x) > 3) & (F.length(y) > 3) & (x.contains(y) | y.contains(x)))
    return (
        F.when((longer == 0) | (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(shared > 0, shared / longer)
        .when(meant > 0, meant * 0.8 / longer)
        .otherwise(within * 0.6 / longer)
    )


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[_ ]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal without case, else the Jaccard index of the words."""
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(jaccard(_word_set(a), _word_set(b)))


def field_similarity(a: Column, b: Column) -> Column:
    """name_similarity, at least 0.7 if one name contains the other."""
    la, lb = F.lower(a), F.lower(b)
    base = name_similarity(a, b)
    return F.when(la == lb, F.lit(1.0)).when(la.contains(lb) | lb.contains(la), F.greatest(F.lit(0.7), base)).otherwise(base)


def display_name(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))
