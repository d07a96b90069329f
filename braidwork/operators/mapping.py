"""Mapping fields between schemas. Inputs are tables of field names, so pairs of fields are few whatever the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.naming import field_similarity, jaccard, name_tokens, token_similarity

# Precedence of the types a unified field may take.
TYPE_RANK = {"identifier": 1, "timestamp": 2, "datetime": 2, "date": 3, "float": 4, "integer": 5, "boolean": 6, "string": 7, "text": 8, "unknown": 9}


def similarity_matrix(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_field, target_field, similarity of every pair of names (source(field), target(field))."""
    pairs = source.select(F.col("field").alias("source_field")).crossJoin(F.broadcast(target.select(F.col("field").alias("target_field"))))
    return pairs.withColumn("similarity", field_similarity(F.col("source_field"), F.col("target_field")))


def best_mappings(matrix: DataFrame, least: float = 0.5) -> DataFrame:
    """The best target of each source at least so similar; of equals the first by name."""
    w = Window.partitionBy("source_field").orderBy(F.desc("similarity"), "target_field")
    return matrix.withColumn("place", F.row_number().over(w)).where((F.col("place") == 1) & (F.col("similarity") >= least)).drop("place")


def combined_score(semantic: Column, pattern: Column, weight: float = 0.7) -> Column:
    return weight * semantic + (1 - weight) * pattern


def token_matrix(pairs: DataFrame) -> DataFrame:
    """Adds token_similarity to source_field, target_field."""
    d = pairs.withColumns({"ta": name_tokens(F.col("source_field")), "tb": name_tokens(F.col("target_field"))})
    return d.withColumn("token_similarity", token_similarity(F.col("ta"), F.col("tb"))).drop("ta", "tb")


def one_to_one(scores: DataFrame, least: float = 0.6, direct: float = 0.9) -> DataFrame:
    """Greedy mapping: sources in their order (source_place) take the best free target. The scores are pairs of field names, a bounded table."""
    rows = sorted(scores.where(F.col("score") >= least).collect(), key=lambda r: (r["source_place"], -r["score"], r["target_field"]))
    taken, out, done = set(), [], set()
    for r in rows:
        if r["source_field"] not in done and r["target_field"] not in taken:
            out.append((r["source_field"], r["target_field"], float(r["score"]), "direct" if r["score"] > direct else "fuzzy"))
            taken.add(r["target_field"])
            done.add(r["source_field"])
    return scores.sparkSession.createDataFrame(out, "source_field string, target_field string, confidence double, mapping_type string")


def mapping_confidence(source: Column, target: Column, type_confidence: Column) -> Column:
    """0.5, plus 0.3 for equal names or 0.2 for one within the other, 0.1 per abbreviation, 0.2 times the type's confidence; 1 at most."""
    s, t = F.lower(source), F.lower(target)
    near = F.when(s == t, 0.3).when(s.contains(t) | t.contains(s), 0.2).otherwise(0.0)
    hints = sum((F.when(s.contains(a) & t.contains(full), 0.1).otherwise(0.0) for a, full in (("cust", "customer"), ("id", "identifier"), ("qty", "quantity"), ("amt", "amount"), ("dt", "date"))), F.lit(0.0))
    return F.least(F.lit(1.0), 0.5 + near + hints + 0.2 * type_confidence)


def ambiguities(mappings: DataFrame, gap: float = 0.1, most: int = 3) -> DataFrame:
    """source_field, target_field, confidence, place, ambiguity: up to three candidates of each source whose two best lie within the gap."""
    w = Window.partitionBy("source_field").orderBy(F.desc("confidence"), "target_field")
    d = mappings.withColumns({"place": F.row_number().over(w), "next": F.lead("confidence").over(w)})
    d = d.withColumn("lead_gap", F.max(F.when(F.col("place") == 1, F.col("confidence") - F.col("next"))).over(Window.partitionBy("source_field")))
    return d.where((F.col("lead_gap") < gap) & (F.col("place") <= most)).select("source_field", "target_field", "confidence", "place", (1 - F.col("lead_gap")).alias("ambiguity"))


def resolved(ambiguous: DataFrame, least: float = 0.7) -> DataFrame:
    """source_field, resolution: a candidate of the same name, else the best one over least, else null."""
    same = F.max(F.when(F.lower("target_field") == F.lower("source_field"), F.col("target_field")))
    best = F.max(F.when((F.col("place") == 1) & (F.col("confidence") > least), F.col("target_field")))
    return ambiguous.groupBy("source_field").agg(F.coalesce(same, best).alias("resolution"))


def canonical_name(names: DataFrame) -> DataFrame:
    """grp, canonical from grp, place, name: the shortest lower-case name with _, else the longest; of equals the first."""
    good = (F.col("name") == F.lower("name")) & F.col("name").contains("_")
    short = F.min_by("name", F.when(good, F.struct(F.length("name"), F.col("place"))))
    long = F.min_by("name", F.struct(-F.length("name"), F.col("place")))
    return names.groupBy("grp").agg(F.coalesce(F.when(F.count_if(good) > 0, short), long).alias("canonical"))


def canonical_type(types: DataFrame) -> DataFrame:
    """grp, canonical from grp, type: the type of the lowest rank; unknown types rank last."""
    rank = F.create_map(*[x for k, v in TYPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return types.groupBy("grp").agg(F.min_by("type", F.struct(F.coalesce(F.try_element_at(rank, F.col("type")), F.lit(9)), F.col("type"))).alias("canonical"))


def value_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """common, either, jaccard of the distinct non-null values of a(value) and b(value), by one aggregation of both."""
    x = a.where("value is not null").select("value", F.lit(1).alias("side")).unionByName(b.where("value is not null").select("value", F.lit(2).alias("side")))
    d = x.groupBy("value").agg(F.bit_or("side").alias("sides")).agg(F.count_if(F.col("sides") == 3).alias("common"), F.count(F.lit(1)).alias("either"))
    return d.select("common", "either", F.when(F.col("either") == 0, 0.0).otherwise(F.col("common") / F.col("either")).alias("jaccard"))


def unified_fields(columns: DataFrame, edges: DataFrame | None = None, mode: str = "edges") -> DataFrame:
    """group, sources: columns (source, field, semantic) grouped by meaning (mode semantic) or by mapping edges (source_field, target_field)."""
    if mode == "semantic":
        return columns.groupBy(F.col("semantic").alias("grp")).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("source", "field")))).alias("source_mappings"))
    from braidwork.operators.entities import components

    c = components(columns.select(F.col("field").alias("id")).distinct(), edges.select(F.col("source_field").alias("a"), F.col("target_field").alias("b")))
    d = columns.join(c.withColumnRenamed("id", "field"), "field")
    return d.groupBy(F.col("component").alias("grp")).agg(F.sort_array(F.collect_set(F.struct("source", "field"))).alias("source_mappings"))


def view_sql(name: str, fields: list[str], sources: dict[str, dict[str, str]]) -> str:
    """The text of a view that unites the sources (table to {canonical: own column}) over the canonical fields."""
    quote = lambda x: "`" + x.replace("`", "``") + "`"
    parts = []
    for table, own in sources.items():
        cols = [f"{quote(own[f])} AS {quote(f)}" if f in own else f"NULL AS {quote(f)}" for f in fields]
        parts.append(f"SELECT {', '.join(cols)} FROM {quote(table)}")
    return f"CREATE OR REPLACE TEMP VIEW {quote(name)} AS " + " UNION ALL ".join(parts)


def stream_similarity(name: Column, types_a: Column, types_b: Column, patterns_a: Column, patterns_b: Column, values_a: Column, values_b: Column) -> Column:
    """0.4 name, 0.3 types, 0.2 patterns, 0.1 values where both hold fewer than 100 distinct ones."""
    few = (F.size(values_a) < 100) & (F.size(values_b) < 100)
    return 0.4 * name + 0.3 * jaccard(types_a, types_b) + 0.2 * jaccard(patterns_a, patterns_b) + F.when(few, 0.1 * jaccard(values_a, values_b)).otherwise(0.0)
