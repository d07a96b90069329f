"""Entity resolution: blocking, pair scores, linkage weights, components, surviving records and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import similarity as S
from braidwork.functions.similarity import phonetic_code
from braidwork.session import cut

# Weights of the five attributes in the match score.
WEIGHTS = {"name": 0.3, "address": 0.2, "phone": 0.15, "email": 0.15, "id": 0.2}


def prefix_key(columns: list[Column]) -> Column:
    """First three characters of each non-empty attribute, joined by _; unknown if there are none."""
    parts = [F.when(F.length(c.cast("string")) > 0, F.lower(F.substring(c.cast("string"), 1, 3))) for c in columns]
    key = F.concat_ws("_", *parts)
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def blocking_keys(text: dict[str, Column], numbers: dict[str, Column] | None = None) -> Column:
    """Array of a record's keys: prefixes, phonetic codes of names, hundreds of numbers, and a prefix of the first two attributes. Nulls give none."""
    keys = []
    for name, c in text.items():
        low = F.lower(c)
        keys.append(F.when(F.length(c) >= 3, F.concat(F.lit(f"{name}:"), F.substring(low, 1, 3))))
        if "name" in name:
            keys.append(F.when(F.length(c) > 0, F.concat(F.lit(f"{name}~"), phonetic_code(c))))
    for name, c in (numbers or {}).items():
        keys.append(F.when(c.isNotNull(), F.concat(F.lit(f"{name}#"), (F.floor(F.abs(c.cast("double")) / 100) * F.signum(c.cast("double")) * 100).cast("bigint").cast("string"))))
    two = list(text.values())[:2]
    if len(two) == 2:
        keys.append(F.when((F.length(two[0]) > 0) & (F.length(two[1]) > 0), F.concat(F.lit("both:"), F.lower(F.substring(two[0], 1, 3)), F.lit("|"), F.lower(F.substring(two[1], 1, 3)))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def keyed(records: DataFrame, id_col: str, keys: Column) -> DataFrame:
    return records.select(F.col(id_col).alias("id"), F.explode(keys).alias("block"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """block, n and the pairs it would give; folded before any pair is formed."""
    return blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))


def block_summary(blocks: DataFrame, records: int | Column) -> DataFrame:
    """blocks, smallest, largest, mean size, candidate pairs before duplicates are dropped, naive pairs and the reduction in percent."""
    s = block_sizes(blocks)
    n = F.lit(records) if isinstance(records, int) else records
    naive = (n * (n - 1) / 2).cast("double")
    return s.agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.sum("pairs").alias("candidate_pairs")).withColumn("reduction", 100.0 * (1 - F.col("candidate_pairs") / naive))


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """id1 < id2 of records that share a block, each pair once."""
    other = blocks.select(F.col("id").alias("id2"), "block")
    return blocks.withColumnRenamed("id", "id1").join(other, "block").where("id1 < id2").select("id1", "id2").distinct()


def salted_pairs(blocks: DataFrame, part: int = 500) -> DataFrame:
    """id1 < id2 of records that share a block, as candidate_pairs, however large a block is.

    A block's records are cut into parts by hash and each two parts are joined under a key of their own, so no key holds
    more than two parts; every pair is still formed.
    """
    sizes = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    b = blocks.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    b = b.select("id", "block", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    x, y = b.toDF("id1", "block", "own1", "lo", "hi"), b.toDF("id2", "block", "own2", "lo", "hi")
    return x.join(y, ["block", "lo", "hi"]).where("id1 < id2 and (lo = hi or own1 <> own2)").select("id1", "id2").distinct()


def class_pairs(records: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """class1, class2, pairs: the candidate pairs of records, folded to classes of equal sets of keys.

    A class is named by its least id. class1 = class2 stands for the pairs inside a class. Records without keys have none.
    """
    held = records.select(F.col(id_col).alias("id"), F.array_sort(keys).alias("keys")).where(F.size("keys") > 0)
    classes = cut(held.groupBy("keys").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    n = classes.select("id", "n")
    across = salted_pairs(classes.select("id", F.explode("keys").alias("block"))).join(n.toDF("id1", "n1"), "id1").join(n.toDF("id2", "n2"), "id2")
    across = across.select(F.col("id1").alias("class1"), F.col("id2").alias("class2"), (F.col("n1") * F.col("n2")).alias("pairs"))
    return across.unionByName(n.where("n > 1").select(F.col("id").alias("class1"), F.col("id").alias("class2"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs")))


def name_score(a: Column, b: Column, with_jaro: bool = True) -> Column:
    parts = [S.levenshtein(a, b), S.token_jaccard(a, b)] + ([S.jaro_winkler(a, b)] if with_jaro else [])
    return F.greatest(*parts)


def match_score(features: dict[str, Column]) -> Column:
    """Weighted sum over the five attributes; a missing one counts as disagreement."""
    return sum((F.coalesce(features[k], F.lit(0.0)) * w for k, w in WEIGHTS.items() if k in features), F.lit(0.0))


def match_type(score: Column, exact: float = 0.95, fuzzy: float = 0.75) -> Column:
    return F.when(score >= exact, "EXACT").when(score >= fuzzy, "FUZZY").otherwise("NO_MATCH")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id) of every vertex, isolated ones too. Edges a, b are undirected; unknown ends are dropped.

    Each round takes the least label around and then the label's own label, so paths halve; lineage is cut in the
    shared folder each round, and nothing but whether labels changed reaches the driver.
    """
    v = vertices.select("id").where("id is not null").distinct()
    e = edges.select("a", "b").where("a <> b").distinct()
    e = e.join(v.withColumnRenamed("id", "a"), "a", "left_semi").join(v.withColumnRenamed("id", "b"), "b", "left_semi")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        around = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("lb"))
        near = label.join(around, label["id"] == around["a"]).select("id", "label", F.least("label", "lb").alias("nxt"))
        up = near.select(F.col("id").alias("nxt"), F.col("nxt").alias("top"))
        moved = cut(near.join(up, "nxt").select("id", F.col("top").alias("label"), (F.col("top") < F.col("label")).alias("moved")))
        label = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return v.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def representatives(records: DataFrame, clusters: DataFrame, attributes: list[str], degree: DataFrame | None = None) -> DataFrame:
    """component, representative: the record with the most filled attributes plus 0.1 per link; of equals the least id."""
    filled = sum((F.when(F.length(F.col(a).cast("string")) > 0, 1.0).otherwise(0.0) for a in attributes), F.lit(0.0)) / len(attributes)
    d = records.withColumn("score", filled)
    if degree is not None:
        d = d.join(degree, "id", "left").withColumn("score", F.col("score") + 0.1 * F.coalesce("links", F.lit(0)))
    d = d.join(clusters, "id")
    return d.groupBy("component").agg(F.min_by("id", F.struct(-F.round("score", 9), F.col("id"))).alias("representative"))


def golden_records(records: DataFrame, clusters: DataFrame, attributes: list[str], degree: DataFrame | None = None) -> DataFrame:
    """component, representative, size and one value per attribute: the longest text, the representative's own of equals."""
    rep = representatives(records, clusters, attributes, degree)
    d = records.join(clusters, "id").join(rep, "component")
    own = F.when(F.col("id") == F.col("representative"), 0).otherwise(1)
    pick = [F.min_by(a, F.when(F.length(F.col(a).cast("string")) > 0, F.struct(-F.length(F.col(a).cast("string")), own, F.col("id")))).alias(a) for a in attributes]
    return d.groupBy("component").agg(F.first("representative").alias("representative"), F.count(F.lit(1)).alias("size"), *pick)


def agreement_rates(pairs: DataFrame) -> DataFrame:
    """attribute, m, u from attribute, agree, is_match: shares of agreement among matches and others; 0.9 and 0.1 without any such pair."""
    share = lambda want: F.count_if(F.col("agree") & want) / F.nullif(F.count_if(want), F.lit(0))
    return pairs.groupBy("attribute").agg(F.coalesce(share(F.col("is_match")), F.lit(0.9)).alias("m"), F.coalesce(share(~F.col("is_match")), F.lit(0.1)).alias("u"))


def linkage_weights(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """pair, weight, match_type from pair, attribute, agree: the sum of log ratios; terms with a zero side are left out."""
    d = pairs.join(F.broadcast(rates), "attribute", "left").withColumns({"m": F.coalesce("m", F.lit(0.9)), "u": F.coalesce("u", F.lit(0.1))})
    ratio = lambda x, y: F.when((x > 0) & (y > 0), F.ln(x / y)).otherwise(0.0)
    term = F.when(F.col("agree"), ratio(F.col("m"), F.col("u"))).otherwise(ratio(1 - F.col("m"), 1 - F.col("u")))
    w = d.groupBy("pair").agg(F.sum(term).alias("weight"))
    return w.withColumn("match_type", F.when(F.col("weight") > 2, "EXACT").when(F.col("weight") > 0, "PROBABILISTIC").otherwise("NO_MATCH"))


def trained_weights(examples: list[tuple[dict[str, float], bool]], weights: dict[str, float] | None = None, rate: float = 0.01, least: float = 0.75) -> dict[str, float]:
    """Perceptron steps over labelled feature rows in their order, then weights scaled to sum 1."""
    w = dict(weights or WEIGHTS)
    for features, label in examples:
        said = sum(w[k] * features.get(k, 0.0) for k in w) >= least
        if said != label:
            for k in w:
                w[k] = max(0.0, w[k] + rate * (1 if label else -1) * features.get(k, 0.0))
    total = sum(w.values()) or 1.0
    return {k: v / total for k, v in w.items()}


def pairwise_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two clusterings (id, cluster), from counts of pairs.

    The pairs are counted, not formed: of n members there are n(n-1)/2, so a large cluster costs no more than a small one.
    """
    pairs = lambda d, *by: d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("bigint").alias("k"))
    d = found.select("id", F.col("cluster").alias("f")).join(truth.select("id", F.col("cluster").alias("t")), "id")
    x = pairs(d, "f", "t").toDF("tp").crossJoin(pairs(d, "f").toDF("nf")).crossJoin(pairs(d, "t").toDF("nt"))
    x = x.select("tp", (F.col("nf") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    x = x.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
