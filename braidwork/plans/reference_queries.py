"""Queries over the relational tables, one for each operator of the inventory, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import naming as N
from braidwork.functions import similarity as S
from braidwork.operators import entities as E
from braidwork.operators import feedback as V
from braidwork.operators import lake as L
from braidwork.operators import mapping as M
from braidwork.operators import monitoring as Q
from braidwork.operators import profiles as P
from braidwork.operators.unify import Registry, renamed, sample_queries, united
from braidwork.session import read_table
from braidwork.streaming import streams as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str | F.Column, alias: str | None = None, digits: int = 6):
    """A double rounded for comparison."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits).alias(alias or c)


def rows(spark: SparkSession, schema: str, *data: tuple) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def values(names: str, *data: tuple) -> str:
    """A literal table in SQL."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, d)) + ")" for d in data) + f") AS t({names})"


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c = renamed(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"})
    s = renamed(read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"})
    return {"customer": c, "supplier": s}


_UNITED = """(SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS _source FROM customer
 UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier)"""


@query(f"SELECT _source, count(*) AS n, count(DISTINCT id) AS ids, count(segment) AS segments FROM {_UNITED} GROUP BY _source")
def unified_view_counts(spark, d):
    reg = Registry(spark)
    for n, df in _sources(spark, d).items():
        reg.register(n, df)
    reg.bind("unified_data")
    return reg.query("SELECT _source, count(*) AS n, count(DISTINCT id) AS ids, count(segment) AS segments FROM unified_data GROUP BY _source")


@query(f"SELECT * FROM {_UNITED}")
def unified_view_rows(spark, d):
    return united(_sources(spark, d)).select("id", "name", "nation", "balance", "segment", "_source")


@query("""SELECT id, name, nation, balance, price, _source FROM (
 SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS price, 'customer' AS _source FROM customer
 UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, NULL, p_retailprice, 'part' FROM part)""")
def union_missing_columns(spark, d):
    s = _sources(spark, d)
    part = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return united({"customer": s["customer"].drop("segment"), "supplier": s["supplier"], "part": part}).select("id", "name", "nation", "balance", "price", "_source")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1000")
def filter_limit(spark, d):
    return read_table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(1000)


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1")
def status_aggregate(spark, d):
    return read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), "mean_price"))


@query("SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, round(avg(o_totalprice), 6) AS mean_price FROM orders WHERE o_totalprice > 100 GROUP BY 1 HAVING count(*) > 1000")
def complex_having(spark, d):
    g = read_table(spark, d, "orders").where("o_totalprice > 100").groupBy("o_orderstatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"), r(F.avg("o_totalprice"), "mean_price")).where("n > 1000")


@query("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem")
def sample_query_sum_avg(spark, d):
    read_table(spark, d, "lineitem").createOrReplaceTempView("lineitem_view")
    text = sample_queries("lineitem_view", {"l_linenumber": "general", "l_quantity": "quantity"})[-1]
    return spark.sql(text).select(r("total", digits=4), r("mean"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 5) AS mean_value, round(median({c})::DOUBLE, 5) AS median_value, round(stddev_samp({c}), 5) AS std_value FROM lineitem" for c in _NUM))
def profile_numeric(spark, d):
    return P.profile_numeric(read_table(spark, d, "lineitem"), _NUM).withColumns({k: F.round(k, 5) for k in ("mean_value", "median_value", "std_value")})


_STR = [("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length FROM {t}" for t, c in _STR))
def profile_string(spark, d):
    parts = [P.profile_string(read_table(spark, d, t), [c for x, c in _STR if x == t]) for t in ("part", "customer")]
    return parts[0].unionByName(parts[1]).withColumn("avg_length", F.round("avg_length", 6))


@query("WITH x AS (SELECT doc_id, text, nullif(lang, 'fr') AS lang, source FROM documents) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS null_percent FROM x" for c in ("doc_id", "text", "lang", "source")))
def null_profile(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", "text", F.expr("nullif(lang, 'fr')").alias("lang"), "source")
    return P.null_profile(x).withColumn("null_percent", r("null_percent"))


@query("WITH x AS (SELECT doc_id, text, nullif(lang, 'fr') AS lang, source FROM documents), y AS (SELECT sum((doc_id IS NULL)::INT + (text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT)::BIGINT AS null_cells, count(*) * 4 AS cells FROM x) SELECT null_cells, cells, round(100.0 - 100.0 * null_cells / cells, 6)::DOUBLE AS completeness, round(greatest(0, least(100, 100 - 5 * (100.0 * null_cells / cells))), 6)::DOUBLE AS score FROM y")
def completeness_score(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", "text", F.expr("nullif(lang, 'fr')").alias("lang"), "source")
    return P.completeness(x).withColumn("score", r(P.quality_score(100.0 - F.col("completeness"), F.lit(1.0), F.lit(0)), "score")).withColumn("completeness", r("completeness"))


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) / count(*) AS uniqueness FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")) + ") SELECT column_name, round(uniqueness, 6) AS uniqueness, CASE WHEN uniqueness > 0.95 THEN 'primary_key_candidate' WHEN regexp_matches(lower(column_name), 'id|key|ref') THEN 'foreign_key_candidate' ELSE 'none' END AS key_class FROM u")
def potential_keys(spark, d):
    return P.potential_keys(read_table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]).withColumn("uniqueness", r("uniqueness"))


@query("SELECT count(DISTINCT o_custkey) AS child_keys, count(DISTINCT c_custkey) AS held_keys FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def key_inclusion(spark, d):
    return P.inclusion(read_table(spark, d, "orders"), "o_custkey", read_table(spark, d, "customer"), "c_custkey")


@query("SELECT * FROM " + values("column_name, kind, confidence", ("event_id", "integer", 0.9), ("user_id", "integer", 0.9), ("event_type", "string", 0.7), ("value", "float", 0.9), ("ts", "date", 0.85)).replace("0.9)", "0.9::DOUBLE)").replace("0.7)", "0.7::DOUBLE)").replace("0.85)", "0.85::DOUBLE)"))
def type_inference_simple(spark, d):
    return P.kinds(read_table(spark, d, "events"), ["event_id", "user_id", "event_type", "value", "ts"])


@query("""WITH c AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderkey', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders),
 l AS (SELECT column_name, unnest(list_filter([CASE WHEN regexp_matches(v, '^-?\\d+$') THEN 'integer' END, CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date_iso' END, CASE WHEN lower(v) IN ('true','false','yes','no','y','n','0','1','active','inactive') THEN 'boolean' END,
 CASE WHEN regexp_matches(v, '^[+]?[(]?[0-9]{3}[)]?[-\\s.]?[0-9]{3}[-\\s.]?[0-9]{4,6}$') THEN 'phone' END], lambda x: x IS NOT NULL)) AS label FROM c)
 SELECT column_name, label, count(*) AS uses FROM l GROUP BY ALL UNION ALL SELECT column_name, 'string', count(*) FROM c WHERE NOT (regexp_matches(v, '^-?\\d+$') OR regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') OR lower(v) IN ('true','false','yes','no','y','n','0','1','active','inactive')) GROUP BY ALL""")
def type_labels(spark, d):
    o = read_table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return P.label_counts(o)


@query("SELECT 'o_orderstatus' AS column_name, 'string' AS primary_type, 1.0::DOUBLE AS consistency UNION ALL SELECT 'o_orderkey', 'integer', 1.0 UNION ALL SELECT 'o_totalprice', 'float', 1.0")
def column_types(spark, d):
    return P.column_types(read_table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice")))


_HEADERS = ("Customer_ID", "Full_Name", "Email_Address", "Registration_Date", "Account_Status", "CustID", "CustomerName", "ContactEmail", "SignupDate", "Status", "client_number", "name", "email_addr", "created_at", "active", "FLD01", "MFG_DT", "unitPrice", "_AB")


def _headers(spark):
    return rows(spark, "header string", *[(h,) for h in _HEADERS])


_HV = values("header", *[(h,) for h in _HEADERS])


def _meaning_sql(rs: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(header), '{p}') THEN '{m}'" for m, p in N.MEANINGS[rs]) + " ELSE 'general' END"


@query(f"SELECT header, {_meaning_sql('v1')} AS v1, {_meaning_sql('v2')} AS v2 FROM {_HV}")
def semantic_type_by_name(spark, d):
    h = F.col("header")
    return _headers(spark).select("header", N.semantic_type(h).alias("v1"), N.semantic_type(h, "v2").alias("v2"))


@query("SELECT *, CASE WHEN n_email > 0.8 * n_values THEN 'email' ELSE 'general' END AS semantic FROM (SELECT 'ContactEmail' AS column_name, count(*) AS n_values, count(*) FILTER (WHERE regexp_matches(ContactEmail, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS n_email FROM customers_v2 WHERE ContactEmail IS NOT NULL)")
def semantic_type_by_pattern(spark, d):
    return P.pattern_semantics(read_table(spark, d, "customers_v2"), ["ContactEmail"]).select("column_name", "n_values", "n_email", "semantic")


@query(f"SELECT header, trim(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '_') AS normalized FROM {_HV}")
def normalize_names(spark, d):
    return _headers(spark).select("header", N.normalize_name(F.col("header")).alias("normalized"))


@query(f"""WITH p AS (SELECT CASE WHEN header = lower(header) AND contains(header, '_') THEN 'snake_case' WHEN regexp_matches(header, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(header, '^[A-Z].*[A-Z]') THEN 'PascalCase' WHEN header = upper(header) THEN 'UPPER_CASE' ELSE 'mixed' END AS pattern FROM {_HV}),
 c AS (SELECT pattern, count(*) AS uses FROM p GROUP BY 1) SELECT pattern, uses, round((SELECT max(uses) FROM c) / (SELECT sum(uses) FROM c), 6)::DOUBLE AS consistency FROM c""")
def header_patterns(spark, d):
    return P.header_consistency(_headers(spark)).select("pattern", "uses", r("consistency"))


@query()
def header_standardize(spark, d):
    h = F.col("header")
    return _headers(spark).select("header", *[N.standardize_header(h, s).alias(s) for s in ("snake_case", "camelCase", "PascalCase")])


def _facts(spark, d, t, prefix):
    f = P.schema_facts(read_table(spark, d, t))
    return f.withColumn("column_name", F.regexp_replace("column_name", f"^{prefix}_", ""))


@query("SELECT * FROM " + values("field, change, old_type, new_type", ("custkey", "removed", "bigint", None), ("mktsegment", "removed", "string", None), ("suppkey", "added", None, "bigint")))
def schema_diff(spark, d):
    return P.schema_diff(_facts(spark, d, "customer", "c"), _facts(spark, d, "supplier", "s"))


_OC, _LC = ("orderkey", "custkey", "orderstatus", "totalprice", "orderdate", "orderpriority"), ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")
_SIM = """CASE WHEN s = t THEN 1.0 ELSE greatest(CASE WHEN contains(s, t) OR contains(t, s) THEN 0.7 ELSE 0.0 END, len(list_intersect(string_split(s, '_'), string_split(t, '_'))) / len(list_distinct(list_concat(string_split(s, '_'), string_split(t, '_'))))) END::DOUBLE"""
_PAIRS = f"(SELECT a.f AS s, b.f AS t FROM {values('f', *[(x,) for x in _OC]).replace('AS t(', 'AS a(')} CROSS JOIN {values('f', *[(x,) for x in _LC]).replace('AS t(', 'AS b(')})"


def _matrix(spark):
    return M.similarity_matrix(rows(spark, "field string", *[(c,) for c in _OC]), rows(spark, "field string", *[(c,) for c in _LC]))


@query(f"SELECT s AS source_field, t AS target_field, round({_SIM}, 6) AS similarity FROM {_PAIRS}")
def field_similarity_matrix(spark, d):
    return _matrix(spark).withColumn("similarity", r("similarity"))


@query(f"SELECT source_field, target_field, similarity FROM (SELECT s AS source_field, t AS target_field, {_SIM} AS similarity, row_number() OVER (PARTITION BY s ORDER BY {_SIM} DESC, t) AS k FROM {_PAIRS}) WHERE k = 1 AND similarity >= 0.5")
def best_mapping(spark, d):
    return M.best_mappings(_matrix(spark))


@query(f"SELECT source_field, target_field, round(score, 6) AS score FROM (SELECT s AS source_field, t AS target_field, 0.7 * {_SIM} + 0.15 AS score, row_number() OVER (PARTITION BY s ORDER BY {_SIM} DESC, t) AS k FROM {_PAIRS}) WHERE k = 1 AND score > 0.5")
def best_combined_mapping(spark, d):
    m = _matrix(spark).withColumn("similarity", M.combined_score(F.col("similarity"), F.lit(0.5)))
    return M.best_mappings(m, 0.5).where("similarity > 0.5").select("source_field", "target_field", r("similarity", "score"))


_TOK = (("Customer_ID", "CustID"), ("Customer_ID", "client_number"), ("Full_Name", "CustomerName"), ("Email_Address", "ContactEmail"), ("qty", "Quantity"), ("orderDate", "purchase_date"))


@query("SELECT * FROM " + values("source_field, target_field, token_similarity", ("Customer_ID", "CustID", 1.0), ("qty", "Quantity", 1.0), ("Full_Name", "CustomerName", 0.5), ("Email_Address", "ContactEmail", 0.5), ("orderDate", "purchase_date", 0.5)).replace("1.0)", "1.0::DOUBLE)").replace("0.5)", "0.5::DOUBLE)") + " UNION ALL SELECT 'Customer_ID', 'client_number', 0.0")
def token_similarity(spark, d):
    return M.token_matrix(rows(spark, "source_field string, target_field string", *_TOK)).withColumn("token_similarity", r("token_similarity"))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer), b AS (SELECT DISTINCT s_nationkey AS v FROM supplier), i AS (SELECT count(*) AS common FROM (SELECT v FROM a INTERSECT SELECT v FROM b)), u AS (SELECT count(*) AS either FROM (SELECT v FROM a UNION SELECT v FROM b)) SELECT common, either, round(common / either, 6) AS jaccard FROM i, u")
def data_overlap_jaccard(spark, d):
    return M.value_overlap(read_table(spark, d, "customer").select(F.col("c_nationkey").alias("value")), read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("value"))).withColumn("jaccard", r("jaccard"))


_TYPES = (("a", "string"), ("a", "identifier"), ("b", "float"), ("b", "integer"), ("c", "text"), ("c", "date"), ("d", "boolean"), ("d", "string"))


@query("SELECT * FROM " + values("grp, canonical", ("a", "identifier"), ("b", "float"), ("c", "date"), ("d", "boolean")))
def canonical_type(spark, d):
    return M.canonical_type(rows(spark, "grp string, type string", *_TYPES))


_NAMES = (("id", 1, "Customer_ID"), ("id", 2, "customer_id"), ("id", 3, "cust_id"), ("mail", 1, "Email"), ("mail", 2, "ContactEmail"))


@query("SELECT * FROM " + values("grp, canonical", ("id", "cust_id"), ("mail", "ContactEmail")))
def canonical_name(spark, d):
    return M.canonical_name(rows(spark, "grp string, place int, name string", *_NAMES))


_MAPS = (("date", "order_date", 0.75), ("date", "ship_date", 0.72), ("date", "created", 0.5), ("name", "customer_name", 0.9), ("name", "product_name", 0.6), ("status", "status", 0.65), ("status", "state", 0.64))
_MV = values("source_field, target_field, confidence", *_MAPS)
_AMB = f"""r AS (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS nxt FROM {_MV} WINDOW w AS (PARTITION BY source_field ORDER BY confidence DESC, target_field)),
 g AS (SELECT source_field, max(CASE WHEN place = 1 THEN confidence - nxt END) AS gap FROM r GROUP BY 1), a AS (SELECT r.*, gap FROM r JOIN g USING (source_field) WHERE gap < 0.1 AND place <= 3)"""


@query(f"WITH {_AMB} SELECT source_field, target_field, place::INTEGER AS place, round(1 - gap, 6)::DOUBLE AS ambiguity FROM a")
def ambiguity_gap(spark, d):
    return M.ambiguities(rows(spark, "source_field string, target_field string, confidence double", *_MAPS)).select("source_field", "target_field", "place", r("ambiguity"))


@query(f"WITH {_AMB} SELECT source_field, coalesce(max(CASE WHEN lower(target_field) = lower(source_field) THEN target_field END), max(CASE WHEN place = 1 AND confidence > 0.7 THEN target_field END)) AS resolution FROM a GROUP BY 1")
def ambiguity_resolution(spark, d):
    return M.resolved(M.ambiguities(rows(spark, "source_field string, target_field string, confidence double", *_MAPS)))


_CONF = (("cust_id", "customer_identifier", 0.9), ("name", "name", 0.7), ("amt", "total_amount", 0.8), ("x", "y", 0.5))


@query("SELECT * FROM " + values("source_field, target_field, confidence", ("cust_id", "customer_identifier", 0.88), ("name", "name", 0.94), ("amt", "total_amount", 0.76), ("x", "y", 0.6)).replace("0.88)", "0.88::DOUBLE)").replace("0.94)", "0.94::DOUBLE)").replace("0.76)", "0.76::DOUBLE)").replace("0.6)", "0.6::DOUBLE)"))
def mapping_confidence(spark, d):
    x = rows(spark, "source_field string, target_field string, t double", *_CONF)
    return x.select("source_field", "target_field", r(M.mapping_confidence(F.col("source_field"), F.col("target_field"), F.col("t")), "confidence"))


def _part_keys():
    return E.blocking_keys({"p_name": F.col("p_name"), "p_brand": F.col("p_brand")}, {"p_size": F.col("p_size")})


def _part_blocks(spark, d):
    return E.keyed(read_table(spark, d, "part"), "p_partkey", _part_keys())


@query("""WITH b AS (SELECT p_partkey AS id, unnest(list_distinct(['n:' || left(lower(p_name), 3), 'b:' || left(lower(p_brand), 3), 'both:' || left(lower(p_name), 3) || left(lower(p_brand), 3)])) AS k FROM part),
 s AS (SELECT k, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS blocks, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size, sum(n * (n - 1) // 2)::BIGINT AS candidate_pairs FROM s""")
def block_stats(spark, d):
    p = read_table(spark, d, "part")
    keys = E.blocking_keys({"p_label": F.col("p_name"), "p_brand": F.col("p_brand")})
    return E.block_summary(E.keyed(p, "p_partkey", keys), 1000).select("blocks", "smallest", "largest", r("mean_size"), "candidate_pairs")


@query("SELECT DISTINCT a.p_partkey AS id1, b.p_partkey AS id2 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def candidate_pairs(spark, d):
    p = read_table(spark, d, "part")
    return E.candidate_pairs(E.keyed(p, "p_partkey", F.array(F.concat_ws("|", "p_name", "p_brand", "p_type", "p_size"))))


@query()
def candidate_class_pairs(spark, d):
    """The pairs of all surveyed keys, which candidate_pairs cuts to equal records: classes of equal keys and their pairs."""
    p = read_table(spark, d, "part")
    return E.class_pairs(p, "p_partkey", _part_keys())


def _name_pairs(spark, d):
    n = read_table(spark, d, "part").select("p_name").distinct()
    k = lambda side: n.select(F.col("p_name").alias(side), F.substring("p_name", 1, 2).alias("k"))
    return k("a").join(k("b"), "k").where("a < b").select("a", "b")


def _all_name_pairs(spark, d):
    """Every two distinct names, formed in parts."""
    n = read_table(spark, d, "part").select(F.col("p_name").alias("id"), F.lit("all").alias("block")).where("id is not null").distinct()
    return E.salted_pairs(n).toDF("a", "b")


_ANP = "(SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name)"
_NP = "(SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON left(a.p_name, 2) = left(b.p_name, 2) AND a.p_name < b.p_name)"


@query(f"SELECT a, b, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6)::DOUBLE AS score FROM {_NP}")
def levenshtein_pairs(spark, d):
    return _name_pairs(spark, d).select("a", "b", r(S.levenshtein(F.col("a"), F.col("b")), "score"))


@query()
def jaro_winkler_pairs(spark, d):
    return _all_name_pairs(spark, d).select("a", "b", r(S.jaro_winkler(F.col("a"), F.col("b")), "score"))


@query(f"SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6)::DOUBLE AS score FROM (SELECT a, b, list_distinct(string_split_regex(lower(a), '\\s+')) AS x, list_distinct(string_split_regex(lower(b), '\\s+')) AS y FROM {_NP})")
def token_jaccard_pairs(spark, d):
    return _name_pairs(spark, d).select("a", "b", r(S.token_jaccard(F.col("a"), F.col("b")), "score"))


@query(f"SELECT a, b, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6)::DOUBLE AS score FROM {_ANP}")
def levenshtein_all_pairs(spark, d):
    """As levenshtein_pairs, whose SQL takes names of the same first two letters only, over all pairs of names."""
    return _all_name_pairs(spark, d).select("a", "b", r(S.levenshtein(F.col("a"), F.col("b")), "score"))


@query(f"SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6)::DOUBLE AS score FROM (SELECT a, b, list_distinct(string_split_regex(lower(a), '\\s+')) AS x, list_distinct(string_split_regex(lower(b), '\\s+')) AS y FROM {_ANP})")
def token_jaccard_all_pairs(spark, d):
    """As token_jaccard_pairs, whose SQL takes names of the same first two letters only, over all pairs of names."""
    return _all_name_pairs(spark, d).select("a", "b", r(S.token_jaccard(F.col("a"), F.col("b")), "score"))


_PH = "regexp_replace(translate(regexp_replace(upper(substr(p_name, 2)), '[^A-Z]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '', 'g')"
for _digit in "123456":
    _PH = f"regexp_replace({_PH}, '{_digit}+', '{_digit}', 'g')"


@query(f"SELECT DISTINCT p_name, rpad(left(upper(left(p_name, 1)) || {_PH}, 4), 4, '0') AS code FROM part")
def phonetic_codes(spark, d):
    return read_table(spark, d, "part").select("p_name", S.phonetic_code(F.col("p_name")).alias("code")).distinct()


@query("""WITH p AS (SELECT lag(o_orderkey) OVER w AS id1, o_orderkey AS id2, lag(o_totalprice) OVER w AS x, o_totalprice AS y, abs(date_diff('day', lag(o_orderdate) OVER w, o_orderdate)) AS g FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
 SELECT id1, id2, round(CASE WHEN x = y THEN 1.0 WHEN abs(x - y) / greatest(abs(x), abs(y)) <= 0.01 THEN 1 - abs(x - y) / greatest(abs(x), abs(y)) ELSE 0.0 END, 6)::DOUBLE AS price_score, round(CASE WHEN g <= 30 THEN 1 - g / 30 ELSE 0.0 END, 6)::DOUBLE AS date_score FROM p WHERE id1 IS NOT NULL""")
def numeric_date_similarity(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read_table(spark, d, "orders").select(F.lag("o_orderkey").over(w).alias("id1"), F.col("o_orderkey").alias("id2"), F.lag("o_totalprice").over(w).alias("x"), F.col("o_totalprice").alias("y"), F.lag("o_orderdate").over(w).alias("dx"), F.col("o_orderdate").alias("dy"))
    return o.where("id1 is not null").select("id1", "id2", r(S.numeric(F.col("x"), F.col("y")), "price_score"), r(S.dates(F.col("dx"), F.col("dy")), "date_score"))


@query("""WITH p AS (SELECT a.o_orderkey AS id1, b.o_orderkey AS id2, a.o_totalprice AS x, b.o_totalprice AS y, abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) AS g FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey),
 s AS (SELECT id1, id2, round(CASE WHEN x = y THEN 1.0 WHEN abs(x - y) / greatest(abs(x), abs(y)) <= 0.01 THEN 1 - abs(x - y) / greatest(abs(x), abs(y)) ELSE 0.0 END, 6)::DOUBLE AS price_score, round(CASE WHEN g <= 30 THEN 1 - g / 30 ELSE 0.0 END, 6)::DOUBLE AS date_score FROM p) SELECT * FROM s WHERE price_score > 0 OR date_score > 0""")
def numeric_date_pairs(spark, d):
    """All pairs of a customer's orders with a score above 0, not the consecutive ones only; pairs of two zeros are not formed."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    price = F.col("o_totalprice").cast("double")
    # prices within 1 % lie within 0.01006 of each other by logarithm, so in one bucket or in neighbours; 0 equals 0 only
    log_price = F.when(price == 0, F.lit(0)).otherwise(F.floor(F.ln(F.abs(price)) / 0.0102)).cast("bigint")
    sides = F.array(F.struct(F.lit("d").alias("kind"), F.floor(day / 30).cast("bigint").alias("at")), F.struct(F.when(price == 0, "z").otherwise("p").alias("kind"), log_price.alias("at")))
    keyed = o.withColumn("s", F.explode(sides)).select("*", "s.kind", "s.at").drop("s")
    a = keyed.toDF("k", "id1", "x", "dx", "kind", "at")
    b = keyed.withColumn("at", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))).toDF("k", "id2", "y", "dy", "kind", "at")
    scored = a.join(b, ["k", "kind", "at"]).where("id1 < id2").select("id1", "id2", "kind", r(S.numeric(F.col("x"), F.col("y")), "price_score"), r(S.dates(F.col("dx"), F.col("dy")), "date_score"))
    # a pair that both ways find comes from the way by date
    return scored.where((F.col("kind") == "d") & (F.col("date_score") > 0) | (F.col("kind") != "d") & (F.col("price_score") > 0) & (F.col("date_score") == 0)).drop("kind")


_ENT = (("a", "John Smith", "12 Main St", "5551234", "x@y.z", "1"), ("b", "Jon Smith", "12 Main St", "5551234", "x@y.z", "1"), ("c", "Mary Poe", "9 Low Rd", "5559999", "m@p.q", "2"))


@query("SELECT * FROM " + values("id1, id2, score, match_type", ("a", "b", 0.97, "EXACT"), ("a", "c", 0.0, "NO_MATCH"), ("b", "c", 0.0, "NO_MATCH")).replace("0.97,", "0.97::DOUBLE,").replace("0.0,", "0.0::DOUBLE,"))
def match_score(spark, d):
    e = rows(spark, "id string, name string, address string, phone string, email string, key string", *_ENT)
    x, y = e.toDF("id1", "n1", "a1", "p1", "e1", "k1"), e.toDF("id2", "n2", "a2", "p2", "e2", "k2")
    f = {"name": S.levenshtein(F.col("n1"), F.col("n2")), "address": S.token_jaccard(F.col("a1"), F.col("a2")), "phone": S.exact(F.col("p1"), F.col("p2")), "email": S.exact(F.col("e1"), F.col("e2")), "id": S.exact(F.col("k1"), F.col("k2"))}
    f["name"] = F.when(f["name"] < 0.5, 0.0).otherwise(f["name"])
    p = x.join(y, F.col("id1") < F.col("id2")).withColumn("score", r(E.match_score(f), "score"))
    return p.select("id1", "id2", "score", E.match_type(F.col("score")).alias("match_type"))


_PAIRED = (("p1", "name", True, True), ("p1", "age", True, True), ("p2", "name", True, True), ("p2", "age", False, True), ("p3", "name", True, False), ("p3", "age", False, False), ("p4", "name", False, False), ("p4", "age", True, False))


@query("SELECT * FROM " + values("pair, weight, match_type", ("p1", 0.693147, "PROBABILISTIC"), ("p2", 0.693147, "PROBABILISTIC"), ("p3", 0.693147, "PROBABILISTIC"), ("p4", 0.0, "NO_MATCH")).replace("0.693147,", "0.693147::DOUBLE,").replace("0.0,", "0.0::DOUBLE,"))
def fellegi_sunter(spark, d):
    p = rows(spark, "pair string, attribute string, agree boolean, is_match boolean", *_PAIRED)
    return E.linkage_weights(p, E.agreement_rates(p)).select("pair", r("weight"), "match_type")


@query("""WITH p AS (SELECT c_custkey % 50 AS pair, c_nationkey = 7 AS agree, c_mktsegment = 'BUILDING' AS is_match FROM customer)
 SELECT 'nation' AS attribute, round(coalesce(count(*) FILTER (WHERE agree AND is_match) / nullif(count(*) FILTER (WHERE is_match), 0), 0.9), 6)::DOUBLE AS m, round(coalesce(count(*) FILTER (WHERE agree AND NOT is_match) / nullif(count(*) FILTER (WHERE NOT is_match), 0), 0.1), 6)::DOUBLE AS u FROM p""")
def agreement_rates(spark, d):
    p = read_table(spark, d, "customer").select(F.lit("nation").alias("attribute"), (F.col("c_nationkey") == 7).alias("agree"), (F.col("c_mktsegment") == "BUILDING").alias("is_match"))
    return E.agreement_rates(p).select("attribute", r("m"), r("u"))


def _part_edges(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    first = p.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("a"))
    same = p.join(first, ["p_name", "p_size"]).select("a", F.col("p_partkey").alias("b")).where("a <> b")
    by_brand = read_table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b")).where("a <> b").select("a", "b")
    return same.unionByName(by_brand)


def _part_components(spark, d):
    return E.components(read_table(spark, d, "part").select(F.col("p_partkey").alias("id")), _part_edges(spark, d))


_COMP = """e AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN (SELECT p_name, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL) y USING (p_name, p_size)
  UNION SELECT min(p_partkey), max(p_partkey) FROM part GROUP BY p_brand, p_type), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 walk(id, at) USING KEY (id) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT w.id, min(v.at) FROM walk w JOIN b ON b.a = w.id JOIN recurring.walk v ON v.id = b.b WHERE v.at < w.at GROUP BY w.id)"""


@query()
def connected_components(spark, d):
    c = _part_components(spark, d)
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query()
def golden_records(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    return E.golden_records(p, _part_components(spark, d), ["p_name", "p_brand", "p_type"])


@query("""WITH f AS (SELECT p_partkey AS id, p_name AS f, p_brand AS t FROM part), k AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM f GROUP BY f, t))::BIGINT AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM f GROUP BY f))::BIGINT AS nf, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM f GROUP BY t))::BIGINT AS nt)
 SELECT tp, nf - tp AS fp, nt - tp AS fn, round(tp / nf, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (nf + nt), 6) AS f1 FROM k""")
def pairwise_f1(spark, d):
    p = read_table(spark, d, "part")
    q = E.pairwise_quality(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("cluster")), p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")))
    return q.select("tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


_VAL = (("customer_id", "customer_id", 0.7), ("email", "email_address", 0.95), ("qty", "amount", 0.4), ("dt", "date", 0.75), ("x", "y", 0.3), ("name", "full_name", 0.82), ("state", "status", 0.61))


@query("SELECT level, decision, count(*) AS n FROM (SELECT CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level, CASE WHEN s = t OR confidence > 0.9 THEN 'approved' WHEN confidence < 0.5 THEN 'needs_review' ELSE 'pending' END AS decision FROM " + values("s, t, confidence", *_VAL) + ") GROUP BY ALL")
def validation_buckets(spark, d):
    x = rows(spark, "s string, t string, confidence double", *_VAL)
    x = x.select(V.confidence_level(F.col("confidence")).alias("level"), V.batch_decision(F.col("s"), F.col("t"), F.col("confidence")).alias("decision"))
    return x.groupBy("level", "decision").agg(F.count(F.lit(1)).alias("n"))


_LOG = "SELECT event_id, ts AS event_at, user_id AS mapping_id, 'f' || (user_id % 20) AS source_field, 't' || (user_id % 7) AS target_field, CASE event_type WHEN 'purchase' THEN 'corrected' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'pending' ELSE 'approved' END AS status FROM events"


def _log(spark, d):
    e = read_table(spark, d, "events")
    s = F.when(F.col("event_type") == "purchase", "corrected").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "pending").otherwise("approved")
    return e.select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("mapping_id"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("source_field"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("target_field"), s.alias("status"))


@query(f"SELECT source_field, target_field, status, count(*) AS n FROM ({_LOG}) GROUP BY ALL")
def feedback_counts(spark, d):
    return V.feedback_counts(_log(spark, d))


@query(f"""WITH c AS (SELECT source_field, target_field, status, count(*) AS n FROM ({_LOG}) WHERE status IN ('corrected', 'approved') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source_field ORDER BY CASE WHEN status = 'corrected' THEN 0 ELSE 1 END, n DESC, target_field) AS place FROM c)
 SELECT source_field, target_field AS suggestion, round(CASE WHEN status = 'corrected' THEN least(0.9, 0.6 + 0.1 * n) ELSE least(0.85, 0.5 + 0.1 * n) END, 6)::DOUBLE AS confidence FROM k WHERE place = 1""")
def feedback_suggestions(spark, d):
    return V.suggestions(V.feedback_counts(_log(spark, d))).withColumn("confidence", r("confidence"))


@query("SELECT event_type AS pair, round(avg((value > 50)::INT), 6) AS weight, count(*) AS n FROM events GROUP BY 1")
def feedback_accuracy(spark, d):
    return V.retrained(read_table(spark, d, "events").select(F.col("event_type").alias("pair"), (F.col("value") > 50).alias("correct"))).withColumn("weight", r("weight"))


@query(f"WITH l AS (SELECT mapping_id, arg_max(status, row(event_at, event_id)) AS status FROM ({_LOG}) GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'pending') AS reviewed, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'corrected') AS corrected, round(100.0 * count(*) FILTER (WHERE status <> 'pending') / count(*), 6)::DOUBLE AS percent FROM l")
def validation_progress(spark, d):
    return V.progress(V.latest_status(_log(spark, d))).withColumn("percent", r("percent"))


@query(f"WITH l AS (SELECT mapping_id, arg_max(status, row(event_at, event_id)) AS status FROM ({_LOG}) GROUP BY 1) SELECT mapping_id FROM l WHERE status = 'pending' ORDER BY mapping_id LIMIT 5")
def next_for_review(spark, d):
    x = V.latest_status(_log(spark, d)).withColumn("confidence", F.lit(0.5))
    return V.next_for_review(x, 5).select("mapping_id")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, round(avg(value), 6) AS mean_value, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS errors, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM events GROUP BY 1")
def hourly_metrics(spark, d):
    e = F.when(F.col("event_type") == "error", 1).otherwise(0)
    g = read_table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return g.agg(r(F.avg("value"), "mean_value"), F.count(F.lit(1)).alias("n"), F.sum(e).alias("errors"), r(F.avg(e), "error_rate"))


@query("SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily_evolution(spark, d):
    return read_table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1 HAVING count(*) > 5")
def alert_last_24h(spark, d):
    e = read_table(spark, d, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    return e.join(last, F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("SELECT event_type, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark, d):
    return Q.percentiles(read_table(spark, d, "events"), "event_type", "value").withColumns({k: r(k) for k in ("mean_value", "p50", "p95", "p99")})


_DAILY = "(SELECT event_type, ts::DATE AS day, sum(value) AS total FROM events GROUP BY ALL)"


def _daily(spark, d):
    return read_table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))


@query(f"""WITH w AS (SELECT *, avg(total) OVER x AS m, stddev_pop(total) OVER x AS s, count(*) OVER x AS n FROM {_DAILY} WINDOW x AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
 SELECT event_type, day, round((total - m) / s, 4) AS z FROM w WHERE n = 7 AND s > 0 AND abs((total - m) / s) > 2""")
def cost_anomaly(spark, d):
    return Q.anomalies(_daily(spark, d), "event_type", "day", "total").select("event_type", "day", r("z", digits=4))


@query("WITH t AS (SELECT ts::DATE AS day, sum(value) AS total FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM t), f AS (SELECT avg(total) FILTER (WHERE i <= 7) AS a, avg(total) FILTER (WHERE i > n - 7) AS b FROM k) SELECT round(a, 4) AS first_mean, round(b, 4) AS last_mean, round(100 * (b - a) / a, 4) AS change_percent FROM f")
def cost_trend(spark, d):
    t = read_table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return Q.trend(t, "day", "total").select(r("first_mean", digits=4), r("last_mean", digits=4), r("change_percent", digits=4))


@query(f"SELECT event_type, day, CASE WHEN total > 4000 THEN 'critical' WHEN total > 2000 THEN 'warning' ELSE 'ok' END AS level FROM {_DAILY}")
def threshold_alerts(spark, d):
    return _daily(spark, d).select("event_type", "day", Q.threshold_level(F.col("total"), F.lit(2000), F.lit(4000)).alias("level"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(100 * sum(value) / (SELECT sum(value) FROM events), 6) AS share, CASE WHEN max(value) > 80 THEN 'cpu' ELSE 'network' END AS bottleneck FROM events GROUP BY 1")
def op_time_breakdown(spark, d):
    s = Q.shares(read_table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "calls", r("total", digits=4), r("share"), Q.bottleneck(F.lit(0), F.col("max_value"), F.lit(0)).alias("bottleneck"))


@query("SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, round(coalesce(length(text), 0) / 4 / 1000, 6)::DOUBLE AS kilo_tokens FROM documents")
def prompt_volume(spark, d):
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return read_table(spark, d, "documents").select("doc_id", n.alias("chars"), r(n / 4 / 1000, "kilo_tokens"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::BIGINT AS min_value, max({c})::BIGINT AS max_value, CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS suggested FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def dtype_suggestions(spark, d):
    return P.narrowest_types(read_table(spark, d, "lineitem"))


@query("SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY 1")
def chunk_ids(spark, d):
    return Q.chunked(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery_semi(spark, d):
    c = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return read_table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


_SHIFT = "SELECT c_custkey + 100 AS c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer"


def _shifted(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c, c.withColumn("c_custkey", F.col("c_custkey") + 100).withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query(f"SELECT * FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_SHIFT})) UNION ALL {_SHIFT})")
def merge_upsert(spark, d):
    return L.upsert(*_shifted(spark, d), "c_custkey")


@query(f"""WITH n AS ({_SHIFT}), o AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer) SELECT 'insert' AS change_type, count(*) AS n FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)
 UNION ALL SELECT 'delete', count(*) FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT k, count(*) FROM o JOIN n USING (c_custkey), (VALUES ('update_preimage'), ('update_postimage')) AS v(k) WHERE o.c_name <> n.c_name OR o.c_acctbal <> n.c_acctbal GROUP BY 1""")
def cdc_diff(spark, d):
    return L.changes(*_shifted(spark, d), "c_custkey").groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query(_SHIFT)
def cdc_apply(spark, d):
    old, new = _shifted(spark, d)
    log = L.changes(old, new, "c_custkey").withColumn("version", F.lit(1))
    return L.applied(old, log, "c_custkey", "version")


@query("""WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), c AS (SELECT * FROM b WHERE prev IS NULL OR prev <> event_type)
 SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def scd2_history(spark, d):
    return L.history(read_table(spark, d, "events").select("user_id", "ts", "event_type", "event_id"), "user_id", "ts", "event_type", "event_id").drop("event")


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1")
def json_rescue(spark, d):
    return L.rescued(read_table(spark, d, "events"), "props", "$.k").groupBy(F.col("rescued").try_cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    w = W.windowed(read_table(spark, d, "events"), "ts", "value", "1 day", by=["event_type"])
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r("mean_value"))


@query("SELECT event_type, max(ts) AS watermark FROM events GROUP BY 1")
def watermark_max(spark, d):
    return W.watermarks(read_table(spark, d, "events"), "event_type", "ts")


@query("SELECT count(*) AS records, count(*) * 6 AS field_values FROM events")
def snapshot_counts(spark, d):
    e = read_table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) * len(e.columns)).alias("field_values"))


@query()
def ema_confidence(spark, d):
    return V.moving_average(read_table(spark, d, "events"), "event_type", ["ts", "event_id"], F.col("value") / 100).withColumn("ema", r("ema"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies, length(arg_min(text, doc_id))::INTEGER AS chars FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(text, ' '))")
def dedup_text(spark, d):
    return Q.repeated_texts(read_table(spark, d, "documents"), "doc_id", "text").select("first_id", "copies", F.length("first_text").alias("chars"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, d):
    return read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query()
def approx_distinct(spark, d):
    return read_table(spark, d, "events").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query()
def fuzzy_map_udf(spark, d):
    h = _headers(spark)
    c = F.col("header")
    return h.select(c.alias("original"), N.normalize_name(c).alias("canonical"), N.semantic_type(c, "v2").alias("semantic"), N.name_tokens(c).alias("aliases"))


@query("SELECT ts::DATE AS day, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def change_columns_set(spark, d):
    return read_table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT * FROM " + values("name, display", ("customer_id", "Customer Id"), ("total_amount", "Total Amount"), ("status", "Status")))
def display_names(spark, d):
    return rows(spark, "name string", ("customer_id",), ("total_amount",), ("status",)).select("name", N.display_name(F.col("name")).alias("display"))


@query("SELECT confidence::DOUBLE AS confidence, count(*) AS n FROM " + values("s, t, confidence", *_VAL) + " GROUP BY 1")
def confidence_histogram(spark, d):
    return rows(spark, "s string, t string, confidence double", *_VAL).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, lower(left(p_name, 3)) || '_' || lower(left(p_brand, 3)) AS block, lower(trim(p_name)) AS n, lower(trim(p_brand)) AS b, p_size FROM part)
 SELECT p_partkey AS id, min(p_partkey) OVER w AS first_id, block, count(*) OVER w AS copies FROM p WINDOW w AS (PARTITION BY n, b, p_size)""")
def exact_match_classes(spark, d):
    """A row per record with the first of its class of equal records; the pairs of a class are not formed."""
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim("p_name")).alias("n"), F.lower(F.trim("p_brand")).alias("b"), "p_size", E.prefix_key([F.col("p_name"), F.col("p_brand")]).alias("block"))
    classes = p.groupBy("n", "b", "p_size").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return p.join(classes, ["n", "b", "p_size"]).select("id", "first_id", "block", "copies")


@query()
def er_pipeline(spark, d):
    """Links by name within the surveyed keys. The score sees names only, so records of one name are one class, and pairs are those of names."""
    p, blocks = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), _part_blocks(spark, d)
    names = p.where("p_name <> ''").groupBy("p_name").agg(F.min("id").alias("first"))
    named = p.join(names, "p_name").select("id", "first")
    pairs = E.salted_pairs(blocks.join(named, "id").select(F.col("first").alias("id"), "block").distinct())
    a, b = names.toDF("n1", "id1"), names.toDF("n2", "id2")
    scored = pairs.join(a, "id1").join(b, "id2").where(E.name_score(F.col("n1"), F.col("n2"), with_jaro=False) >= 0.7)
    same = named.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return E.components(p.select("id"), scored.select(F.col("id1").alias("a"), F.col("id2").alias("b")).unionByName(same))


@query("SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, typeof(any_value({c})) AS data_type FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
def schema_catalog(spark, d):
    return P.schema_facts(read_table(spark, d, "orders")).select("column_name", "type")


@query("SELECT m.t AS target_field, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (SELECT 'c_name' AS f, c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer) x JOIN (VALUES ('c_name', 'name'), ('c_mktsegment', 'segment')) AS m(f, t) ON x.f = m.f GROUP BY 1")
def approved_mapping_join(spark, d):
    u = P.unpivoted(read_table(spark, d, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])
    m = rows(spark, "column_name string, target_field string, status string", ("c_name", "name", "approved"), ("c_mktsegment", "segment", "approved"), ("c_nationkey", "nation", "rejected")).where("status = 'approved'")
    return u.join(F.broadcast(m), "column_name").groupBy("target_field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ordered_drivers(spark, d):
    j = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(r(F.sum("o_totalprice"), "total", 2)).orderBy(F.desc("total"), "n_name").limit(10)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1")
def sql_passthrough(spark, d):
    reg = Registry(spark)
    for t in ("orders", "customer"):
        read_table(spark, d, t).createOrReplaceTempView(f"{t}_v")
    return reg.query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_v JOIN customer_v ON o_custkey = c_custkey WHERE o_orderstatus = :s GROUP BY c_mktsegment", s="O")


@query("SELECT * FROM " + values("version, compatible", ("v2", True), ("v3", False)).replace("True", "TRUE").replace("False", "FALSE"))
def schema_compat(spark, d):
    x = rows(spark, "version string, old array<string>, new array<string>", ("v2", ["id", "value"], ["id", "value", "timestamp"]), ("v3", ["id", "value", "timestamp"], ["id", "timestamp"]))
    return x.select("version", W.backward_compatible(F.col("old"), F.col("new")).alias("compatible"))


@query("SELECT a.f AS field_a, b.f AS field_b, CASE WHEN a.f = b.f THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM (VALUES ('custkey'), ('name'), ('nationkey'), ('acctbal'), ('mktsegment')) AS a(f), (VALUES ('suppkey'), ('name'), ('nationkey'), ('acctbal')) AS b(f)")
def stream_similarity(spark, d):
    f = [("customer", c) for c in ("custkey", "name", "nationkey", "acctbal", "mktsegment")] + [("supplier", c) for c in ("suppkey", "name", "nationkey", "acctbal")]
    return W.cross_pairs(rows(spark, "source string, field string", *f)).select("field_a", "field_b", "similarity")


@query("SELECT * FROM " + values("pair, confidence", ("a", 0.5715), ("b", 0.57), ("c", 0.57)).replace("0.5715)", "0.5715::DOUBLE)").replace("0.57)", "0.57::DOUBLE)"))
def adjusted_confidence(spark, d):
    x = rows(spark, "pair string, base double, weight double", ("a", 0.6, 0.505), ("b", 0.6, None), ("c", 0.6, 0.5))
    return x.select("pair", r(V.adjusted(F.col("base"), F.col("weight")), "confidence"))


@query("SELECT 'event_type' AS field, count(*) AS n, count(*) - count(event_type) AS nulls FROM events UNION ALL SELECT 'props', count(*), count(*) - count(props) FROM events")
def stream_replay(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the source reads a folder, of which the table is the only file that the pattern takes
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d if not _is_folder(spark, path) else path)
    if _is_folder(spark, path):
        s = spark.readStream.schema(schema).parquet(path)
    return W.run_once(W.field_statistics(s, ["event_type", "props"]), "field_replay").select("field", "n", "nulls")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
