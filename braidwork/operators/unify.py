"""Sources under one view: registry, canonical names, unions with type widening, and the SQL surface."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their canonical names (own to canonical). Two columns under one name are an error."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError(f"two columns would be named {sorted({c for c in out if out.count(c) > 1})}")
    return df.toDF(*out)


def widened(types: set[str], example: T.DataType) -> T.DataType:
    """The type of a united column: the same, double for unlike numbers, text for all else."""
    if len(types) == 1:
        return example
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return T.DoubleType() if all(t in numbers or t.startswith("decimal") for t in types) else T.StringType()


def united(sources: dict[str, DataFrame], tag: str = "_source") -> DataFrame:
    """UNION ALL of the sources by name, absent columns null, with the source's name; filters on it prune whole sources."""
    seen: dict[str, dict[str, T.DataType]] = {}
    for df in sources.values():
        for f in df.schema:
            seen.setdefault(f.name, {})[f.dataType.simpleString()] = f.dataType
    target = {c: widened(set(t), next(iter(t.values()))) for c, t in seen.items()}
    cast = [df.select(*[F.col(f"`{f.name}`").cast(target[f.name]).alias(f.name) for f in df.schema], F.lit(n).alias(tag)) for n, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


@dataclass
class Registry:
    """Named sources with their canonical names; views are bound in the order register, correct, bind."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    names: dict[str, dict[str, str]] = field(default_factory=dict)

    def register(self, source: str, df: DataFrame, names: dict[str, str] | None = None) -> None:
        self.frames[source], self.names[source] = df, dict(names or {})

    def correct(self, source: str, own: str, canonical: str) -> None:
        """A validated correction of one column's canonical name."""
        if own not in self.frames[source].columns:
            raise ValueError(f"{source} has no column {own}")
        self.names[source][own] = canonical

    def bind(self, view: str = "unified_data") -> DataFrame:
        out = united({s: renamed(df, self.names[s]) for s, df in self.frames.items()})
        for s, df in self.frames.items():
            renamed(df, self.names[s]).createOrReplaceTempView(s)
        out.createOrReplaceTempView(view)
        return out

    def query(self, text: str, strict: bool = True, **args: object) -> DataFrame:
        """Runs SQL over the views; with strict off an error gives an empty table."""
        try:
            return self.spark.sql(text, args=args or None)
        except Exception:
            if strict:
                raise
            return self.spark.createDataFrame([], T.StructType([]))

    def explain(self, text: str) -> str:
        return self.spark.sql(f"EXPLAIN EXTENDED {text}").first()[0]


def parsed_select(text: str) -> dict[str, object]:
    """Fields, tables, conditions, groups, order and limit of a simple SELECT, by keywords."""
    keys = ("select", "from", "where", "group by", "having", "order by", "limit")
    cut = re.compile(r"\b(" + "|".join(k.replace(" ", r"\s+") for k in keys) + r")\b", re.I | re.S)
    parts = cut.split(text.strip().rstrip(";"))
    got = {re.sub(r"\s+", " ", k.lower()): v.strip() for k, v in zip(parts[1::2], parts[2::2])}
    items = lambda k: [x.strip() for x in got[k].split(",")] if got.get(k) else []
    limit = got.get("limit", "")
    return {"fields": items("select"), "tables": items("from"), "conditions": [x.strip() for x in re.split(r"\band\b", got.get("where", ""), flags=re.I) if x.strip()], "group_by": items("group by"), "order_by": items("order by"), "limit": int(limit) if limit.isdigit() else None}


def rewritten(expression: str, names: dict[str, str]) -> str:
    """An expression with canonical names replaced by a source's own, whole words outside quotes only."""
    parts = re.split(r"('(?:[^']|'')*')", expression)
    return "".join(p if i % 2 else re.sub(r"\b\w+\b", lambda m: names.get(m.group(0), m.group(0)), p) for i, p in enumerate(parts))


def advice(text: str, seconds: float) -> list[str]:
    """Hints on a slow query."""
    if seconds < 0.1:
        return ["fast enough"]
    p = parsed_select(text)
    return [h for h, hit in (("name the columns instead of *", "*" in p["fields"]), ("add a WHERE clause", not p["conditions"]), ("add a LIMIT", p["limit"] is None)) if hit]


def sample_queries(view: str, meanings: dict[str, str]) -> list[str]:
    """Up to five queries over a view by its columns' meanings (column to semantic type)."""
    cols = list(meanings)
    first = lambda *kinds: next((c for c in cols if meanings[c] in kinds), None)
    out = [f"SELECT {', '.join(cols[:5])} FROM {view} LIMIT 10", f"SELECT COUNT(*) AS total FROM {view}"]
    if c := first("status", "category"):
        out.append(f"SELECT {c}, COUNT(*) AS uses FROM {view} GROUP BY {c}")
    if c := first("identifier"):
        out.append(f"SELECT * FROM {view} WHERE {c} IS NOT NULL LIMIT 5")
    if c := first("quantity", "monetary"):
        out.append(f"SELECT SUM({c}) AS total, AVG({c}) AS mean FROM {view}")
    return out


class Assistant:
    """Answers by rule where no language model is configured."""

    def to_sql(self, question: str, view: str, columns: list[str]) -> str:
        q = question.lower()
        named = [c for c in columns if c.lower() in q or c.lower().replace("_", " ") in q]
        if "how many" in q or "count" in q:
            by = re.search(r"\b(?:by|per) (\w+)", q)
            col = next((c for c in columns if by and c.lower() == by.group(1)), None)
            return f"SELECT {col}, COUNT(*) AS n FROM {view} GROUP BY {col}" if col else f"SELECT COUNT(*) AS n FROM {view}"
        if ("average" in q or "mean" in q) and named:
            return f"SELECT AVG({named[0]}) AS mean FROM {view}"
        if "total" in q and named:
            return f"SELECT SUM({named[0]}) AS total FROM {view}"
        return f"SELECT {', '.join(named) or '*'} FROM {view} LIMIT 10"
