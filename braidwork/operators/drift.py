"""Schemas that drift between files: edit scripts between successive schemas, and one table for all files.

A file's schema is a tree (nested names are cut at dots; a delimited file has one level). Between two successive files
of a channel, the constrained unordered tree edit distance is found by minimum-cost assignment of children, level by
level: deleting and adding a field cost 1 each, keeping a field under another name costs what its content differs, and
2 if the two names stand beside each other in any header of the feeds; another place among its siblings costs nothing.
A field that is left over under one parent and appears under another one is moved, if its content allows. The cheapest
script is the list of changes, and it compiles into projections.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.calendar import is_calendar_day, to_int
from braidwork.operators.rejects import RejectRules, feed_headers, loadable_lines
from braidwork.session import cut, map_batches

# Header keys (lower case, letters and digits only) that customer feeds use for one and the same field. They
# name the columns of the unified table; for the scripts they are a hint among others (DriftRules.hint).
CONCEPTS = {
    "customer_number": ("customerid", "custid", "clientnumber", "custnum", "customernumber", "customerno", "kundennr", "custkey", "clientref", "accountno", "clientid"),
    "customer_name": ("fullname", "customername", "name", "customerfullname", "displayname", "party", "clientname", "custname"),
    "email": ("emailaddress", "contactemail", "emailaddr", "email", "mail", "contactmail", "mailaddress"),
    "registered": ("registrationdate", "signupdate", "createdat", "regdt", "datecreated", "since", "joinedon", "signupday"),
    "status": ("accountstatus", "status", "active", "statusflag", "lifecycle", "state", "acctstate"),
    "country": ("country", "land", "ctry", "countrycode"),
    "phone": ("phone", "tel", "telephone", "phoneno"),
    "referrer": ("referrer", "origin", "referredby"),
    "segment": ("segment", "custsegment", "tier"),
    "credit_limit": ("creditlimit", "limitamt", "maxcredit"),
    "newsletter": ("newsletter", "optin", "mailingok"),
    "loyalty_points": ("loyaltypoints", "bonuspoints", "points"),
    "birth_year": ("birthyear", "yob", "yearofbirth"),
}
_CONCEPT_OF = {k: c for c, keys in CONCEPTS.items() for k in keys}
KINDS = ("integer", "decimal", "boolean", "date", "text")
_SLOTS = 16


@dataclass(frozen=True)
class DriftRules:
    """rename_below: a field is kept under another name only if that costs less (deleting and adding cost 2).

    hint: what CONCEPTS takes from the cost of two names of one meaning, or adds for two meanings; 0 leaves all to content.
    least_share: share of a column's non-empty values that must be of one kind for the column to be of it.
    """

    rename_below: float = 2.0
    hint: float = 0.6
    least_share: float = 0.5


def value_kind(v: Column) -> Column:
    """integer, decimal, boolean, date or text; null for an empty value."""
    iso, last = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[T ].*)?$"
    part = lambda p, i: to_int(F.regexp_extract(v, p, i))
    day = F.when(v.rlike(iso), is_calendar_day(part(iso, 1), part(iso, 2), part(iso, 3))).when(
        v.rlike(last), is_calendar_day(part(last, 3), part(last, 1), part(last, 2)) | is_calendar_day(part(last, 3), part(last, 2), part(last, 1))
    )
    return (
        F.when(v == "", None)
        .when(v.rlike(r"^[+-]?\d+$"), F.lit("integer"))
        .when(v.rlike(r"^[+-]?\d*[.]\d+$"), F.lit("decimal"))
        .when(F.lower(v).isin("true", "false"), F.lit("boolean"))
        .when(F.coalesce(day, F.lit(False)), F.lit("date"))
        .otherwise(F.lit("text"))
    )


def file_schemas(files: DataFrame, lines: DataFrame, rules: RejectRules = RejectRules()) -> DataFrame:
    """file_id and fields: an array, in the header's order, of name, key, n (non-empty values), one count per kind, at_signs, mean length, and a min-hash of the values.

    Only counts, sums and minima are kept per column, so the values themselves are folded before they are shuffled.
    """
    good = loadable_lines(files, lines, rules)
    cells = good.select("file_id", F.posexplode("values").alias("pos", "raw")).select("file_id", "pos", F.trim("raw").alias("v")).withColumn("kind", value_kind(F.col("v")))
    some = F.col("kind").isNotNull()
    sums = [F.count_if(F.col("kind") == k).cast("int").alias(f"n_{k}") for k in KINDS]
    sums += [F.count_if(some).cast("int").alias("n"), F.count_if(F.col("v").contains("@")).cast("int").alias("n_at"), F.sum(F.when(some, F.length("v"))).alias("chars")]
    sums += [F.min(F.when(some, F.xxhash64(F.lit(i), F.col("v")))).alias(f"h{i}") for i in range(_SLOTS)]
    facts = cells.groupBy("file_id", "pos").agg(*sums)
    fact = F.struct("pos", *[f"n_{k}" for k in KINDS], "n", "n_at", "chars", F.array(*[f"h{i}" for i in range(_SLOTS)]).alias("hashes"))
    by_file = facts.groupBy("file_id").agg(F.collect_list(fact).alias("facts"))  # a row per column of one header
    head = feed_headers(files, lines).select("file_id", "feed", "header", "header_keys")
    return head.join(by_file, "file_id", "left")


def preceding_files(files: DataFrame) -> DataFrame:
    """file_id, before: the file with the preceding file_seq of the channel.

    Mostly that is file_seq - 1, found by an equi-join that spreads even one channel's files over all tasks; only
    channels with gaps are put in order by a window. Of files with equal channel and file_seq the lowest file_id counts.
    """
    f = files.where("channel_id is not null and file_seq is not null").groupBy("channel_id", "file_seq").agg(F.min("file_id").alias("file_id"))
    nxt = f.select("channel_id", (F.col("file_seq") + 1).alias("file_seq"), F.col("file_id").alias("before"))
    paired = f.join(nxt, ["channel_id", "file_seq"], "left")
    first = f.groupBy("channel_id").agg(F.min("file_seq").alias("first"))
    open_ = paired.where("before is null").join(first, "channel_id").where("file_seq > first")
    gapped = f.join(open_.select("channel_id").distinct(), "channel_id", "left_semi")
    from pyspark.sql import Window

    ordered = gapped.select("file_id", F.lag("file_id").over(Window.partitionBy("channel_id").orderBy("file_seq")).alias("before"))
    closed = ordered.join(open_.select("file_id"), "file_id", "left_semi")
    return paired.where("before is not null").select("file_id", "before").unionByName(closed.where("before is not null"))


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, p, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[p[j] - 1] = j - 1
    return out


@dataclass
class Node:
    """A field of a schema: name as written, key without case, quotes and blanks, kind (None if no values tell), what its values look like, and nested fields."""

    name: str
    key: str
    kind: str | None = None
    facts: dict | None = None
    children: tuple = ()


def _keep_cost(a: Node, b: Node, rules: DriftRules, apart: frozenset = frozenset()) -> float:
    """Cost of taking b for a, children aside: 0 under the same key; else by content, and 2 or more for names that some header holds side by side (apart)."""
    if a.key == b.key:
        return 0.0
    if (_bare(a.name), _bare(b.name)) in apart:
        return 2.0
    ca, cb = _CONCEPT_OF.get(_bare(a.name)), _CONCEPT_OF.get(_bare(b.name))
    cost = 1.6 if not (ca and cb) else 1.6 - rules.hint if ca == cb else 1.6 + rules.hint
    if a.kind and b.kind:
        cost += -0.4 if a.kind == b.kind else 0.5
    fa, fb = a.facts, b.facts
    if fa and fb and fa["n"] and fb["n"]:
        same = sum(x == y for x, y in zip(fa["hashes"], fb["hashes"])) / _SLOTS
        at = abs(fa["n_at"] / fa["n"] - fb["n_at"] / fb["n"])
        la, lb = fa["chars"] / fa["n"], fb["chars"] / fb["n"]
        cost += 1.0 * at - 0.9 * same - 0.3 * (min(la, lb) / max(la, lb) if max(la, lb) else 1)
    ta, tb = set(_words(a.name)), set(_words(b.name))
    if ta & tb:
        cost -= 0.5 * len(ta & tb) / max(len(ta), len(tb))
    return max(cost, 0.05)


def _words(name: str) -> list[str]:
    import re

    return re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)


def _bare(name: str) -> str:
    """A name's letters and digits in lower case: what it may mean. The key keeps marks: another mark is another name."""
    return "".join(ch for ch in name.lower() if ch.isalnum())


def _key(name: str) -> str:
    return "".join(ch for ch in name.lower() if not ch.isspace() and ch not in "\"'`")


def _size(t: Node) -> int:
    return 1 + sum(map(_size, t.children))


def _leaves(t: Node, path: str = "") -> list[tuple[str, Node]]:
    own = f"{path}.{t.name}" if path else t.name
    return [x for c in t.children for x in _leaves(c, own)] if t.children else [(own, t)]


def _siblings(old: tuple[Node, ...], new: tuple[Node, ...], rules: DriftRules, apart: frozenset, po: str = "", pn: str = "") -> tuple[float, list[tuple]]:
    """Cost and steps (kind, old path, new path, old leaf, new leaf) between two lists of siblings; removed and added steps are leaves."""
    n, m = len(old), len(new)
    if not n and not m:
        return 0.0, []
    big = n + m
    sub: dict[tuple[int, int], list] = {}
    cost = [[0.0] * big for _ in range(big)]
    path = lambda p, t: f"{p}.{t.name}" if p else t.name
    for i in range(n):
        for j in range(m):
            c = _keep_cost(old[i], new[j], rules, apart)
            if c > 0 and (c >= rules.rename_below or bool(old[i].children) != bool(new[j].children)):
                cost[i][j] = float(_size(old[i]) + _size(new[j])) + 1
                continue
            more, sub[i, j] = _siblings(old[i].children, new[j].children, rules, apart, path(po, old[i]), path(pn, new[j]))
            cost[i][j] = c + more
        for j in range(m, big):
            cost[i][j] = float(_size(old[i]))
    for i in range(n, big):
        for j in range(m):
            cost[i][j] = float(_size(new[j]))
    out, total = [], 0.0
    for i, j in enumerate(assign(cost)):
        total += cost[i][j]
        if i < n and j < m and (i, j) in sub:
            a, b = old[i], new[j]
            if not a.children and not b.children:
                out.append(("kept" if a.key == b.key else "renamed", path(po, a), path(pn, b), a, b))
            out += sub[i, j]
        else:
            out += [("removed", x, "", t, None) for x, t in (_leaves(old[i], po) if i < n else [])]
            out += [("added", "", x, None, t) for x, t in (_leaves(new[j], pn) if j < m else [])]
    return total, out


def edit_script(old: tuple[Node, ...], new: tuple[Node, ...], rules: DriftRules = DriftRules(), apart: frozenset = frozenset()) -> tuple[float, list[tuple[str, str, str]]]:
    """Cost and script (kind of change, old path, new path) between two lists of sibling fields.

    Steps are those of leaves: kept, renamed, moved, retyped, added, removed; a field that is renamed or moved is listed
    as kept too. A field under a renamed parent keeps its place. Order does not count.
    """
    total, steps = _siblings(old, new, rules, apart)
    gone, come = [s for s in steps if s[0] == "removed"], [s for s in steps if s[0] == "added"]
    parent = lambda p: p.rpartition(".")[0]
    if any("." in s[1] for s in gone) or any("." in s[2] for s in come):
        size = len(gone) + len(come)
        cost = [[2.0 if i < len(gone) or j < len(come) else 0.0 for j in range(size)] for i in range(size)]
        for i, (_, x, _, a, _) in enumerate(gone):
            for j, (_, _, y, _, b) in enumerate(come):
                # another place and another name at once need content that both hold
                told = a.key == b.key or a.facts and b.facts and any(p == q and p is not None for p, q in zip(a.facts["hashes"], b.facts["hashes"]))
                c = _keep_cost(a, b, rules, apart) if told else 4.0
                cost[i][j] = c if parent(x) != parent(y) and c < rules.rename_below else 4.0
        for i, j in enumerate(assign(cost)):
            if i < len(gone) and j < len(come) and cost[i][j] < 2:
                steps = [s for s in steps if s is not gone[i] and s is not come[j]] + [("moved", gone[i][1], come[j][2], gone[i][3], come[j][4])]
                total += cost[i][j] - 2
    out = []
    for kind, x, y, a, b in steps:
        if kind not in ("kept", "added", "removed"):
            out.append((kind, x, y))
        if a and b:
            if a.kind and b.kind and a.kind != b.kind:
                out.append(("retyped", x, y))
            out.append(("kept", x, y))
        elif kind != "kept":
            out.append((kind, x, y))
    return total, out


def _tree(leaves: list[tuple[list[str], Node]]) -> tuple[Node, ...]:
    """Leaves with their paths as a tree; names that aren't nested stay as they are."""
    groups: dict[str, list] = {}
    for i, (path, leaf) in enumerate(leaves):
        groups.setdefault(_key(path[0]) if len(path) > 1 else f"\0{i}", []).append((path, leaf))
    out = []
    for g in groups.values():
        path, leaf = g[0]
        out.append(leaf if len(path) == 1 else Node(path[0], _key(path[0]), children=_tree([(p[1:], x) for p, x in g])))
    return tuple(out)


def _nodes(header, facts, rules: DriftRules) -> tuple[Node, ...]:
    """The fields of a header as a tree, cut at dots."""
    by = {int(f["pos"]): f for f in facts} if facts is not None else {}
    leaves, seen = [], set()
    for i, name in enumerate(header):
        f = by.get(i)
        kind = None
        if f is not None and f["n"]:
            k = max(KINDS, key=lambda k: f[f"n_{k}"])
            if k == "integer" and f["n_decimal"] and 2 * (f["n_integer"] + f["n_decimal"]) > f["n"]:
                k = "decimal" if 2 * f["n_decimal"] >= f["n_integer"] else k
            kind = k if f[f"n_{k}"] >= rules.least_share * f["n"] else "text"
        # an empty name, or one that stands twice, is told by its place
        path = name.split(".")
        if not all(p.strip() for p in path):
            path = [name]
        again = _key(name) in seen
        seen.add(_key(name))
        key = _key(path[-1]) or f"#{i}"
        leaves.append((path, Node(path[-1], f"{key}#{i}" if again else key, kind, f)))
    return _tree(leaves)


def names_apart(pairs: DataFrame) -> DataFrame:
    """file_id, apart: of the names that only one of two successive headers holds, the pairs (old, new) that some header of all files holds side by side."""
    bare = lambda c: F.transform(c, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))
    heads = pairs.select(F.array_sort(F.array_distinct(bare("header"))).alias("h")).unionByName(pairs.select(F.array_sort(F.array_distinct(bare("header0"))).alias("h"))).distinct()
    beside = heads.select(F.explode("h").alias("x"), "h").select("x", F.explode("h").alias("y")).where("x <> y").distinct()
    d = pairs.select("file_id", F.array_except(bare("header0"), bare("header")).alias("gone"), F.array_except(bare("header"), bare("header0")).alias("come"))
    d = d.select("file_id", F.explode("gone").alias("x"), "come").select("file_id", "x", F.explode("come").alias("y"))
    return d.join(beside, ["x", "y"]).groupBy("file_id").agg(F.collect_set(F.struct("x", "y")).alias("apart"))  # pairs of two headers


def schema_scripts(files: DataFrame, lines: DataFrame, rules: DriftRules = DriftRules(), rejects: RejectRules = RejectRules()) -> DataFrame:
    """file_id, before, change_kind, old_name, new_name: the edit script of each file against the preceding one of its channel, kept fields included."""
    schemas = cut(file_schemas(files, lines, rejects).select("file_id", "header", "facts"))
    pairs = preceding_files(files)
    pairs = pairs.join(schemas, "file_id").join(schemas.select(F.col("file_id").alias("before"), F.col("header").alias("header0"), F.col("facts").alias("facts0")), "before")
    pairs = pairs.join(names_apart(pairs), "file_id", "left")

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                old, new = _nodes(r.header0, r.facts0, rules), _nodes(r.header, r.facts, rules)
                apart = frozenset((x["x"], x["y"]) for x in r.apart) if r.apart is not None else frozenset()
                rows += [(r.file_id, r.before, *step) for step in edit_script(old, new, rules, apart)[1]]
            yield pd.DataFrame(rows, columns=["file_id", "before", "change_kind", "old_name", "new_name"])

    return pairs.select("file_id", "before", "header", "facts", "header0", "facts0", "apart").transform(map_batches, scripts, "file_id bigint, before bigint, change_kind string, old_name string, new_name string")


def schema_changes(files: DataFrame, lines: DataFrame, rules: DriftRules = DriftRules(), rejects: RejectRules = RejectRules()) -> DataFrame:
    """file_id, change_kind, field_name of every change of a file against the preceding one of its channel.

    Only names differing in more than case, quotes and blanks are renamed. Kinds are judged by the values of
    lines that load; a column without such values has no kind, so it isn't retyped. Files without header line, or
    without channel or number, have no case; empty tables give no rows; extra columns are ignored.
    """
    s = schema_scripts(files, lines, rules, rejects).where("change_kind <> 'kept'")
    # a moved field has the same content under another name, that of its new place
    return s.select("file_id", F.when(F.col("change_kind") == "moved", F.lit("renamed")).otherwise(F.col("change_kind")).alias("change_kind"), F.when(F.col("change_kind") == "removed", F.col("old_name")).otherwise(F.col("new_name")).alias("field_name"))


def unified_feed(files: DataFrame, lines: DataFrame, rules: DriftRules = DriftRules(), rejects: RejectRules = RejectRules()) -> DataFrame:
    """line_id, file_id, feed, the fields of CONCEPTS, and other fields as pairs of key and value: every line that loads, in one table.

    The scripts are compiled by following each field back to the first file in which its channel carried it; that
    origin's meaning names the target column. The chains are shortened by pointer doubling, so a channel of n files
    takes log n joins, each spread over all files.
    """
    heads = feed_headers(files, lines).select("file_id", F.posexplode("header").alias("pos", "name"), "header_keys")
    fields = heads.select("file_id", "pos", "name", F.element_at("header_keys", F.col("pos") + 1).alias("key"))
    kept = schema_scripts(files, lines, rules, rejects).where("change_kind = 'kept'").select("file_id", F.col("new_name").alias("name"), F.col("before").alias("to_file"), F.col("old_name").alias("to_name"))
    link = cut(fields.select("file_id", "name").distinct().join(kept, ["file_id", "name"], "left").select("file_id", "name", F.coalesce("to_file", "file_id").alias("to_file"), F.coalesce("to_name", "name").alias("to_name")))
    while True:
        hop = link.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("next_file"), F.col("to_name").alias("next_name"))
        longer = cut(link.join(hop, ["to_file", "to_name"], "left").select("file_id", "name", F.coalesce("next_file", "to_file").alias("to_file"), F.coalesce("next_name", "to_name").alias("to_name"), (F.coalesce("next_file", "to_file") != F.col("to_file")).alias("moved")))
        link = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    origin = fields.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("key").alias("origin_key")).dropDuplicates(["to_file", "to_name"])
    concept = F.create_map(*[x for k, c in _CONCEPT_OF.items() for x in (F.lit(k), F.lit(c))])
    target = fields.join(link, ["file_id", "name"]).join(origin, ["to_file", "to_name"]).select("file_id", "pos", F.coalesce(F.try_element_at(concept, F.col("key")), F.try_element_at(concept, F.col("origin_key")), F.col("origin_key")).alias("target"))
    plan = target.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "target"))).alias("plan"))
    rows = loadable_lines(files, lines, rejects).join(plan, "file_id")
    named = rows.withColumn("cells", F.transform("values", lambda v, i: F.struct(F.try_element_at("plan", i).alias("key"), v.alias("value"))))
    pick = lambda c: F.get(F.filter("cells", lambda x: x["key"] == c), F.lit(0))["value"]
    rest = F.filter("cells", lambda x: F.coalesce(~x["key"].isin(*CONCEPTS), F.lit(True)))
    return named.select("line_id", "file_id", "feed", *[pick(c).alias(c) for c in CONCEPTS], rest.alias("other"))
