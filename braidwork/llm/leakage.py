"""Evaluation texts inside a training corpus: rare seeds, then Smith-Waterman alignment.

Successive words are found exactly, by the grams of that many words. Altered copies are found by seeds of two words that
are rarest among the items: with every third word altered a third of them is left. Candidates are aligned in windows of
the text, so no matrix grows with the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import cut, map_batches


@dataclass(frozen=True)
class LeakRules:
    """run: successive words that make a case. share: share of the item's words, in their order, that makes a case too.

    rare_in: a pair of successive words is a seed of an item if at most so many distinct items hold it; seeds: so many of
    an item's rarest pairs are seeds in any case, the whole of equals. hits: seeds that send a document to alignment.
    max_broadcast: up to so many rows (16 bytes each) of seeds or candidates are joined by broadcast, more by shuffle.
    """

    run: int = 13
    share: float = 0.62
    rare_in: int = 3
    seeds: int = 24
    hits: int = 3
    max_broadcast: int = 1_000_000


def plain_words(text: Column) -> Column:
    """Array of a text's words in lower case, without markup, punctuation, spacing and inserted marks."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"</?(?:a|b|i|u|em|strong|span|code|sub|sup|mark|font|small|tt)(?:\s[^<>]*)?>", "")
    t = F.regexp_replace(t, r"<[^<>]+>|&[a-z]{2,8};|&#\d{1,6};|\[\d{1,3}\]", " ")
    t = F.regexp_replace(t, r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{FE00}-\x{FE0F}'’‘`´*_~]", "")
    return F.filter(F.split(t, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words, by the words' hashes."""
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, n)))


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Longest run of successive words that both hold, and the words that the best local alignment matches.

    Smith-Waterman with 2 for a match and -1 for a mismatch or a gap, a row of the matrix at a time: within a row the
    gaps are settled by a running maximum.
    """
    m, n = len(item), len(doc)
    if not m or not n:
        return 0, 0
    score = np.zeros((m + 1, n + 1), dtype=np.int32)
    places = np.arange(n + 1, dtype=np.int32)
    diagonal, longest = np.zeros(n + 1, dtype=np.int32), 0
    for i in range(m):
        same = doc == item[i]
        nxt = np.zeros(n + 1, dtype=np.int32)
        nxt[1:] = np.where(same, diagonal[:-1] + 1, 0)
        diagonal, longest = nxt, max(longest, int(nxt.max()))
        row = np.maximum(score[i] - 1, 0)
        row[1:] = np.maximum(row[1:], score[i, :-1] + np.where(same, 2, -1))
        score[i + 1] = np.maximum.accumulate(row + places) - places
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    matched = 0
    while i and j and score[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (2 if same else -1):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return longest, matched


def longest_run(item: list[str], doc: list[str]) -> int:
    """Most successive words that both hold."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        places.setdefault(w, []).append(i)
    last: dict[int, int] = {}
    best = 0
    for w in doc:
        last = {i: last.get(i - 1, 0) + 1 for i in places.get(w, ())}
        if last:
            best = max(best, *last.values())
    return best


def common_in_order(item: list[str], doc: list[str]) -> int:
    """Length of the longest common subsequence: no alignment matches more words. A bit for each word of the item."""
    bits: dict[str, int] = {}
    for i, w in enumerate(item):
        bits[w] = bits.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in doc:
        m = bits.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def best_match(item: list[str], doc: list[str], least: int) -> tuple[int, int]:
    """Longest run, and words matched by the best local alignment, 0 if no alignment can match least of them.

    An alignment of positive score spans less than three times the item in the text; windows of six times the item that
    overlap by half hold each of them.
    """
    m = len(item)
    run, matched = longest_run(item, doc), 0
    own = set(item)
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    for at in range(0, max(1, len(doc) - 3 * m), 3 * m):
        part = doc[at : at + 6 * m]
        if sum(w in own for w in part) >= least and common_in_order(item, part) >= least:
            matched = max(matched, align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in part]))[1])
    return run, matched


def leaked_items(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, item_id, run, matched, item_words: each document and item of which the document holds rules.run successive words, or rules.share of the words in order.

    Runs are found by equal grams of their length, however common their words are; altered copies by their rarest pairs
    of words. matched is 0 where less than the share can be in order. Items of fewer words than rules.run count if they
    stand wholly. Items of one text are searched once and come out each. Null, empty and very short texts have no case.
    Repeated rows come out once; empty tables give no rows; extra columns are ignored. Whole texts are aligned.
    """
    spark = docs.sparkSession
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    every = items.where("item_text is not null").select("item_id", plain_words(F.col("item_text")).alias("item_words")).where(F.size("item_words") > 0).dropDuplicates(["item_id"])
    every = cut(every.withColumn("it", F.xxhash64("item_words")))
    it = every.select("it", "item_words").dropDuplicates(["it"]).select("it", "item_words", F.size("item_words").alias("m"))
    lengths = sorted(r[0] for r in it.select(F.least("m", F.lit(rules.run))).distinct().collect())  # rules.run values at most
    whole = None
    for n in lengths:
        g = it.where(F.least("m", F.lit(rules.run)) == n).select("it", F.explode(_grams(hashed("item_words"), n)).alias("gram"))
        whole = g if whole is None else whole.unionByName(g)
    if whole is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, run int, matched int, item_words int")
    two = it.where(F.col("m") >= rules.run).select("it", F.explode(F.array_distinct(_grams(hashed("item_words"), 2))).alias("gram"))
    two = two.join(two.groupBy("gram").agg(F.count(F.lit(1)).alias("held")), "gram")
    # an item's own pairs only: as many as it has words
    two = two.withColumn("rank", F.rank().over(Window.partitionBy("it").orderBy("held"))).where((F.col("held") <= rules.rare_in) | (F.col("rank") <= rules.seeds))
    seeds = cut(whole.distinct().select("gram", "it", F.lit(True).alias("whole")).unionByName(two.select("gram", "it", F.lit(False).alias("whole"))))
    if seeds.count() <= rules.max_broadcast:
        seeds = F.broadcast(seeds)
    words = docs.where("text is not null").select("doc_id", hashed(plain_words(F.col("text"))).alias("h"))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.concat(*[_grams(F.col("h"), n) for n in sorted({2, *lengths})]))).alias("gram"))
    hits = grams.join(seeds, "gram").groupBy("doc_id", "it").agg(F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n"))
    pairs = cut(hits.where(F.col("whole") | (F.col("n") >= rules.hits)).groupBy("doc_id").agg(F.collect_set("it").alias("its")))  # items are few, whatever the corpus
    near = F.broadcast(pairs) if pairs.count() <= rules.max_broadcast else pairs
    # only documents with a candidate are cut into words again
    told = docs.where("text is not null").select("doc_id", "text").join(near, "doc_id").select("doc_id", plain_words(F.col("text")).alias("doc_words"), F.explode("its").alias("it"))
    told = told.join(F.broadcast(it) if it.count() <= rules.max_broadcast else it, "it")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, dw, iw in zip(b["doc_id"], b["it"], b["doc_words"], b["item_words"]):
                longest, matched = best_match(list(iw), list(dw), math.ceil(rules.share * len(iw)))
                out.append((d, i, longest, matched, len(iw)))
            yield pd.DataFrame(out, columns=["doc_id", "it", "run", "matched", "m"])

    scored = told.select("doc_id", "it", "doc_words", "item_words").transform(map_batches, run, "doc_id bigint, it bigint, run int, matched int, m int")
    case = (F.col("run") >= F.least(F.lit(rules.run), F.col("m"))) | ((F.col("matched") >= rules.share * F.col("m")) & (F.col("m") >= rules.run))
    named = F.broadcast(every.select("it", "item_id")) if every.count() <= rules.max_broadcast else every.select("it", "item_id")
    return scored.where(case).join(named, "it").select("doc_id", "item_id", "run", "matched", F.col("m").alias("item_words")).dropDuplicates(["doc_id", "item_id"])
