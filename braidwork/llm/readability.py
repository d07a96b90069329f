"""Reading level of each document: gradient-boosted regression trees over length, vocabulary, syntax and cohesion.

A bounded sample of rated documents trains the trees on the driver; everything else (word statistics of the sample,
features, predictions) is computed on the executors over whole texts. Out-of-fold predictions, with folds by source,
calibrate the cut points between levels and tell how well unseen sources are graded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut, map_batches

# Frequent function words, by which English is told from the other languages of the corpus.
ENGLISH = frozenset("the of and to a in is that it for was on are with as be at by this had not but have from or which were one so when then only can we he she before after until has its an will no".split())
FOREIGN = frozenset("der die das und ist für nicht ein eine mit auf den im von wird dem sich le la les des est et un une dans pour que qui el los las una por con del se es en si ou au aux du il ne pas sur ya y su".split())
LINKS = frozenset("and but so because although while since therefore however hence thus moreover then also unless whereas provided notwithstanding consequently".split())
PRONOUNS = frozenset("i you he she it we they me him her us them my your his its our their this that these those".split())
SUBORDINATORS = frozenset("because although while since unless whereas whether which that when if until who whose whosoever what".split())

_TAG = re.compile(r"<[^<>]+>")
_CUT = re.compile(r"[.!?]+(?=\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouy]+")


@dataclass(frozen=True)
class LevelRules:
    """max_labels: bound of the rated sample (by hash of doc_id, lowest first). min_words: least words of a prose text.

    vocabulary: bound of the word table, most used first, and least rated documents a word must stand in.
    """

    max_labels: int = 6000
    min_words: int = 30
    vocabulary: int = 30000
    least_docs: int = 3
    rounds: int = 160
    depth: int = 4
    rate: float = 0.08
    least_leaf: int = 5
    folds: int = 5
    levels: tuple[int, int] = (1, 5)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case; tags are blanks, list marks and line ends cut."""
    plain = _TAG.sub("\n", text)
    return [w for s in _CUT.split(plain) if (w := [x.lower() for x in _WORD.findall(s)])]


def is_english_prose(sents: list[list[str]], min_words: int) -> bool:
    words = [w for s in sents for w in s]
    if len(words) < min_words:
        return False
    e, o = sum(w in ENGLISH for w in words), sum(w in FOREIGN for w in words)
    return e > o and e >= 0.08 * len(words)


def _quantiles(x: np.ndarray, qs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> list[float]:
    return list(np.quantile(x, qs)) if len(x) else [0.0] * len(qs)


def features(text: str, sents: list[list[str]], scores: dict[str, float]) -> list[float]:
    """Feature vector of a text. scores: mean level of the rated documents in which a word stands."""
    words = [w for s in sents for w in s]
    n = max(len(words), 1)
    lengths = np.array([len(w) for w in words]) if words else np.zeros(1)
    per = np.array([len(s) for s in sents]) if sents else np.zeros(1)
    syllables = np.array([max(1, len(_VOWELS.findall(w))) for w in words]) if words else np.ones(1)

    known = {w: scores[w] for w in set(words) if w in scores}
    word_scores = np.array([known[w] for w in words if w in known])
    sent_scores, sent_sizes = [], []
    for s in sents:
        k = [known[w] for w in s if w in known and w not in ENGLISH]
        if k:
            sent_scores.append(float(np.mean(k)))
            sent_sizes.append(len(s))
    ss, sz = np.array(sent_scores), np.array(sent_sizes, dtype=float)
    bins = np.clip(np.round(ss), 1, 5) if len(ss) else ss
    by_sentence = [float(np.mean(bins == b)) if len(ss) else 0.0 for b in range(1, 6)]
    by_word = [float(sz[bins == b].sum() / sz.sum()) if len(ss) else 0.0 for b in range(1, 6)]
    heavy = [s for s in known.values()]
    content = [frozenset(w for w in s if w not in ENGLISH) for s in sents]
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:])]
    share = lambda group: sum(w in group for w in words) / n
    return [
        float(len(sents)), float(np.log(n)), float(per.mean()), float(per.std()), *_quantiles(per),
        float(lengths.mean()), float(lengths.std()), *_quantiles(lengths), float(np.mean(lengths >= 7)), float(np.mean(lengths >= 10)), float(np.mean(lengths >= 13)),
        float(syllables.mean()), float(np.mean(syllables >= 3)), float(np.mean(syllables >= 5)), len(set(words)) / n,
        float(word_scores.mean()) if len(word_scores) else 0.0, float(word_scores.std()) if len(word_scores) else 0.0, *_quantiles(word_scores), len(word_scores) / n,
        float(ss.mean()) if len(ss) else 0.0, float((ss * sz).sum() / sz.sum()) if len(ss) else 0.0, float(ss.std()) if len(ss) else 0.0, *_quantiles(ss), *by_sentence, *by_word,
        float(np.mean(heavy)) if heavy else 0.0, text.count(",") / max(1, len(sents)), text.count(";") / max(1, len(sents)), text.count("?") / max(1, len(sents)),
        share(ENGLISH), share(LINKS), share(PRONOUNS), share(SUBORDINATORS), float(np.mean([w.endswith(("tion", "ity", "ment", "ness", "ism")) for w in words])) if words else 0.0,
        float(np.mean([w.endswith("ed") for w in words])) if words else 0.0, float(np.mean(overlap)) if overlap else 0.0, float(np.mean([len(c) == 0 for c in content])) if content else 0.0,
    ]


@dataclass
class Trees:
    """Regression trees over binned features. edges: cut values of each feature's bins."""

    base: float = 0.0
    rate: float = 0.1
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int32)
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree))
            for _ in range(len(tree)):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = b[np.arange(len(b)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += self.rate * value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rules: LevelRules) -> Trees:
    """Squared-loss boosting by histograms of up to 32 bins; equal gains go to the first feature and the lowest cut."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    model = Trees(float(y.mean()), rules.rate, edges)
    b = model.binned(x)
    f_count, width = b.shape[1], 33
    flat = b.astype(np.int64) + np.arange(f_count) * width
    pred = np.full(len(y), model.base)
    for _ in range(rules.rounds):
        res = y - pred
        tree, queue = [], [(np.arange(len(y)), 0, -1, 0)]
        while queue:
            rows, level, parent, side = queue.pop(0)
            me = len(tree)
            if parent >= 0:
                p = list(tree[parent])
                p[2 + side] = me
                tree[parent] = tuple(p)
            tree.append((-1, 0, 0, 0, float(res[rows].mean())))
            if level >= rules.depth or len(rows) < 2 * rules.least_leaf:
                continue
            idx = flat[rows].ravel()
            n = np.bincount(idx, minlength=f_count * width).reshape(f_count, width).cumsum(1)
            s = np.bincount(idx, weights=np.repeat(res[rows], f_count), minlength=f_count * width).reshape(f_count, width).cumsum(1)
            total, count = s[:, -1:], len(rows)
            ok = (n >= rules.least_leaf) & (count - n >= rules.least_leaf)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(count - n, 1) - total**2 / count, -1.0)
            j, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, c] <= 1e-9:
                continue
            goes = b[rows, j] <= c
            tree[me] = (int(j), int(c), 0, 0, tree[me][4])
            queue += [(rows[goes], level + 1, me, 0), (rows[~goes], level + 1, me, 1)]
        model.trees.append(tree)
        one = Trees(0.0, model.rate, edges, [tree])
        pred += one.predict(x)
    return model


def _cuts(pred: np.ndarray, y: np.ndarray, levels: tuple[int, int]) -> list[float]:
    """Cut points between levels that agree best with the ratings, each within 0.45 of the middle."""
    out = []
    for lv in range(levels[0], levels[1]):
        tries = np.linspace(lv + 0.05, lv + 0.95, 37)
        errors = [np.sum((pred > t) != (y > lv)) + 1e-3 * abs(t - lv - 0.5) for t in tries]
        out.append(float(tries[int(np.argmin(errors))]))
    return out


@dataclass
class LevelModel:
    trees: Trees
    cuts: list[float]
    scores: dict[str, float]
    report: dict

    def levels(self, x: np.ndarray, lowest: int) -> np.ndarray:
        return lowest + np.searchsorted(np.array(self.cuts), self.trees.predict(x), side="left")


def _word_ratings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(w, y, f) for t, y, f in zip(b["text"], b["rating"], b["fold"]) for w in sorted({w for s in sentences(t) for w in s})]
        yield pd.DataFrame(rows, columns=["word", "rating", "fold"])


def fit_levels(docs: DataFrame, labels: DataFrame, rules: LevelRules = LevelRules()) -> LevelModel | None:
    """The model, or None if no rated document can be read. At most rules.max_labels rated rows reach the driver, as features only."""
    lo, hi = rules.levels
    rated = labels.where(f"level between {lo} and {hi} and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("rating"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_labels)
    got = docs.where("text is not null").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).join(F.broadcast(rated), "doc_id").dropDuplicates(["doc_id"])
    got = got.withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(rules.folds)).cast("int"))
    got = cut(got)
    counts = got.select("text", "rating", "fold").transform(map_batches, _word_ratings, "word string, rating double, fold int").groupBy("word").agg(
        F.sum("rating").alias("s"), F.count(F.lit(1)).alias("k"), *[F.sum(F.when(F.col("fold") == i, F.col("rating")).otherwise(0.0)).alias(f"s{i}") for i in range(rules.folds)],
        *[F.count_if(F.col("fold") == i).alias(f"k{i}") for i in range(rules.folds)],
    )
    table = counts.where(F.col("k") >= rules.least_docs).orderBy(F.desc("k"), "word").limit(rules.vocabulary).collect()
    scores = {r["word"]: r["s"] / r["k"] for r in table}
    # a document's words are scored by the other folds, or its own rating would show through
    others = [{r["word"]: (r["s"] - r[f"s{i}"]) / (r["k"] - r[f"k{i}"]) for r in table if r["k"] - r[f"k{i}"] >= rules.least_docs} for i in range(rules.folds)]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(t, sentences(t), others[f]) for t, f in zip(b["text"], b["fold"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fold": b["fold"], "rating": b["rating"], "x": x})

    rows = got.select("doc_id", "text", "fold", "rating").transform(map_batches, vectors, "doc_id bigint, fold int, rating double, x array<double>").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id")
    x, y, fold = np.array(rows["x"].tolist()), rows["rating"].to_numpy(), rows["fold"].to_numpy()
    held = np.full(len(y), y.mean())
    for k in range(rules.folds):
        test = fold == k
        if test.any() and (~test).sum() >= 2 * rules.least_leaf:
            held[test] = fit_trees(x[~test], y[~test], rules).predict(x[test])
    cuts = _cuts(held, y, rules.levels)
    level = lo + np.searchsorted(np.array(cuts), held, side="left")
    report = {"rated": len(y), "exact": float(np.mean(level == np.round(y))), "within_one": float(np.mean(np.abs(level - y) <= 1)), "mean_abs_error": float(np.mean(np.abs(held - y)))}
    return LevelModel(fit_trees(x, y, rules), cuts, scores, report)


def reading_levels(docs: DataFrame, labels: DataFrame, rules: LevelRules = LevelRules()) -> DataFrame:
    """doc_id, level, score of each document that is mainly English prose of rules.min_words words or more.

    Language is judged by the text, not by its mark. Null, empty and blank texts, scraps and other languages have no
    case. Repeated rows come out each; without rated documents every text gets the middle level; empty tables give no
    rows; extra columns are ignored. Whole texts are read.
    """
    model = fit_levels(docs, labels, rules)
    lo, hi = rules.levels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, xs = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                sents = sentences(t)
                if is_english_prose(sents, rules.min_words):
                    ids.append(i)
                    xs.append(features(t, sents, model.scores) if model else [])
            if model and ids:
                x = np.array(xs)
                score, level = model.trees.predict(x), model.levels(x, lo)
            else:
                score, level = np.full(len(ids), (lo + hi) / 2), np.full(len(ids), (lo + hi) // 2)
            yield pd.DataFrame({"doc_id": ids, "level": np.asarray(level, dtype="int32"), "score": np.asarray(score, dtype="float64")})

    return docs.where("text is not null").select("doc_id", "text").transform(map_batches, run, "doc_id bigint, level int, score double")
