"""Encoding of a whole corpus with a public byte-level vocabulary, each distinct word once.

Texts are cut into pre-tokens by the vocabulary's pattern in the JVM. The distinct pre-tokens of the corpus are encoded
once each, and the ids join back and are put together by position; the vocabulary file is read on the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut, map_batches

#: Public pre-token pattern of the byte-level vocabularies, with Unicode classes as its authors' engine has them.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class EncodeRules:
    """vocabulary: a file of lines 'base64 of the token's bytes, rank', readable on every executor.

    hot_share: pre-tokens that hold more of the corpus' rows than this are joined by broadcast. There can be no more
    than 1 / hot_share of them, so their table has a bound whatever the corpus; all others are joined by shuffle.
    """

    vocabulary: str = VOCABULARY
    hot_share: float = 0.0005


_ENCODERS: dict[str, object] = {}


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str):
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=_read_ranks(path), special_tokens={})
    return _ENCODERS[path]


def pretokens(text: Column) -> Column:
    """Array of the text's pre-tokens; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, part (hash of the text), pos, word: a row for each pre-token of each text that has any."""
    return docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("part"), F.posexplode(pretokens(F.col(text_col))).alias("pos", "word"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, ids of each row of words(word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path)
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [enc.encode_ordinary(w) for w in b["word"]]})

    return words.select("word").transform(map_batches, run, "word string, ids array<int>")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EncodeRules = EncodeRules()) -> DataFrame:
    """doc_id, ids: the token ids of every text, without special tokens.

    Null and empty texts give an empty list, blanks are encoded like any text, special tokens' strings are ordinary
    text. Whole texts of any length are encoded. Rows that repeat id and text come out once; an id with several texts
    has a row for each. An empty table gives no rows; extra columns are ignored.
    """
    words = _words(docs, id_col, text_col)
    uses = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("uses")))
    total = uses.agg(F.sum("uses")).first()[0] or 0
    least_hot = max(1.0, total * rules.hot_share)
    book = encode_words(uses, rules.vocabulary)
    hot_words = [r["word"] for r in uses.where(F.col("uses") > least_hot).select("word").collect()]  # fewer than 1 / hot_share
    hot = F.broadcast(encode_words(docs.sparkSession.createDataFrame([(w,) for w in hot_words], "word string"), rules.vocabulary).withColumnRenamed("ids", "hot_ids"))
    marked = words.join(hot, "word", "left")
    cold = marked.where("hot_ids is null").select("doc", "part", "pos", "word").join(book, "word")
    whole = marked.where("hot_ids is not null").select("doc", "part", "pos", F.col("hot_ids").alias("ids")).unionByName(cold.select("doc", "part", "pos", "ids"))
    parts = whole.groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "ids")).alias("w"))  # one group is one text
    ids = F.flatten(F.transform(F.array_sort(F.array_distinct("w")), lambda x: x["ids"]))
    empty = docs.where(F.coalesce(F.length(text_col), F.lit(0)) == 0).select(F.col(id_col).alias("doc")).distinct().select(F.col("doc").alias(id_col), F.array().cast("array<int>").alias("ids"))
    return parts.select(F.col("doc").alias(id_col), ids.alias("ids")).unionByName(empty)


def token_bytes(spark, path: str = VOCABULARY) -> DataFrame:
    """id, piece (binary): the vocabulary's token-byte table; its size is that of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _read_ranks(path).items()], "id int, piece binary")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of each row of ids. Null or empty lists give ''; an unknown id gives a null text."""
    rows = encoded.select(F.col(id_col).alias("doc"), F.xxhash64(ids_col).alias("part"), F.posexplode_outer(ids_col).alias("pos", "id"))
    pieces = rows.join(F.broadcast(token_bytes(encoded.sparkSession, path)), "id", "left")
    parts = pieces.groupBy("doc", "part").agg(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("piece")))).alias("w"))
    ordered = F.array_sort(F.array_distinct("w"))
    whole = ~F.exists(ordered, lambda x: x["piece"].isNull())
    text = F.decode(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")), "UTF-8")
    return parts.select(F.col("doc").alias(id_col), F.when(whole, text).alias("text"))
