import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from braidwork.llm.encode import EncodeRules, _read_ranks, decode_corpus, encode_corpus, VOCABULARY

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENC = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=_read_ranks(VOCABULARY), special_tokens={})


def check(spark, texts, rules=EncodeRules()):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = encode_corpus(df, rules=rules)
    rows = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    assert rows == {i: ENC.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in decode_corpus(got).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_texts(spark):
    texts = [None, "", " ", "\n\n\t ", "Hello world's  end\n", "<|endoftext|> x", "Größe 12.5 €  数据 👍🏽 é", "a\x00b\r\nc", "don't we'LL it's", "x  y   z", "word " * 30_000, "9" * 5000]
    check(spark, texts)
    check(spark, texts, EncodeRules(hot_share=1.0))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=30), min_size=5, max_size=30))
def test_round_trip(spark, texts):
    check(spark, texts)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (2, "d")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in encode_corpus(df).collect())
    assert got == sorted([(1, tuple(ENC.encode_ordinary("a b"))), (2, tuple(ENC.encode_ordinary("c"))), (2, tuple(ENC.encode_ordinary("d")))])
    assert encode_corpus(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [10, 999_999])], "doc_id bigint, ids array<int>")
    assert [r["text"] for r in decode_corpus(bad).collect()] == [None]
