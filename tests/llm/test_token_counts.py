import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docsift.llm import bpe, common, token_counts

TEXTS = [None, "", "one two", "one two", "<|endoftext|>", "é😀 中文", "word " * 3000, "\x00 odd"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(1, "", 5)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), path).collect()
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = lambda s, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(s))
    want = sorted((i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, _ in rows)
    assert sorted(map(tuple, got)) == want


def test_cache_answers_and_grows(spark):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    cache = common.shared_dir(spark)
    df = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    token_counts.count_tokens(df("a b", "a b", "c"), path, cache)
    ver = bpe.version(path)
    assert token_counts.cached(spark, cache, ver).count() == 2
    marked = token_counts.cached(spark, cache, ver).selectExpr("digest", f"'{ver}' tokenizer", "n_tokens + 1000 n_tokens")
    marked.write.mode("append").parquet(cache)  # a later row wins as the larger one: it was read, not encoded anew
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df("a b", "new text"), path, cache).collect()}
    assert got == {0: 1002, 1: 2}
    assert token_counts.cached(spark, cache, ver).count() == 3
    assert token_counts.count_tokens(df(), path, cache).count() == 0


def test_filled_cache_is_hit_and_only_misses_are_encoded(spark, monkeypatch):
    cache = common.shared_dir(spark)
    at = common.shared_dir(spark)
    rows = [(i, f"text number {i % 30} of several") for i in range(100)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    one = {r.doc_id: tuple(r) for r in token_counts.op4_token_counts(spark, at, cache).collect()}
    stored = spark.read.parquet(cache)
    assert stored.count() == 31
    again = {r.doc_id: tuple(r) for r in token_counts.op4_token_counts(spark, at, cache).collect()}
    assert again == one and spark.read.parquet(cache).count() == 31
    more = spark.createDataFrame([*rows, (300, "a new text"), (301, "a new text")], "doc_id long, text string")
    path = public_tokenizers.path(token_counts.TOKENIZER)
    for limit, text in ((token_counts.BROADCAST, "a new text"), (0, "another new text")):
        monkeypatch.setattr(token_counts, "BROADCAST", limit)
        got = {r.doc_id: tuple(r) for r in token_counts.count_tokens(more.replace("a new text", text), path, cache).collect()}
        assert {k: v for k, v in got.items() if k < 300} == one and got[300][1:] == got[301][1:]
    assert spark.read.parquet(cache).count() == 33
