import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsift.llm import bpe_codec

PATH = public_tokenizers.path(bpe_codec.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODEC = bpe_codec.codec(PATH)
TEXTS = [
    "", " ", "\n", "one two  three   four\n\n five", "it's we'll I'd they've HE'S", "1234567 x1y2", "naïve café 中文字 日本語 😀👩‍👩‍👧", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b <|endoftext", "\x00\x01\x7f\x80\x85\xa0 　​", "tabs\t\tand   spaces \r\n", "a" * 1000, "ab" * 700 + "!" * 300,
    " " * 900 + "x", "=" * 500, "Donaudampfschifffahrtsgesellschaft" * 9, "́̂ combining é", "\U0010ffff",
]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def same(text):
    ids = CODEC.encode(text)
    found = np.frombuffer(ids, "<u4").tolist()
    assert found == ids_of(text)
    assert CODEC.decode(ids) == LIBRARY.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_is_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet=" \n\t'srtvdml1aéЖ中!<|>endoftx \u0085\x1c\x1f", max_size=80))
def test_any_text_is_the_library(text):
    same(text)


def test_every_letter_is_cut_like_the_library():
    for lo in range(0, 0x30000, 4096):
        points = [c for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000]
        same("".join(f"a{chr(c)}1 {chr(c)}" for c in points))


def test_heap_and_array_merge_alike():
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 60, 200):
        for alphabet in (b"ab", b"the rain in spain", bytes(range(256))):
            word = bytes(rng.choice(alphabet) for _ in range(n))
            assert CODEC.short(word) == CODEC.long(word)


def test_every_token_is_encoded_and_decoded():
    for i, raw in CODEC.bytes_of.items():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert CODEC.decode(np.array([i], "<u4").tobytes()) == text


def test_bytes_that_are_no_text():
    for ids in ([], [CODEC.byte[0xFF]], [CODEC.byte[0xE4], CODEC.byte[0xB8], 64], [50256, 5]):
        assert CODEC.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_stretches_don_t_change_words(monkeypatch):
    text = "some words  and   more, it's 12 34\n\n x 中 文 <|endoftext|> y " * 40
    monkeypatch.setattr(bpe_codec, "STRETCH", 7)
    same(text)
    same("nospaces" * 500)


def test_memory_of_words_is_bounded(monkeypatch):
    own = bpe_codec.Codec(PATH)
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 10)
    own.encode(" ".join(f"w{i}x" for i in range(500)) + "z" * 900)
    assert len(own.known) <= 10 and all(len(w) <= bpe_codec.SHORT for w in own.known)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH) as f:
        spec = json.load(f)
    spec["model"]["dropout"] = 0.5
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe_codec.Codec(str(tmp_path / "t.json"))


def test_query_equals_the_library(spark, tmp_path):
    rows = [(i, t, "en", 3, b"x") for i, t in enumerate(TEXTS)]
    rows += [(100, None, None, None, None), (None, "no id", None, None, None), (3, TEXTS[3], "en", 3, b"x"), (7, "word " * 400_000, "", 0, b"")]
    spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int, ids binary").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe_codec.op12_bpe_codec(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = ids_of(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_operator_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "id int, t string, `odd name` string")
    out = bpe_codec.decoded(bpe_codec.encoded(df, PATH, "t"), PATH)
    assert [tuple(r) for r in out.select("id", "odd name", "decoded").orderBy("id").collect()] == [(1, "x", "a b"), (2, "y", None)]
    assert bpe_codec.encoded(df.limit(0), PATH, "t").count() == 0
    with pytest.raises(ValueError):
        bpe_codec.encoded(df, PATH, "t", "id")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe_codec.op12_bpe_codec(spark, str(tmp_path)).collect() == []
