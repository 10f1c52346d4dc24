"""Encoders of the public tokenizer files, made once per Python worker."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
from collections.abc import Callable
from importlib import metadata

import numpy as np


def version(path: str) -> str:
    """Digest of all that defines the ids of encoder(path): files, splitting pattern, library and its release."""
    of, beside = hashlib.sha256(), _ranks(path)
    for name in [path, *([beside] if beside else [])]:
        with open(name, "rb") as f:
            of.update(hashlib.sha256(f.read()).digest())
    library = "sentencepiece" if path.endswith(".model") else "tiktoken" if beside else "tokenizers"
    of.update(f"{library} {metadata.version(library)}".encode())
    if beside:
        import public_tokenizers

        of.update(public_tokenizers.PATTERN.encode())
    return of.hexdigest()


def _ranks(path: str) -> str | None:
    """The same vocabulary as byte ranks, if it lies beside."""
    beside = path.removesuffix(".json") + ".tiktoken"
    return beside if path.endswith(".json") and os.path.exists(beside) else None


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, without begin, end or added special tokens.

    .model: sentencepiece. .json: the tokenizers library's ids; where the same vocabulary lies beside
    it as byte ranks (.tiktoken), that library gives the same ids several times faster and is used.
    Strings of special tokens inside a text become that token, which is the tokenizers default.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(sp.encode(text), dtype=np.uint32)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    beside = _ranks(path)
    if not beside:
        return plain
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex engine gives up on some very long runs
            return plain(text)

    return encode
