"""Vocabulary files: read on the driver, sent to executors as one broadcast of a checked size."""

from __future__ import annotations

import base64
import json
from functools import cache

from pyspark.sql import SparkSession

#: Vocabulary files are a few MB; one beyond this isn't sent.
MAX_BYTES = 64 << 20

_sent: dict = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def send(spark: SparkSession, path: str):
    """A broadcast of the file's bytes."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        with open(path, "rb") as f:
            data = f.read(MAX_BYTES + 1)
        if len(data) > MAX_BYTES:
            raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
        _sent[key] = spark.sparkContext.broadcast(data)
    return _sent[key]


@cache
def library(data: bytes):
    """The tokenizers library's tokenizer of a .json file; special strings in texts by its default."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode())


def library_words(tokenizer):
    """The words of a text as the library's own pre-tokenizer parts it."""
    return lambda text: [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte, to that byte: printing Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def merge_table(data: bytes) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]], list[tuple[str, int]]]:
    """Of a .json file: the symbol of each byte, (left, right) to (rank, joined symbol), and the special strings with their ids."""
    model = json.loads(data)
    vocab = model["model"]["vocab"]
    first = [0] * 256
    for ch, b in byte_alphabet().items():
        first[b] = vocab[ch]
    joins = {}
    for rank, pair in enumerate(model["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        joins[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return first, joins, [(t["content"], t["id"]) for t in model["added_tokens"]]


def ranks(data: bytes) -> dict[bytes, int]:
    """Of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
