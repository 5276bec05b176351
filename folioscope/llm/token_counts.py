"""Operator 2, token counts: heap-and-linked-list byte-pair merging that never forms identifiers of the output.

A word's symbols are a doubly linked list, its adjacent pairs a heap by (rank, place). Each pop joins the lowest-ranked,
leftmost pair that still stands; the count is the initial symbols less the joins. Words recur, so a worker keeps the
counts of up to ``CACHE`` short words; the memory is bounded and the result the same without it.

Special strings of the vocabulary inside a text count one token each, as the library's default has it. Null is the empty
text (0 tokens). A null doc_id keeps its row, repeated rows are counted each, an empty table gives an empty table, and
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken, vocab
from .common import id_text, ship

CACHE, CACHED_CHARS = 400_000, 64


def merged_count(symbols: list[int], joins: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left when every pair that has a rank is joined, lowest rank first, leftmost first."""
    n = left = len(symbols)
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*joins[p], i, *p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in joins]
    heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
    heapify(heap)
    while heap:
        _, i, new, a, b = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two has been joined to another meanwhile
        sym[i], sym[j] = new, -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if got := joins.get((new, sym[k])):
                heappush(heap, (got[0], i, got[1], new, sym[k]))
        if (h := before[i]) >= 0 and (got := joins.get((sym[h], new))):
            heappush(heap, (got[0], h, got[1], sym[h], new))
    return left


class Counts(dict):
    """Word to token count, worked out when first asked for."""

    def __init__(self, data: bytes):
        self.first, self.joins, special = vocab.merge_table(data)
        self.special = re.compile("|".join(re.escape(s) for s, _ in sorted(special, key=lambda x: -len(x[0])))) if special else None
        self.library = vocab.library_words(vocab.library(data))

    def __missing__(self, word: str) -> int:
        first = self.first
        n = merged_count([first[b] for b in word.encode()], self.joins)
        if len(word) <= CACHED_CHARS:
            self[word] = n
        return n

    def tokens(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        n = len(parts) - 1
        for part in parts:
            n += sum(map(self.__getitem__, pretoken.words(part, self.library)))
            if len(self) > CACHE:
                self.clear()
        return n


@cache
def _counts(data: bytes) -> Counts:
    return Counts(data)


def _counted(sent, limit: int):
    def run(batches):
        counts = _counts(sent.value)
        for b in batches:
            size, n = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                size.append(len(text.encode()))
                n.append(counts.tokens(text))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). ``tokenizer``: path of a byte-level .json file."""
    ship(docs.sparkSession)
    sent = vocab.send(docs.sparkSession, tokenizer or vocab.public_path("byte_bpe_50k.json"))
    return id_text(docs, id_col, text_col).mapInArrow(_counted(sent, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
