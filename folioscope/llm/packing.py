"""Operator 3, best-fit packing by minimum bin slack.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of the full size, of which the
first may be shorter. Pieces of the full size fill a sequence each. The others are packed bin by bin: the longest length
left opens the bin, and a subset-sum program over bitsets (bit s: the sum s can be reached) of the lengths available
finds the fullest combination for the rest, which is removed. As many bins as the supply allows take the same
combination at once, so the driver's work depends on the number of lengths (below the size of a sequence), not of pieces:
only the histogram of lengths reaches it.

Pieces then find their places without meeting: a piece's rank among those of its length is its number in its task plus
those in earlier tasks, and the plan (a few intervals of ranks for each length, broadcast) turns the rank into a
sequence and an offset. A length that holds most pieces so stays dealt out over all tasks.

Null text is empty (the end id alone). Null ids and repeated rows are packed like others; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretoken, vocab
from .common import drop_durable, durable, id_text, ship

CACHE, CACHED_CHARS = 400_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class Ids(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, data: bytes):
        self.tokenizer = vocab.library(data)
        _, _, special = vocab.merge_table(data)
        self.special = re.compile("(" + "|".join(re.escape(s) for s, _ in sorted(special, key=lambda x: -len(x[0]))) + ")") if special else None
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in special}
        self.library = vocab.library_words(self.tokenizer)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            out.append(self.special_ids[part] if i % 2 else b"".join(map(self.__getitem__, pretoken.words(part, self.library))))
            if len(self) > CACHE:
                self.clear()
        return b"".join(out)


@cache
def _ids(data: bytes) -> Ids:
    return Ids(data)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces after a first one with what is over."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _cut_up(sent, size: int, end: int):
    def run(batches):
        ids, last, task = _ids(sent.value), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, rows = b.slice(lo, 512), []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = ids.ids(t.as_py() or "") + last
                    for k, (start, n) in enumerate(cut(len(data) // 4, size)):
                        rows.append((doc, k, start, n, zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)]), task, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def fullest(size: int, supply: dict[int, int]) -> dict[int, int]:
    """length: how many, of the lengths in supply, with the largest sum up to ``size``; long lengths are taken first among equals."""
    layers, reach, mask = [], 1, (1 << (size + 1)) - 1
    for length in sorted(supply, reverse=True):
        if reach >> size & 1:
            break
        many, k = min(supply[length], size // length), 1
        while many > 0:  # so many copies by doubling
            take = min(k, many)
            layers.append((reach, length, take))
            reach |= reach << (length * take) & mask
            many -= take
            k *= 2
    at, out = reach.bit_length() - 1, defaultdict(int)
    for was, length, take in reversed(layers):
        if not was >> at & 1:
            at -= length * take
            out[length] += take
    return dict(out)


def slack_plan(supply: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins take it), until nothing is left."""
    left, out = {k: n for k, n in supply.items() if n > 0}, []
    while left:
        seed = max(left)
        rest = {k: n - (k == seed) for k, n in left.items() if n > (k == seed) and k <= size - seed}
        combo = fullest(size - seed, rest)
        combo[seed] = combo.get(seed, 0) + 1
        bins = min(left[k] // n for k, n in combo.items())
        out.append((combo, bins))
        for k, n in combo.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


def intervals(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, how many a bin, first bin, offset of its first in a bin)."""
    out, rank, bin0 = defaultdict(list), defaultdict(int), 0
    for combo, bins in plan:
        offset = 0
        for length in sorted(combo, reverse=True):
            out[length].append((rank[length], combo[length], bin0, offset))
            rank[length] += combo[length] * bins
            offset += combo[length] * length
        bin0 += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _placed(sent):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        places = sent.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, offset = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            order = np.argsort(length, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    at = order[lo:hi]
                    n, table = int(length[at[0]]), places[int(length[at[0]])]
                    row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                    nth = rank[at] - row[:, 0]
                    seq[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * n
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(offset)], names=names)

    return run


def pack(docs: DataFrame, size: int = 1024, end: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece. ``tokenizer``: path of a .json file."""
    spark = docs.sparkSession
    ship(spark)
    sent = vocab.send(spark, tokenizer or vocab.public_path("byte_bpe_50k.json"))
    pieces = durable(id_text(docs, id_col, text_col).mapInArrow(_cut_up(sent, size, end), PIECES), "pieces")
    counts = durable(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    supply = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length up to size
    places = spark.sparkContext.broadcast(intervals(slack_plan(supply, size)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
