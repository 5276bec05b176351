"""Operator 1, SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

Words are runs without ASCII whitespace after lower-casing A-Z, shingles are three words (repeats count; a shorter text
is one shingle; a text without words has fingerprint zero and links like any other). Two documents link when their
64-bit fingerprints differ in at most ``budget`` bits.

The join works on distinct fingerprints, so copies cost nothing. A trie over billions of them is dealt out as subtries:
of four 16-bit blocks at most two hold the two differing bits, so a linked pair agrees on two blocks, and each of the six
choices of two blocks, read first, makes a rotated trie whose subtries at depth 32 are independent. Within a subtrie,
pairs of nodes go down together, the bits in which they differ are added up, and a pair is dropped as soon as the sum
passes the budget. A subtrie with more than ``cap`` leaves is dealt out once more by two of four bytes of its other
32 bits, which leaves 16 free bits: no task ever holds more than 65,536 leaves of one subtrie, whatever the data.
A task reports the links that join two of its trees (a spanning forest, which has the same components).

Nulls: a null text is empty. A null doc_id keeps its row; it never is a component's id unless all its rows' ids are null.
Repeated rows: each gets a row. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, id_text, join_unique, numbered, only_rows, ship, task_count
from .components import components

SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
#: Each choice of blocks to agree on; holds for a budget of up to two bits.
CHOICES = list(combinations(range(BLOCKS), 2))
PIECE = 1 << 16


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit values have each bit, least bit first."""
    rows = np.concatenate([h, np.zeros(-len(h) % 255, np.uint64)]).reshape(-1, 255)
    out = np.empty((8, 8), np.int64)
    for i in range(8):  # a byte lane adds up to 255 ones before it could overflow
        lanes = ((rows >> np.uint64(i)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
        out[:, i] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        counts += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        prints = np.fromiter(map(fingerprint, (t.as_py() for t in b.column(1))), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(prints.view(np.int64)), b.column(2)], names=["doc_id", "fp", "row"])


def trie_links(values: list[int], budget: int):
    """Pairs of indexes into ``values`` (ascending, distinct, unsigned) that differ in at most ``budget`` bits.

    A node is a range of the sorted values that agree above ``bit``; its children part at ``bit``.
    """

    def part(lo: int, hi: int, bit: int) -> tuple[tuple[int, int], tuple[int, int]]:
        mid = bisect_left(values, (values[lo] >> bit | 1) << bit, lo, hi)
        return (lo, mid), (mid, hi)

    todo = [(0, len(values), 0, len(values), 63, 0)]
    while todo:
        alo, ahi, blo, bhi, bit, spent = todo.pop()
        if ahi - alo == 1 and bhi - blo == 1:
            if alo != blo and ((values[alo] ^ values[blo]) & ((1 << bit + 1) - 1)).bit_count() + spent <= budget:
                yield alo, blo
            continue
        if alo == blo:
            bit = (values[alo] ^ values[ahi - 1]).bit_length() - 1  # the whole range agrees above
            left, right = part(alo, ahi, bit)
            todo += [(*left, *left, bit - 1, 0), (*right, *right, bit - 1, 0)]
            if budget > 0:
                todo.append((*left, *right, bit - 1, 1))
            continue
        for x, (lo, hi) in enumerate(part(alo, ahi, bit)):
            for y, (lo2, hi2) in enumerate(part(blo, bhi, bit)):
                if lo < hi and lo2 < hi2 and spent + (x != y) <= budget:
                    todo.append((lo, hi, lo2, hi2, bit - 1, spent + (x != y)))


def forest(values: list[int], budget: int) -> list[tuple[int, int]]:
    """Of the links among the values, those that join two trees."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in trie_links(values, budget):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((values[i], values[j]))
    return out


def runs(batches, keys: int):
    """From batches sorted by their first ``keys`` columns, the last column's values of each key, as arrays."""
    held, key = [], None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        turn = np.zeros(b.num_rows, bool)
        for c in cols[:keys]:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            k = tuple(c[lo] for c in cols[:keys])
            if key is not None and k != key:
                yield np.concatenate(held) if len(held) > 1 else held[0]
                held = []
            held.append(cols[-1][lo:hi])
            key = k
    if held:
        yield np.concatenate(held) if len(held) > 1 else held[0]


def _joined(budget: int):
    def run(batches):
        u, v = [], []
        for got in runs(batches, 2):
            if len(got) > 1:
                for a, b in forest(sorted(set(got.view(np.uint64).tolist())), budget):
                    u.append(a)
                    v.append(b)
            if len(u) >= 1 << 16:
                yield pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return run


def _bits(fp, at: int, size: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def subtries(nodes: DataFrame, cap: int) -> DataFrame:
    """(fp) to (k1, k2, fp): the subtries each distinct fingerprint belongs to."""
    fp = F.col("fp")
    keys = [F.lit(c << 32).cast("long").bitwiseOR(F.shiftleft(_bits(fp, 16 * i, 16), 16)).bitwiseOR(_bits(fp, 16 * j, 16)) for c, (i, j) in enumerate(CHOICES)]
    rows = nodes.select(F.explode(F.array(*keys)).alias("k1"), "fp")
    full = rows.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("k1", F.lit(True).alias("full"))
    rest = {c: [16 * b + 8 * half for b in range(BLOCKS) if b not in CHOICES[c] for half in (0, 1)] for c in range(len(CHOICES))}
    fine = F.lit(None).cast("array<long>")
    for c, at in rest.items():
        subs = [F.lit(s << 16).cast("long").bitwiseOR(F.shiftleft(_bits(fp, at[i], 8), 8)).bitwiseOR(_bits(fp, at[j], 8)) for s, (i, j) in enumerate(CHOICES)]
        fine = F.when(F.shiftright("k1", 32) == c, F.array(*subs)).otherwise(fine)
    split = F.when(F.col("full"), fine).otherwise(F.array(F.lit(-1).cast("long")))
    return rows.join(full, "k1", "left").select("k1", F.explode(split).alias("k2"), "fp")


def simhash_rows(texts: DataFrame, budget: int = 2, cap: int = 8192) -> DataFrame:
    """(doc_id, text, row) to row, doc_id, fp, component_id, and first_row: the row of the component's first document."""
    if budget not in (0, 1, 2):
        raise ValueError("the choice of agreeing blocks holds for budgets of up to two bits")
    spark = texts.sparkSession
    ship(spark)
    prints = durable(texts.mapInArrow(_fingerprints, "doc_id long, fp long, row long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = durable(prints.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    dealt = subtries(nodes.select("fp"), cap).repartition(task_count(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
    links = durable(dealt.mapInArrow(_joined(budget), "u long, v long"), "links")
    stars = components(links)
    drop_durable(links)
    labelled = durable(nodes.join(stars, nodes.fp == stars.u, "left").select("fp", "first", "rows", F.coalesce("v", "fp").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("prints"))
    of_print = durable(join_unique(labelled, durable(least, "components"), "label", "prints", labelled.count()).select("fp", "rows", "least"), "of-prints")
    drop_durable(nodes, stars, labelled)
    return join_unique(prints, of_print, "fp", "rows", prints.count()).select("row", "doc_id", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first_row"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, cap: int = 8192) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of ``docs``."""
    texts = id_text(docs, id_col, text_col).withColumn("row", F.lit(0).cast("long"))
    return simhash_rows(texts, budget, cap).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, null ids last; of one id's, the first."""
    docs, row = numbered(docs)
    return only_rows(docs, row, simhash_rows(id_text(docs, row_col=row)).filter("row = first_row"))
