"""Operator 9, repeated strings: bytes that lie in a ``length``-byte string which also starts anywhere else.

Equal windows of ``length`` bytes are owned by equal grams at the same place in them (``anchors``). Grams that occur once
own no repeated window; the strings around the others meet by the gram's hash, aligned at it. A task joins the groups it
is dealt, ``BATCH`` strings or one group at a time, into a run-length index (``runindex``), streams the matching statistics
of every string against it, and marks the starts that match ``length`` bytes. Each window is judged in one group only.

Texts, and strings around a gram, enter the index once for each different one, and twice where they occur twice or more,
so what is repeated whole is found as any other match. A task of the pass over the texts sends a string once for every
``HELD`` bytes that it holds, with the number of its occurrences; the occurrences stay behind in a written table as
(string, row, start), and what the index marked in a string is joined to them there. So neither copies nor a passage that
a third of the documents share travel in numbers to one task: joins go through ``common.join_unique``.
Of a gram with more than ``hot`` occurrences in different texts the different strings are counted first. Up to ``hot`` of
them are a group like any other, however often each occurs; equal ones of different tasks meet by their digest before they
are dealt. Beyond that the windows are dealt out by cells, ``GRID`` starts at a like place before the gram, and by the bytes
that all windows of a cell share. Where those occur once, no window of the cell is repeated and nothing moves; where they
stand in more than ``hot`` different strings too, each window goes by itself, and a group's strings are equal. So a group
has at most ``hot`` different strings, no repeated window is left out, and an occurrence is a row a gram or a cell; only in
cells of that last kind is it a row a window.

Bytes are UTF-8, null is the empty text, and matches never cross documents. Null ids and repeated rows keep a row each, and
a repeated row is another document. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, SEGMENT, owned
from .common import drop_durable, durable, id_text, join_unique, ship, task_count
from .runindex import PAD, matching_columns

LENGTH, HOT, GRID, BATCH, HELD = 400, 1024, 16, 4096, 24 << 20


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _anchored(length: int, segment: int):
    names = ["doc_id", "sha", "n_bytes", "grams", "times"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                sha, size, grams, times, cuts = [], [], [], [], [0]
                for t in b.column(1):
                    data = (t.as_py() or "").encode()
                    sha.append(hashlib.sha256(data).digest())
                    size.append(len(data))
                    different, n = np.unique(owned(data, length, segment=segment)[3], return_counts=True)  # a text says once which grams it has
                    grams.append(different)
                    times.append(n)
                    cuts.append(cuts[-1] + len(grams[-1]))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (_signed(np.concatenate(grams)), np.concatenate(times).astype(np.int32))]
                yield pa.record_batch([b.column(0), pa.array(sha, pa.binary()), pa.array(size, pa.int64()), *lists], names=names)

    return run


def _cell_ranges(place: int, first: int, last: int):
    """(cell, first, last) of the starts first to last, as far as they lie in one cell of the grid before the gram."""
    while first <= last:
        cell = (place - first) // GRID
        end = min(last, place - cell * GRID)
        yield cell, first, end
        first = end + 1


def _digest(string: bytes, seed: int = 0) -> int:
    k = xxhash.xxh3_64_intdigest(string, seed=seed)
    return k - (1 << 64) if k >> 63 else k


def _core(data: bytes, h: int, place: int, cell: int, length: int) -> int:
    """Of what all windows of a cell share."""
    core = data[place - cell * GRID : place - cell * GRID - GRID + 1 + length]
    return _digest(core + h.to_bytes(8, "little", signed=True) + cell.to_bytes(4, "little"))


def _ranges(data: bytes, length: int, segment: int):
    *where, hashes = owned(data, length, segment=segment)
    return zip(*(x.tolist() for x in (*where, _signed(hashes))), strict=True)


def _cells(length: int, hot: int, segment: int):
    """(row, many, text, grams with their counts) to (row, many, core, string, times): the strings around hot grams, whose core is the gram, and those of the cells before them."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b, rows = batch.slice(lo, 512), []
                for row, many, text, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    data, held = text.as_py().encode(), {}
                    hots = {g["h"] for g in grams.as_py() if g["n"] > hot}
                    for first, last, place, h in _ranges(data, length, segment):
                        if h in hots:
                            parts = [(h, first, last), *((_core(data, h, place, cell, length), x, y) for cell, x, y in _cell_ranges(place, first, last))]
                            for core, x, y in parts:
                                name = (core, _digest(data[x : y + length], seed=place - x))
                                held[name] = held.get(name, 0) + 1
                    rows += [(row, many, *name, times) for name, times in held.items()]
                cols = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["row", "many", "core", "string", "times"])

    return run


#: Occurrences have row and start; strings have the rest: key of the group, place of the first start before the gram, number of starts, occurrences, whether any lies in a text that occurs twice, whether the key has more than ``hot`` occurrences.
STRINGS = "sid binary, row long, start long, key long, off int, n int, times long, many boolean, crowd boolean, bytes binary"


def _strings(length: int, hot: int, segment: int):
    """(row, many, text, grams with their counts, cores with theirs and those of their different strings) to STRINGS."""
    names = [x.split()[0] for x in STRINGS.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def batches_of(held: dict, seen: list):
        rows = [(v[0], None, None, key, off, n, v[1], v[2], v[3], data) for (key, off, n, data), v in held.items()]
        for part in (rows, [(*x, *[None] * 7) for x in seen]):
            for lo in range(0, len(part), 8192):
                cols = zip(*part[lo : lo + 8192], strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        held: dict = {}
        seen: list = []
        much = 0
        for b in batches:
            for row, many, text, grams, cores in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                data = text.as_py().encode()
                counts = {g["h"]: g["n"] for g in grams.as_py()}
                repeated = {c["h"]: (c["n"], c["different"]) for c in cores.as_py() or ()}
                for first, last, place, h in _ranges(data, length, segment):
                    n = counts.get(h)
                    if n is None:
                        continue
                    if n <= hot or repeated[h][1] <= hot:
                        parts = [(h, first, last, n > hot)]
                    else:
                        parts = []
                        for cell, x, y in _cell_ranges(place, first, last):
                            n, different = repeated.get(core := _core(data, h, place, cell, length), (0, 0))
                            if n:
                                parts += [(core, x, y, n > hot)] if different <= hot else [(None, i, i, False) for i in range(x, y + 1)]
                    for key, x, y, crowd in parts:
                        string = data[x : y + length]
                        if key is None:
                            key = _digest(string, seed=place - x)
                        name = (key, place - x, y - x + 1, string)
                        entry = held.get(name)
                        if entry is None:
                            sid = xxhash.xxh3_128_digest(b"%d %d %d " % name[:3] + string)
                            held[name] = entry = [sid, 0, False, crowd]
                            much += len(string) + 200
                        entry[1] += 1
                        entry[2] |= many > 1
                        seen.append((entry[0], row, x))
                        much += 100
                if much > HELD:
                    yield from batches_of(held, seen)
                    held, seen, much = {}, [], 0
        yield from batches_of(held, seen)

    return run


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    edge = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    edge[:, 1:-1] = found
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _judge(entries: list[tuple], length: int) -> list[tuple]:
    """entries: (key, sid, off, n, times, many, bytes), by key. (sid, times, [(first, last) starts that are repeated])."""
    merged: dict = {}
    for key, sid, off, n, times, many, data in entries:
        name = (key, off, n, data)
        if name in merged:
            merged[name][1] += times
            merged[name][2] = True
        else:
            merged[name] = [sid, times, many or times > 1]
    size: dict = {}
    for (key, *_), (_, _, twice) in merged.items():
        size[key] = size.get(key, 0) + 1 + twice
    members = [(name, v) for name, v in merged.items() if size[name[0]] > 1]  # a group of one string that occurs once matches nothing
    if not members:
        return []
    doubled = [x for x in members for _ in range(1 + x[1][2])]
    back = max(name[1] for name, _ in members)
    columns = max(back - name[1] + name[2] for name, _ in members)
    rows = np.full((len(doubled), columns + length - 1), PAD, np.uint8)
    valid = np.zeros((len(doubled), columns), bool)
    number: dict = {}
    group = np.empty(len(doubled), np.int64)
    for i, ((key, off, n, data), _) in enumerate(doubled):
        at = back - off
        rows[i, at : at + len(data)] = np.frombuffer(data, np.uint8)
        valid[i, at : at + n] = True
        group[i] = number.setdefault(key, len(number))
    found = matching_columns(rows, group, length, columns, valid)
    marks: dict = {}
    for i, first, last in zip(*(x.tolist() for x in _spans(found)), strict=True):
        (_, off, _, _), (sid, times, _) = doubled[i]
        if i == 0 or doubled[i - 1] is not doubled[i]:
            marks.setdefault(sid, (times, []))[1].append((first - (back - off), last - (back - off)))
    return [(sid, times, spans) for sid, (times, spans) in marks.items()]


MARKS = "sid binary, times long, marks array<struct<a:long,b:long>>"


def _judged(length: int):
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def batch_of(rows: list) -> pa.RecordBatch:
        marks = [[{"a": a, "b": b} for a, b in spans] for *_, spans in rows]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array(marks, kind)], names=["sid", "times", "marks"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if entry[0] != last and len(held) >= BATCH:
                    yield batch_of(_judge(held, length))
                    held = []
                last = entry[0]
                held.append(entry)
        yield batch_of(_judge(held, length))

    return run


CUT = "sha binary, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    """(sha, text, spans) to CUT; spans are (a, b) in any order."""
    names = [x.split()[0] for x in CUT.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            b, rows = batch.slice(lo, 512), []
            for sha, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = (text.as_py() or "").encode()
                kept, at, runs = [], 0, 0
                end = -1
                for a, z in sorted((s["a"], s["b"]) for s in spans.as_py()):
                    if a > end:
                        runs += 1
                        kept.append(data[at:a])
                    end = at = max(end, z)
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((sha, len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
            cols = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)


def repeated_strings(docs: DataFrame, length: int = LENGTH, hot: int = HOT, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``segment``: bytes of a long text that are searched for anchors at once."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    ship(spark)
    texts = id_text(docs, id_col, text_col)
    anchored = durable(texts.mapInArrow(_anchored(length, segment), "doc_id long, sha binary, n_bytes long, grams array<long>, times array<int>"), "anchored")
    # Each different text once; copies are added up within tasks before they move.
    different = durable(anchored.groupBy("sha").agg(F.count(F.lit(1)).alias("many"), F.first("grams").alias("grams"), F.first("times").alias("times")), "different")
    each = different.select("sha", "many", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("sha", "many", F.col("g.grams").alias("h"), F.col("g.times").alias("times"))
    counts = durable(each.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.sum("times").alias("n"), F.sum(F.col("times") * F.col("many")).alias("all")).filter("all > 1").drop("all"), "counts")
    n_docs, n_grams = anchored.count(), each.count()
    grams = join_unique(each, counts, "h", "texts", n_grams).groupBy("sha", "many").agg(F.collect_list(F.struct("h", "n")).alias("grams"))
    keyed = texts.filter(F.octet_length("text") >= length).select(F.unhex(F.sha2("text", 256)).alias("sha"), "text").dropDuplicates(["sha"])
    some = durable(keyed.join(grams, "sha").select(F.monotonically_increasing_id().alias("row"), "sha", "many", "text", "grams"), "sharing")
    drop_durable(counts)
    has_hot = F.exists("grams", lambda g: g["n"] > hot)
    cells = durable(some.filter(has_hot).select("row", "many", "text", "grams").mapInArrow(_cells(length, hot, segment), "row long, many long, core long, string long, times long"), "cells")
    by_string = cells.groupBy("core", "string").agg(F.count(F.lit(1)).alias("texts"), F.sum("times").alias("n"), F.sum(F.col("times") * F.col("many")).alias("all"))
    core_counts = durable(by_string.groupBy("core").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"), F.sum("all").alias("all"), F.count(F.lit(1)).alias("different")).filter("all > 1").drop("all"), "core-counts")
    cores = join_unique(cells.select("row", "core"), core_counts, "core", "texts", cells.count()).groupBy("row").agg(F.collect_list(F.struct(F.col("core").alias("h"), "n", "different")).alias("cores"))
    read = some.select("row", "many", "text", "grams")
    both = read.filter(~has_hot).withColumn("cores", F.lit(None).cast("array<struct<h:long,n:long,different:long>>")).unionByName(read.filter(has_hot).join(cores, "row", "left"))
    strings = durable(both.mapInArrow(_strings(length, hot, segment), STRINGS), "strings")
    drop_durable(cells, core_counts)
    apart = strings.filter("not crowd").select("key", "sid", "off", "n", "times", "many", "bytes")
    # A crowded key's strings are few but come from every task: each is brought together before they are dealt.
    crowded = strings.filter("crowd").groupBy("sid").agg(*(F.first(c).alias(c) for c in ("key", "off", "n")), F.sum("times").alias("times"), F.bool_or("many").alias("many"), F.first("bytes").alias("bytes"))
    dealt = apart.unionByName(crowded).repartition(task_count(spark), "key").sortWithinPartitions("key")
    marks = durable(dealt.mapInArrow(_judged(length), MARKS), "marks")
    occurrences = strings.filter("row is not null").select("sid", "row", "start")
    spans = join_unique(occurrences, marks, "sid", "times", occurrences.count()).select("row", F.transform("marks", lambda m: F.struct((F.col("start") + m["a"]).alias("a"), (F.col("start") + m["b"] + length).alias("b"))).alias("spans"))
    spans = spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = durable(some.select("row", "sha", "text").join(spans, "row").select("sha", "text", "spans").mapInArrow(_cut, CUT), "cut")
    drop_durable(strings, marks, some)
    whole = different.select("sha", "many").join(cut, "sha", "left").select(
        "sha", "many", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")
    )
    return join_unique(anchored.select("doc_id", "sha", "n_bytes"), durable(whole, "whole"), "sha", "many", n_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
