"""Operator 6, exact duplicates: an extendible-hash index on shared files.

Texts are equal when they are equal without ASCII whitespace. The index hashes the normalised text to 64 bits. Its
directory starts with one bucket; a bucket whose distinct texts take more than ``capacity`` bytes splits by the next
bit, and a split at the directory's depth doubles the directory. The capacity is an eighth of an owner task's share,
``CAPACITY`` at most, but at least a ``MAX_BUCKETS``-th of all bytes, so fewer than MAX_BUCKETS buckets are overfull at
any depth. Only sums of bytes by hash prefix reach the driver, at most ``MAX_CELLS`` rows a round, and further rounds look
only into buckets that are still overfull. The directory is a table in the shared folder beside the entries: each
bucket's prefix, its least key, and its owner. Owners take ranges of buckets that hold like numbers of bytes.

Entries are written by a pass over the texts, which reads the stored directory. A presence bitmap of fixed size tells
which hashes occur in more than one row; texts of other hashes can have no equal and are not moved. A task first chains
what it has itself: of equal texts, compared as bytes, only one carries its bytes on, so a group of copies sends one text
from each task (one for every ``HELD`` bytes of different texts that the task has chained), however large it is. An owner
task takes the key range that the directory gives it and no other key, follows the chain of each hash and compares bytes;
different texts with one hash are different links of the chain.

Of equal texts the row with the most code points stays, then the one with the smallest doc_id (a null id comes last);
``keep_first`` goes by rows, and of rows with one id too the first stays.
Null is the empty text; texts of nothing but whitespace equal it. Rows that repeat a doc_id are rows of one document
and share its fate: each counts in group_size. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, drop_durable, durable, id_text, numbered, only_rows, ship, task_count

STEP, MAP_BITS, CAPACITY, HELD = 12, 24, 32 << 20, 32 << 20
MAX_BUCKETS, MAX_CELLS = 1 << 14, 1 << 18
_DROP = str.maketrans("", "", WHITE)
_BYTES = bytes(ord(c) for c in WHITE)


def normal_bytes(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _BYTES)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _keys(bits: int):
    def run(batches):
        mask = (1 << bits) - 1
        for b in batches:
            data = [normal_bytes(t.as_py()) for t in b.column(1)]
            h = np.fromiter((xxhash.xxh3_64_intdigest(d) & mask for d in data), np.uint64, len(data))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array([len(d) for d in data], pa.int64())], names=["h", "bytes"])

    return run


class Directory:
    """Cells of hash prefixes; a bucket is (depth, prefix, bytes), and none is deeper than 64 bits."""

    def __init__(self, bits: int = 64):
        self.bits, self.buckets, self.open = bits, [], [(0, 0)]

    def split(self, sizes: dict[tuple[int, int], dict[int, tuple[int, int]]], step: int, capacity: int) -> None:
        """sizes: for each open bucket, (bytes, distinct keys) by the next ``step`` bits of its keys."""
        todo, self.open = [(d, p, 0, 0) for d, p in self.open], []
        while todo:
            depth, prefix, down, rest = todo.pop()
            root = (depth - down, prefix >> down)
            cells = [v for k, v in sizes.get(root, {}).items() if k >> (step - down) == rest]
            much = sum(v[0] for v in cells)
            if much <= capacity or sum(v[1] for v in cells) <= 1 or depth == self.bits:
                self.buckets.append((depth, prefix, much))
            elif down == step:
                self.open.append((depth, prefix))
            else:
                todo += [(depth + 1, prefix << 1 | bit, down + 1, rest << 1 | bit) for bit in (0, 1)]

    @property
    def depth(self) -> int:
        return max((d for d, *_ in self.buckets), default=0)

    def table(self, owners: int) -> list[tuple[int, str, int, int]]:
        """(depth, prefix in bits, least key, owner) in the order of keys: buckets are ranges of keys, and so are owners."""
        total, before, out = max(1, sum(n for *_, n in self.buckets)), 0, []
        for first, d, p, n in sorted((p << (self.bits - d) if d else 0, d, p, n) for d, p, n in self.buckets):
            out.append((d, format(p, f"0{d}b") if d else "", _signed(first), min(owners - 1, (before + n // 2) * owners // total)))
            before += n
        return out


def build_directory(keys: DataFrame, capacity: int | None = None, bits: int = 64, step: int = STEP, owners: int = 1) -> Directory:
    """From distinct keys (h, bytes): splits until no bucket is overfull that has more than one key."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    wanted = capacity if capacity is not None else min(CAPACITY, total // (8 * owners) + 1)
    capacity = max(wanted, total // MAX_BUCKETS)
    out = Directory(bits)
    while out.open:
        depth = out.open[0][0]
        step_now = min(step, bits - depth, (MAX_CELLS // len(out.open)).bit_length() - 1)
        if bits == depth:
            out.buckets += [(d, p, 0) for d, p in out.open]
            break
        top = F.shiftrightunsigned("h", bits - depth - step_now) if bits - depth - step_now < 64 else F.lit(0).cast("long")
        rows = keys.select(top.bitwiseAND(F.lit((1 << (depth + step_now)) - 1).cast("long")).alias("cell") if depth + step_now < 63 else top.alias("cell"), "bytes")
        if depth:  # fewer than MAX_BUCKETS are open
            rows = rows.join(F.broadcast(keys.sparkSession.createDataFrame([(p,) for _, p in out.open], "prefix long")), F.shiftrightunsigned("cell", step_now) == F.col("prefix"), "left_semi")
        sizes: dict = {}
        for r in rows.groupBy("cell").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            sizes.setdefault((depth, r["cell"] >> step_now), {})[r["cell"] & ((1 << step_now) - 1)] = (r["b"], r["n"])
        out.split(sizes, step_now, capacity)
    return out


def read_directory(stored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least key and the owner of each bucket, by key."""
    rows = sorted((r["first"] % (1 << 64), r["owner"]) for r in stored.select("first", "owner").collect())
    return np.array([f for f, _ in rows], np.uint64), np.array([o for _, o in rows], np.int32)


def presence(shared: DataFrame, bits: int, map_bits: int) -> np.ndarray:
    """A bitmap of 2^map_bits cells with those set that hold a key of ``shared``; 64 cells make a row, so at most 2^map_bits / 64 rows come."""
    map_bits = min(map_bits, bits)
    cell = F.shiftrightunsigned("h", bits - map_bits)
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    rows = shared.select(cell.alias("cell")).select(F.shiftrightunsigned("cell", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(max(1, 1 << map_bits >> 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


ENTRIES = "row long, doc_id long, sha string, points long, h long, owner int, bucket int, chain string, bytes binary, n long, best_row long"


def better(a: tuple, b: tuple) -> bool:
    """Whether (code points, doc_id or null, row) a stays rather than b."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


_NONE = (-1, None, 1 << 62)


def _entered(sent, places, bits: int, map_bits: int):
    """(doc_id, text, row) to ENTRIES: members have a row, heads of chains have bytes, and the best of their members in doc_id, points and best_row."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in ENTRIES.split(", ")]
    map_bits = min(map_bits, bits)

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        present, (first, owner), mask, task = sent.value, places.value, (1 << bits) - 1, TaskContext.get().partitionId()
        chains: dict[int, list[list]] = {}
        much = serial = 0

        def heads():
            links = [(h, link) for h, chain in chains.items() for link in chain]
            for lo in range(0, len(links), 1024):
                out = []
                for h, (data, name, n, best) in links[lo : lo + 1024]:
                    bucket = int(np.searchsorted(first, np.uint64(h), side="right")) - 1
                    out.append((None, best[1], None, best[0], _signed(h), int(owner[bucket]), bucket, name, data, n, best[2]))
                yield batch_of(out)

        for b in batches:
            rows = []
            for doc, t, row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = t.as_py() or ""
                data = normal_bytes(text)
                h = xxhash.xxh3_64_intdigest(data) & mask
                sha, cell = hashlib.sha256(data).hexdigest(), h >> (bits - map_bits)
                if not int(present[cell >> 6]) >> (cell & 63) & 1:
                    rows.append((row, doc, sha, len(text), _signed(h), None, None, None, None, None, None))
                    continue
                links = chains.setdefault(h, [])
                link = next((x for x in links if x[0] == data), None)
                if link is None:
                    link = [data, f"{task}-{serial}", 0, _NONE]
                    links.append(link)
                    serial += 1
                    much += len(data) + 300
                link[2] += 1
                if better((len(text), doc, row), link[3]):
                    link[3] = (len(text), doc, row)
                rows.append((row, doc, sha, len(text), _signed(h), None, None, link[1], None, None, None))
            yield batch_of(rows)
            if much > HELD:
                yield from heads()
                chains.clear()
                much = 0
        yield from heads()

    return run


def _owned(places):
    """Heads sorted by bucket and hash to (chain, keep_id, keep_row, group_size): of each hash, a chain of different texts."""

    def run(batches):
        first, owner = places.value
        task = TaskContext.get().partitionId()
        links: list[list] = []
        last = None

        def done():
            rows = [(name, best[1], best[2], n) for _, names, n, best in links for name in names]
            cols = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["chain", "keep_id", "keep_row", "group_size"])

        for b in batches:
            bucket, h, chain, n, points, ids, best_row = (b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7))
            for i in range(b.num_rows):
                if h[i] != last:
                    if int(np.searchsorted(first, np.uint64(h[i] % (1 << 64)), side="right")) - 1 != bucket[i] or owner[bucket[i]] != task:
                        raise ValueError(f"key {h[i]} is not in a bucket of owner {task}: the entries were dealt by another directory")
                    if links:
                        yield done()
                    links, last = [], h[i]
                data = b.column(3)[i].as_py()
                link = next((x for x in links if x[0] == data), None)
                if link is None:
                    link = [data, [], 0, _NONE]
                    links.append(link)
                link[1].append(chain[i])
                link[2] += n[i]
                if better((points[i], ids[i], best_row[i]), link[3]):
                    link[3] = (points[i], ids[i], best_row[i])
        yield done()

    return run


def exact_rows(texts: DataFrame, capacity: int | None = None, bits: int = 64, map_bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, text, row) to row, doc_id, sha, keep_id, keep_row, group_size. ``bits``: of the hash; fewer make collisions, as tests do."""
    spark = texts.sparkSession
    ship(spark)
    owners = task_count(spark)
    keys = durable(texts.select("doc_id", "text").mapInArrow(_keys(bits), "h long, bytes long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "keys")
    shared = keys.filter("n > 1")
    directory = build_directory(shared, capacity, bits, owners=owners)
    stored = durable(spark.createDataFrame(directory.table(owners), "depth int, prefix string, first long, owner int").coalesce(1), "directory")
    present, places = spark.sparkContext.broadcast(presence(shared, bits, map_bits)), spark.sparkContext.broadcast(read_directory(stored))
    entries = durable(texts.mapInArrow(_entered(present, places, bits, map_bits), ENTRIES), "entries")
    drop_durable(keys)
    heads = entries.filter("bytes is not null").select("owner", "bucket", "h", "chain", "bytes", "n", "points", "doc_id", "best_row")
    dealt = heads.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "h").drop("owner")
    chains = durable(dealt.mapInArrow(_owned(places), "chain string, keep_id long, keep_row long, group_size long"), "chains")
    rows = entries.filter("bytes is null")
    alone = rows.filter("chain is null").select("row", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    # A chain's rows are of one task, so no key of this join holds more than a task's rows.
    return alone.unionByName(rows.filter("chain is not null").join(chains, "chain").select("row", "doc_id", "sha", "keep_id", "keep_row", "group_size"))


def exact_groups(docs: DataFrame, capacity: int | None = None, bits: int = 64, map_bits: int = MAP_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    texts = id_text(docs, id_col, text_col).withColumn("row", F.lit(0).cast("long"))
    return exact_rows(texts, capacity, bits, map_bits).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, whatever ids they have or share."""
    docs, row = numbered(docs)
    return only_rows(docs, row, exact_rows(id_text(docs, row_col=row)).filter("row = keep_row"))
