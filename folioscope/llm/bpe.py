"""Operator 4, byte-level BPE: recursive DuckDB queries encode, ordered aggregation decodes.

Each task's words are tables of (word, position, token) rows. A recursive query joins adjacent rows with the table of
merges, contracts each word's leftmost pair of the least rank, and ends when no word has one. A worker keeps the ids of
up to ``CACHE`` short words between tasks, those met last, so only words that are new to it are rows. Decoding makes ids rows,
joins the vocabulary's bytes and puts them together in order. ``round_trip`` does both in one worker.

Null is the empty text: no ids, no bytes. Null ids keep their rows, repeated rows get one each, an empty table gives an
empty table, other columns are ignored. A word longer than ``LONG`` bytes would need as many rounds as it has merges:
such words go through a query of their own that contracts, in each round, all pairs of the word's least rank, left to
right without overlap.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken, vocab
from .common import id_text, ship

CACHE, CACHED_CHARS, LONG, ROWS = 1_000_000, 64, 256, 400_000

#: best: least rank and, below it, the leftmost place that has it; the row after that place goes.
ENCODE = """
with recursive step(w, p, t, live) as (
    select w, p, t, true from symbols
    union all
    select w, p, case when p = best & 4294967295 then (best >> 32)::integer else t end, best is not null
    from (
        with placed as materialized (
            select w, p, t, case when lead(w) over word = w then lead(t) over word end as after,
                case when lag(w) over word = w then lag(p) over word end as before
            from step where live window word as (order by w, p)
        )
        select placed.*, best
        from placed left join (
            select w, min((rank::bigint << 32) | p) as best
            from placed join merges on pair = (t::bigint << 32) | after
            group by w
        ) using (w)
    )
    where best is null or before is distinct from best & 4294967295
)
select w, list(t order by p) as ids from step where not live group by w
"""

#: The same with all places of the least rank at once: in a run of places that touch, every second one. Contracting one of
#: them can't make a pair of lower rank elsewhere, if every token of the vocabulary is what its own bytes contract to: let
#: a, b be a pair of least rank and x, ab one of lower rank. The bytes of xab, contracted alone, go through the contractions
#: made within them so far, since none crossed their ends, and stand at x, a, b, where no pair has a rank below ab's; so they
#: would not contract to a token below it. A test holds every token of the vocabulary against that.
ENCODE_LONG = """
with recursive step(w, p, t, live) as (
    select w, p, t, true from symbols
    union all
    select w, i, case when hit then (best)::integer else t end, best is not null
    from (
        select *, lag(hit) over (partition by w order by i) as gone
        from (
            select *, rank is not null and rank = best and (i - first_of_run) % 2 = 0 as hit
            from (
                select *, max(case when rank is distinct from best then i end) over (partition by w order by i) + 1 as run0,
                    coalesce(run0, 0) as first_of_run
                from (
                    select s.w, s.i, s.t, m.rank, min(m.rank) over (partition by s.w) as best
                    from (
                        select w, t, lead(t) over word as after, row_number() over word - 1 as i
                        from step where live window word as (partition by w order by p)
                    ) s left join merges m on m.pair = (s.t::bigint << 32) | s.after
                )
            )
        )
    )
    where gone is not true
)
select w, list(t order by p) as ids from step where not live group by w
"""

#: Bytes are written as the 256 first characters.
DECODE = """
select d, string_agg(chars, '' order by i) as chars
from coded join vocabulary using (t)
group by d
"""


class Coder(dict):
    """Word to its ids (little-endian, 4 bytes each), in two generations; tables of merges and bytes in a DuckDB of this worker."""

    def __init__(self, data: bytes):
        import duckdb

        self.older: dict[str, bytes] = {}
        ranks = vocab.ranks(data)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.register("given_merges", pa.table({"pair": left << 32 | right, "rank": rank.astype(np.int32)}))
        self.db.register("given_bytes", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("create table merges as from given_merges")
        self.db.execute("create table vocabulary as from given_bytes")
        self.db.unregister("given_merges")
        self.db.unregister("given_bytes")

    def _run(self, query: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _coded(self, words: list[bytes], query: str = ENCODE) -> list[bytes]:
        """The ids of each word, 4 bytes each; words have at least a byte."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        got = self._run(query, "symbols", pa.table({"w": w, "p": p, "t": self.first[np.frombuffer(b"".join(words), np.uint8)]}))
        out = [b""] * len(words)
        if got.num_rows:
            ids = got.column("ids").combine_chunks()
            flat, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            for w_, lo, hi in zip(got.column("w").to_pylist(), cuts, cuts[1:], strict=False):
                out[w_] = flat[lo:hi]
        return out

    def encode(self, words: list[bytes], query: str = ENCODE) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in self._coded(words, query)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Makes the short ones of these words part of the younger generation; the long ones' ids are returned."""
        if len(self) > CACHE // 2:
            self.older = dict(self)
            self.clear()
        short, much, extra = [], 0, {}
        for word in words:
            if word in self:
                continue
            if (known := self.older.get(word)) is not None:
                self[word] = known
                continue
            data = word.encode()
            if len(data) > LONG:
                extra[word] = self._coded([data], ENCODE_LONG)[0]
                continue
            short.append((word, data))
            much += len(data)
            if much > ROWS:
                self._keep(short, extra)
                short, much = [], 0
        self._keep(short, extra)
        return extra

    def _keep(self, short: list[tuple[str, bytes]], extra: dict[str, bytes]) -> None:
        if short:
            for (word, _), ids in zip(short, self._coded([d for _, d in short]), strict=True):
                (self if len(word) <= CACHED_CHARS else extra)[word] = ids

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        rows = {"d": np.repeat(np.arange(len(ids), dtype=np.int32), size), "i": np.arange(size.sum()), "t": np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)}
        got = self._run(DECODE, "coded", pa.table(rows))
        out = [b""] * len(ids)
        for d, x in zip(got.column("d").to_pylist(), got.column("chars").to_pylist(), strict=True):
            out[d] = x.encode("latin-1")
        return out


@cache
def _coder(data: bytes) -> Coder:
    return Coder(data)


def _pieces(b: pa.RecordBatch, limit: int = 3 << 20):
    """Slices of about ``limit`` characters: large enough that a query's fixed cost is small beside its words."""
    lo = much = 0
    for i, t in enumerate(b.column(1)):
        much += len(t.as_py() or "")
        if much >= limit or i + 1 == b.num_rows:
            yield b.slice(lo, i + 1 - lo)
            lo, much = i + 1, 0


def _encoded(sent):
    def run(batches):
        coder = _coder(sent.value)
        library = None
        for batch in batches:
            for b in _pieces(batch):
                texts = [t.as_py() or "" for t in b.column(1)]
                parted = [pretoken.words(t, library := library or library_words(sent.value)) for t in texts]
                new = set()
                for ws in parted:
                    new.update(ws)
                extra = coder.learn(new)
                find = (lambda w: extra[w] if w in extra else coder[w]) if extra else coder.__getitem__
                joined = [b"".join(map(find, ws)) for ws in parted]
                flat = np.frombuffer(b"".join(joined), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) // 4)]).astype(np.int32)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return run


def library_words(data: bytes):
    """The words of a text as the tiktoken library's pattern parts it, for texts with code points that Python doesn't know."""
    import regex

    from public_tokenizers import PATTERN

    return regex.compile(PATTERN).findall


def _decoded(sent):
    def run(batches):
        coder = _coder(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                lists = b.column(1)
                flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                yield pa.record_batch([b.column(0), lists, pa.array(coder.decode([flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]), pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def _send(rows: DataFrame, ranks: str | None):
    ship(rows.sparkSession)
    return vocab.send(rows.sparkSession, ranks or vocab.public_path("byte_bpe_50k.tiktoken"))


def encode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids. ``ranks``: path of a byte-level .tiktoken file."""
    return id_text(docs, id_col, text_col).mapInArrow(_encoded(_send(docs, ranks)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) to doc_id, ids, decoded: the bytes that the ids stand for."""
    return coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decoded(_send(coded, ranks)), "doc_id long, ids array<int>, decoded binary")


def _digests(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            b = batch.slice(lo, 128)
            ids = b.column(1)
            flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            rows = [flat[x:y].tolist() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in rows]), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in b.column(2)])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts that are encoded and decoded again, in one worker a task."""
    sent = _send(docs, ranks)

    def run(batches):
        return _digests(_decoded(sent)(_encoded(sent)(batches)))

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
