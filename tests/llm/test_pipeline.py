"""The pipeline against its stages' definitions, one after the other."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from folioscope.llm import catalog, packing, private, quality

from .test_operators import naive_bootstrap, naive_print, naive_spans, naive_stats, odd_rows


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    for name, sql in catalog.ORACLE.items():
        got = catalog.QUERIES[name](spark, sf)
        want = con.sql(sql).select(*got.columns).fetchall()
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def brute(docs, labels):
    """The stages one after the other in plain Python, over (doc_id, text) rows: what each leaves, and the pieces of the last."""
    counts = {d: quality.statistics(t) for d, t in docs.items()}
    x = quality.rates({c: np.array([counts[d][i] for d in docs], np.float64) for i, c in enumerate(quality.COUNTS)})
    rejected = np.zeros(len(docs), bool)
    for rule in labels:
        rejected |= quality.covers(rule, x)
    kept = {d: t for (d, t), no in zip(docs.items(), rejected, strict=True) if not no and (s := naive_stats(t))[0] >= 10 and 100 * s[4] <= 20 * s[0]}
    yield kept
    best = {}
    for d, t in kept.items():
        name = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[name] = min(best.get(name, (1, 0)), (-len(t or ""), d))
    kept = {d: kept[d] for _, d in sorted(best.values(), key=lambda x: x[1])}
    yield kept
    prints = {d: naive_print(t) for d, t in kept.items()}
    root = {d: d for d in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    kept = {d: t for d, t in kept.items() if root[d] == d}
    yield kept
    texts = list(kept.values())
    more = naive_bootstrap(texts, private.TRUST, private.SUPPORT, private.ROUNDS)
    masked = {}
    for i, (d, text) in enumerate(kept.items()):
        spans = sorted({(a, k, b) for a, k, b, _ in naive_spans(text)} | {(a, k, b) for j, a, b, k in more if j == i})
        out, at = "", 0
        for a, k, b in spans:
            if b > at:
                out += (text[at:a] + f"<{private.NAMES[k].upper()}>") if a >= at else ""
                at = b
        masked[d] = out + text[at:]
    yield masked
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = Counter()
    for d, t in masked.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        pieces.update((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    yield pieces


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(quality.text_statistics(docs), spark.read.parquet(f"{sf}/labels.parquet"))
    columns, wanted = docs.columns, brute({r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}, rules)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs, want = spark.read.parquet(path), next(wanted)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert docs.count() == len(want)
    rows = docs.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 1024 and [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() for parts in seqs.values())
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_odd_tables(spark, tmp_path, monkeypatch):
    """Nulls in every column, repeated ids, no rows at all, and columns whose names clash with the operators' own."""
    rows, schema = odd_rows()
    labels = spark.createDataFrame([(None, 0, None), (1, None, 1)], "doc_id long, quality int, toxic int")
    for name, given in (("odd", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(given, schema).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert [c for c in out.columns] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() > 0) == bool(given)
