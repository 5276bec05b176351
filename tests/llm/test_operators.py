"""The corpus operators against brute force, on a fixture of odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import gzip
import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from folioscope.llm import anchors, bpe, catalog, common, exact, licenses, packing, private, quality, runindex, simhash, substrings, token_counts, vocab, warc, zipstore

rnd = random.Random(5)
LONG = " ".join(rnd.choice(["the", "of", "alpha", "Beta,", "é", "x1"]) + str(rnd.randrange(900)) for _ in range(6000))
SHARED = "".join(rnd.choice("abcdé ") for _ in range(460))
TEXTS = [
    None, "", " \t\n", "a", "one two", "One TWO three", "one two three", "one  two\nthree", LONG, LONG + " more words here", SHARED + "tail", "head" + SHARED, SHARED[:399], "ab" * 500, "z" * 2000,
    "mail me@example.org now, 10.0.0.256 or 10.0.0.1; +1 (555) 123-4567 and 4111 1111 1111 1111", "a<|endoftext|>b  <|endoftext|>", "日本語 ½ xᲉy 'll 'LL", "\x85 \x1c a\xa0b",
    "Licensed under CC BY-NC 4.0.\nAll  rights\nreserved. Released under the MIT License", "marK K icense general PUBLIC license general public license", "### $$$ %%% &&& *** | | <a> <b> #c", "same line\nsame line\nsame line\n\nsame line",
    "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 " * 3,
]
ROWS = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", 5), (None, "one two three", "y", None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, sha string, row long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, want):
    assert sorted_rows(df) == sorted(want, key=repr)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (simhash.simhash_groups(empty), token_counts.token_counts(empty), packing.pack(empty), bpe.round_trip(empty), quality.quality_rules(empty, labels), exact.exact_groups(empty), private.digests(private.private_spans(empty)), warc.round_trip(pages), substrings.repeated_strings(empty), licenses.license_scan(empty)):
        assert df.count() == 0


def naive_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([words[i : i + 3] for i in range(len(words) - 2)] or [words])] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    prints = [(d, naive_print(t)) for d, t, *_ in ROWS]
    root = {f: f for _, f in prints}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = defaultdict(list)
    for d, f in prints:
        least[root[f]].append(d)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    same(simhash.simhash_groups(docs), [(d, f"{f:016x}", name[root[f]]) for d, f in prints])


def test_trie_finds_every_link(spark):
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)} | {0, 1, 2, 3, 2**64 - 1})
    for budget in (0, 1, 2):
        want = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= budget}
        assert {(max(p), min(p)) for p in simhash.trie_links(values, budget)} == want
    links = {frozenset((values[i], values[j])) for i, j in simhash.trie_links(values, 2)}
    nodes = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    for cap in (1, 10**6):  # split subtries lose no link
        rows = simhash.subtries(nodes, cap).groupBy("k1", "k2").agg({"fp": "collect_set"}).collect()
        found = {frozenset((vs[i], vs[j])) for r in rows for vs in [sorted(x % 2**64 for x in r[2])] for i, j in simhash.trie_links(vs, 2)}
        assert found == links


@pytest.fixture(scope="module")
def ids():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, ids):
    same(token_counts.token_counts(docs), [(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t, *_ in ROWS])


def test_packing(docs, ids):
    rows = packing.pack(docs).collect()
    want = Counter()
    for d, t, *_ in ROWS:
        full = np.array([*ids(t), 2], "<u4")
        want.update((d, k, s, n, zlib.crc32(full[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(full), 1024)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(n for v in seqs.values() for _, n in v)
    assert len(seqs) <= 1.02 * total / 1024 + 2


def test_fullest_bin():
    for _ in range(100):
        supply = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 7))}
        sums = {0}
        for k, n in supply.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= 50}
        got = packing.fullest(50, supply)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= supply[k] for k, n in got.items())
    plan = packing.slack_plan({5: 4, 6: 2, 3: 9}, 10)
    assert sum(k * n * bins for combo, bins in plan for k, n in combo.items()) == 59


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    same(bpe.round_trip(docs), [(d, len(i), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for d, t, *_ in ROWS for i in [enc.encode_ordinary(t or "")]])


def test_both_contractions_agree():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.Coder(f.read())
    words = ["".join(rnd.choice("abtheionr é") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(300)] + [b"a" * 37, b"ab" * 30]
    assert [list(x) for x in coder.encode(words)] == [list(x) for x in coder.encode(words, bpe.ENCODE_LONG)]


def test_words_at_the_switch(spark):
    """Around the length at which contraction changes, and the property of the vocabulary that both need."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(enc._encode_single_piece(token) == [rank] for token, rank in ranks.items())
    pieces = ["a", "ab", "the", "ing", "é", "日", "tion", "aaab"]
    texts = [(p * n)[:size] for size in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3 * bpe.LONG) for p in pieces for n in [size]]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(60, 400))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts) for ids in [enc.encode_ordinary(t)]]
    same(bpe.round_trip(docs), want)


def naive_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality(spark, docs, sf_dir):
    labels = spark.createDataFrame([(None, 0), (3, None), (8, 1), (8, 0)], "doc_id long, quality int")
    out = quality.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same_rows = []
    for d, t, *_ in ROWS:
        s = naive_stats(t)
        same_rows.append((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert sorted(map(tuple, out), key=repr) == sorted(same_rows, key=repr)
    for kinds in (2, 4, 50, 5000):
        text = " ".join(str(rnd.randrange(kinds)) for _ in range(300))
        assert quality.statistics(text)[:5] == naive_stats(text)


def test_rules_as_an_expression(spark):
    """The conditional expression rejects what ``covers`` says, rule by rule in order."""
    rows = [tuple(rnd.randrange(0, 40) for _ in quality.COUNTS) for _ in range(300)]
    x = quality.rates({c: np.array([r[i] for r in rows], np.float64) for i, c in enumerate(quality.COUNTS)})
    rules = [[("upper", ">", 0.4), ("words", "<=", 20.0)], [("repeats", ">", 0.9)], [("digits", "<=", 0.1), ("marks", ">", 1.5), ("words_a_line", ">", 0.5)]]
    covered = np.zeros(len(rows), bool)
    for rule in rules:
        covered |= quality.covers(rule, x)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    got = [r.kept for r in df.select("i", quality.expression(rules).alias("kept")).orderBy("i").collect()]
    assert got == (~covered).tolist() and 20 < covered.sum() < 280


def test_sample_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.text_statistics(docs)
    assert isinstance(quality.fit(stats, labels, sample=10), list) and quality.fit(stats, labels, sample=0) == []


def test_quality_holds_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in catalog.op5_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not kept[r.doc_id].base_failed]
    good, bad = ([kept[r.doc_id].kept for r in labels if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_exact(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    want = [(d, min(g)[2], len(g), d == min(g)[2], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in ROWS for g in [groups[norm(t)]]]
    for options in ({}, {"bits": 3}, {"capacity": 1, "map_bits": 7}):
        same(exact.exact_groups(docs, **options), want)


def test_directory_doubles(spark):
    keys = [(rnd.getrandbits(64) - 2**63, 10) for _ in range(500)] + [(7, 10_000)]
    d = exact.build_directory(spark.createDataFrame(keys, "h long, bytes long"), 100, step=3)
    table = d.table(4)
    first = np.array([f % 2**64 for *_, f, _ in table], np.uint64)
    held = Counter(int(np.searchsorted(first, np.uint64(h % 2**64), side="right")) - 1 for h, _ in keys)
    assert max(held.values()) <= 11 and (np.diff(first.astype(object)) > 0).all() and d.depth > 5
    assert [o for *_, o in table] == sorted(o for *_, o in table) and {o for *_, o in table} <= set(range(4))
    shares = Counter()
    for h, n in keys:
        shares[table[int(np.searchsorted(first, np.uint64(h % 2**64), side="right")) - 1][3]] += n * (h != 7)
    assert max(shares.values()) < 5000  # the one overfull key has an owner nearly for itself


def test_driver_rows_are_bounded(spark, monkeypatch):
    """However small the capacity asked for, a MAX_BUCKETS-th of all bytes is the least, and no round collects over MAX_CELLS rows."""
    monkeypatch.setattr(exact, "MAX_BUCKETS", 16)
    monkeypatch.setattr(exact, "MAX_CELLS", 64)
    seen = []
    split = exact.Directory.split
    monkeypatch.setattr(exact.Directory, "split", lambda self, sizes, step, capacity: (seen.append((len(self.open), sum(map(len, sizes.values())), capacity)), split(self, sizes, step, capacity))[1])
    exact.build_directory(spark.createDataFrame([(rnd.getrandbits(64) - 2**63, 10) for _ in range(2000)], "h long, bytes long"), 1, step=3)
    assert all(n_open < 16 and cells <= 64 and capacity == 20_000 // 16 for n_open, cells, capacity in seen) and len(seen) > 1


def test_the_directory_deals(spark, docs, monkeypatch):
    """Entries that were dealt by another directory than the owners read are refused; so the stored one is what routes."""
    read, calls = exact.read_directory, []

    def other(stored):
        first, owner = read(stored)
        calls.append(len(first))
        return first, owner[::-1].copy() if len(set(owner.tolist())) > 1 else owner + 1

    monkeypatch.setattr(exact, "read_directory", other)
    exact.exact_groups(docs, capacity=1).count()  # any whole directory deals rightly, if all read the same
    assert calls and calls[0] > 1
    sent = iter(range(9))
    monkeypatch.setattr(exact, "read_directory", read)
    owned = exact._owned
    monkeypatch.setattr(exact, "_owned", lambda places: owned(spark.sparkContext.broadcast((places.value[0][:1], places.value[1][:1] + 1 + next(sent)))))
    with pytest.raises(Exception, match="another directory"):
        exact.exact_groups(docs, capacity=1).count()


def odd_rows():
    """Repeated and null ids with good and bad, equal, near and private texts, in a table whose columns clash with ours."""
    good = "plain words that stand once each in this line and go on for some more of them until the end"
    bad = "x " * 40
    rows = [(1, good), (1, bad), (None, good + " null"), (None, None), (2, ""), (2, "same"), (None, "same"), (None, "other one"), (3, "same "), (3, "sa me"), (4, "other one"), (5, LONG), (5, LONG + " more words here"), (6, "mail me@example.org now"), (6, "mail nobody now"), (None, "10.0.0.1 is it")]
    names = ["row", "_row", "spans", "_spans", "keep", "sha"]
    return [(d, t, len(t or ""), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names)


def test_keeping_goes_by_rows(spark):
    rows, schema = odd_rows()
    docs = spark.createDataFrame(rows, schema).repartition(3)
    by = lambda df: sorted(((int(r[3][3:]), *r) for r in df.collect()))
    full = {int(r[3][3:]): r for r in rows}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = by(quality.keep_good(docs, labels))
    want = [i for i, r in full.items() if (s := naive_stats(r[1]))[0] >= 10 and 100 * s[4] <= 20 * s[0]]
    assert [k[0] for k in kept] == want and all(tuple(k[1:]) == full[k[0]] for k in kept)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, r in full.items():
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    kept = by(exact.keep_first(docs))
    assert len(kept) == len(groups) and {(min(g)[:3]) for g in groups.values()} == {(-len(k[2] or ""), k[1] is None, k[1] or 0) for k in kept}
    assert all(tuple(k[1:]) == full[k[0]] for k in kept)
    prints = {i: naive_print(r[1]) for i, r in full.items()}
    root = {f: f for f in prints.values()}
    for _ in root:
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for i, f in prints.items():
        groups[root[f]].append((full[i][0] is None, full[i][0] or 0))
    kept = by(simhash.keep_one(docs))
    assert sorted((k[1] is None, k[1] or 0) for k in kept) == sorted(min(g) for g in groups.values()) and len(groups) < len(rows)
    masked = by(private.mask(docs))
    assert [k[0] for k in masked] == sorted(full)
    for k in masked:
        spans = naive_spans(full[k[0]][1])
        text = full[k[0]][1]
        for a, _, b, kind in reversed(spans):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        assert tuple(k[1:]) == (full[k[0]][0], text, len(text or ""), *full[k[0]][3:])


def test_row_numbers(spark, tmp_path):
    """A table that is only read gets numbers that hold; one that is worked out is written first."""
    rows, schema = odd_rows()
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    for docs, written in ((scan, False), (scan.select("doc_id", "text", "spans", "n_chars"), False), (scan.repartition(3), True), (scan.filter("doc_id > 1"), True), (scan.sample(0.5), True)):
        out, name = common.numbered(docs)
        assert bool(getattr(out, "_folioscope_path", None)) == written and name not in docs.columns
        whole, few = {r[name]: r.text for r in out.collect()}, {r[name]: r.text for r in out.select(name, "text").filter("length(text) > 5").collect()}
        assert len(whole) == out.count() and few.items() <= whole.items()


def test_kept_rows_of_an_empty_table(spark):
    docs = spark.createDataFrame([], odd_rows()[1])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (quality.keep_good(docs, labels), exact.keep_first(docs), simhash.keep_one(docs), private.mask(docs)):
        assert out.columns == docs.columns and out.count() == 0


def naive_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for i, (k, p) in enumerate(kinds):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and private.luhn(digits), "phone": 10 <= len(digits) <= 15}[k]:
                out.append((m.start(), i, m.end(), k))
    return sorted(out)


def test_private_base(docs):
    want = []
    for d, t, *_ in ROWS:
        s = naive_spans(t)
        want.append((d, *(sum(x[1] == i for x in s) for i in range(4)), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()))
    same(private.digests(private.private_spans(docs)).drop("spans", "n_spans"), want)
    for _ in range(300):
        text = "".join(rnd.choice("a1.@-+ 2%") for _ in range(40))
        assert [(a, private.KINDS[k], b) for a, b, k in private.base_spans(text)] == [(a, k, b) for a, _, b, k in naive_spans(text)]


def test_private_bootstrapping(spark):
    rows = [(i, f"please call number +1 555 {100 + i} {4000 + i} today") for i in range(12)] + [(50, "please call number 0171-5551234 today"), (51, "it was 0171-5551234 then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in private.digests(private.private_spans(docs)).collect()}
    assert spans[50] == "phone:19:31" and spans[51] == "" and spans[3].startswith("phone:19:")
    masked = {r.doc_id: r.text for r in private.mask(docs).collect()}
    assert masked[50] == "please call number <PHONE> today" and masked[51] == rows[13][1]


def test_private_kinds_share_a_context(spark):
    def card(i):
        return next(d for n in range(10) if private.luhn(d := f"41111111111{i:04}{n}"))

    seeds = [t for i in range(12) for t in (card(i), f"10.1.2.{i}", f"+1 555 {200 + i} 4000", f"m{i}@example.org")]
    bad = str(int(card(3)) + 1)
    unseen = {100: ("0171-5551234", "phone"), 101: (bad, "card"), 102: ("10.1.2.300", "ip"), 103: ("me@local", "email"), 104: ("order123456", None)}
    rows = [(i, f"see contact: {t} soon") for i, t in enumerate(seeds)] + [(i, f"see contact: {t} soon") for i, (t, _) in unseen.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.digests(private.private_spans(docs)).collect()}
    assert {i: got[i] for i in unseen} == {i: f"{kind}:13:{13 + len(t)}" if kind else "" for i, (t, kind) in unseen.items()}


def test_private_rounds(spark):
    bare = [f"0171-555{1000 + i}" for i in range(20)]
    texts = [f"please call number +1 555 {100 + i} 4000 today" for i in range(80)] + [f"please call number {t} today" for t in bare]
    texts += [f"my desk line: {t} ok" for t in bare] + ["my desk line: 0171-5559999 ok"]  # no seed stands there
    texts += [f"lot of {i + 2000000} pieces" for i in range(40)] + [f"lot of +1 555 {700 + i} 4000 pieces" for i in range(6)]  # mostly unknown
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.digests(private.private_spans(docs)).collect()}
    assert {got[i] for i in range(80, 100)} == {"phone:19:31"}
    assert {got[i] for i in range(100, 121)} == {"phone:14:26"}
    assert {got[i] for i in range(121, 161)} == {""}
    first = {r.doc_id: r.spans for r in private.digests(private.private_spans(docs, rounds=1)).collect()}
    assert first[80] == "phone:19:31" and first[100] == first[120] == ""


def naive_bootstrap(texts, trust, support, rounds):
    """The pattern and instance graph by dictionaries: (text number, span) of all that the trusted patterns hold."""
    found = [(i, c) for i, t in enumerate(texts) for c in private.candidates(t, private.base_spans(t))]
    kind, patterns = {}, defaultdict(set)
    for _, (_, _, k, instance, held) in found:
        for p in held:
            patterns[p].add(instance)
            kind[p, instance] = max(kind.get((p, instance), -1), k)
    learned = {}
    for _ in range(rounds):
        reached = {}
        for (p, x), k in kind.items():
            if k < 0 and p in learned:
                new = (learned[p][1], -learned[p][0])
                reached[x] = max(reached.get(x, new), new)
        learned_now = {}
        for p, held in patterns.items():
            sums, n = Counter(), Counter()
            for x in held:
                k = kind[p, x]
                score = (1.0, k) if k >= 0 else (reached[x][0], -reached[x][1]) if x in reached else None
                if score:
                    sums[score[1]] += score[0]
                    n[score[1]] += 1
            known = sum(sums.values())
            for k in sums:
                if n[k] >= support and (c := sums[k] / (known + private.DOUBT * (len(held) - known))) >= trust:
                    learned_now[p] = (k, c)
        learned = learned_now
    out = set()
    for i, (a, b, k, _, held) in found:
        best = max(((learned[p][1], -learned[p][0]) for p in held if p in learned), default=None)
        if (k < 0 or k == private.SECRET) and best:
            out.add((i, a, b, -best[1]))
    return out


def test_private_graph(spark):
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(14)]
    texts = [f'some words token = "{h}" and more {rnd.randrange(9)}' for h in hexes] + ['the token = "Zx81-99_4412" is short', f"sum {hexes[0][::-1]} in prose"]
    texts += [f"{rnd.choice(['call', 'fax', 'id'])} {rnd.choice(['me at', 'number', 'no:'])} {rnd.choice([f'+1 555 {rnd.randrange(100, 120)} 4000', f'0171-{rnd.randrange(5550000, 5550030)}', f'10.0.{rnd.randrange(9)}.7', str(rnd.randrange(10**5, 10**5 + 9))])} {rnd.choice(['now', 'today', ''])}" for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for rounds in (1, 2, 3):
        got = set()
        for r in private.private_spans(docs, 0.6, 3, rounds).collect():
            got |= {(r.doc_id, s.a, s.b, s.k) for s in r["all"] if s not in r["base"]}
        assert got == naive_bootstrap(texts, 0.6, 3, rounds)
    spans = {r.doc_id: (r.spans, r.n_spans) for r in private.digests(private.private_spans(docs)).collect()}
    assert spans[0] == ("secret:20:60", 1) and spans[14] == ("secret:13:25", 1) and spans[15] == ("", 0)
    masked = {r.doc_id: r.text for r in private.mask(docs).collect()}
    assert masked[14] == 'the token = "<SECRET>" is short'


def test_long_contexts():
    """Contexts reach over any white space and take of a long token what is near; a long word costs no more than its length."""
    far = "call number" + " " * 500 + "0171-555 1234" + "\n" * 300 + "today ok"
    near = "call number 0171-555 1234 today ok"
    hashes = lambda t: [c[4] for c in private.candidates(t, [])]
    assert hashes(far) == hashes(near) and len(hashes(near)[0]) == 3
    assert hashes("z" * 99 + ":1234567 b") == hashes("z" * 500 + ":1234567 b")
    long_token = "a1" * 50_000
    assert [(a, b) for a, b, *_ in private.candidates(f"x {long_token} y", [])] == [(2, 2 + len(long_token))]


def test_warc(spark):
    pages = [(1, "http://a/\n", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", "<p>é</p>", 1), (5, "u", "solo" * 9000, 1), (5, "u", "solo" * 9000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, size int")
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"<p>é</p>": 2, "": 4, "solo" * 9000: 5}
    want = [(p, len((h or "").encode()), b32(h), "response" if p == last[h or ""] else "revisit", None if p == last[h or ""] else last[h or ""]) for p, _, h, _ in pages]
    same(warc.round_trip(df), want)
    assert {r.record_type for r in warc.round_trip(df, least=10**6).collect()} == {"response"}
    manifest = warc.write_archives(df).collect()
    for m in manifest:
        system, path = warc.open_fs(m.path)
        with zipfile.ZipFile(system.open_input_file(path)) as z:  # another reader can read what ours writes
            assert z.testzip() is None and len(z.namelist()) == 2
            assert gzip.decompress(z.read(f"archive/{m.name}.warc.gz")).startswith(b"WARC/1.1")


def test_zip_reader_takes_plain_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("a.txt", b"hello")
        z.writestr("dir/é.bin", b"x" * 70)
        z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    archive = zipstore.Reader(lambda at, n: data[at : at + n], len(data))
    assert list(archive.members) == ["a.txt", "dir/é.bin", "packed"]
    start = archive.data_start("a.txt")
    assert data[start : start + 5] == b"hello"
    with pytest.raises(zipstore.BadArchive):
        archive.data_start("packed")
    with pytest.raises(zipstore.BadArchive):
        zipstore.Reader(lambda at, n: b"nothing"[at : at + n], 7)


def naive_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    for x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        yield len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()


def naive_removal_of_long(texts, length):
    """The same by a rolling hash, for texts too long to slice at every byte; equal hashes are compared as bytes."""
    data = [(t or "").encode() for t in texts]
    first, twice = {}, set()
    power = pow(257, length - 1, (1 << 61) - 1)
    for k, x in enumerate(data):
        h = 0
        for i, c in enumerate(x):
            if i >= length:
                h -= x[i - length] * power
            h = (h * 257 + c) % ((1 << 61) - 1)
            if (at := i - length + 1) >= 0:
                kk, j = first.setdefault(h, (k, at))
                if (kk, j) != (k, at):
                    assert data[kk][j : j + length] == x[at : i + 1]
                    twice |= {(kk, j), (k, at)}
    for k, x in enumerate(data):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x)):
            if (k, i) in twice:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        yield len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,hot", [(400, 1024), (400, 1), (64, 3), (70, 10**9)])
def test_repeated_strings(spark, docs, length, hot):
    short = [(d, t) for d, t, *_ in ROWS if len(t or "") < 5000]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    want = [(d, *x) for (d, _), x in zip(short, naive_removal([t for _, t in short], length), strict=True)]
    same(substrings.repeated_strings(df, length, hot), want)


def test_repeated_strings_in_long_texts(spark):
    """Whole long texts, passages across the border of a segment, NUL bytes beside strings' ends, and copies."""
    edge = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    texts = [LONG, LONG + " more", LONG[100:20_000] + edge, "q" * 3000 + edge + LONG[5:3000], "\0" * 900, "\0" * 450 + edge[:500], edge, edge, None, edge[:399]]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    want = [(d, *x) for d, x in enumerate(naive_removal_of_long(texts, 400))]
    for segment, hot in ((1000, 1), (4096, 4), (substrings.SEGMENT, 1024)):
        same(substrings.repeated_strings(df, hot=hot, segment=segment), want)


def test_occurrences_of_hot_strings_stay_few(spark, monkeypatch):
    """A passage of far more texts than ``hot``, whole or with a changed byte: rows go by grams and cells, not by windows, and the result is whole."""
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    around = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(300))
    changed = [passage[:i] + "#" + passage[i + 1 :] for i in range(50, 1450, 70)]
    texts = [around() + x + around() for x in [passage] * 60 + changed] + [around() + passage + passage[:700] + around(), passage, passage]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    joined = []

    def counting(left, right, key, held, total):
        joined.extend([left.join(right, key).count()] if key == "sid" else [])
        return common.join_unique(left, right, key, held, total)

    monkeypatch.setattr(substrings, "join_unique", counting)
    want = [(d, *x) for d, x in enumerate(naive_removal_of_long(texts, 400))]
    for hot in (8, 30):
        same(substrings.repeated_strings(df, hot=hot), want)
    windows = 60 * (len(passage) - 399)
    assert all(0 < n < windows / 8 for n in joined), (joined, windows)


def test_owners_do_not_depend_on_segments():
    data = "".join(rnd.choice("abc ") for _ in range(9000)).encode()
    spread = lambda segment: [(s, p) for f, z, p, _ in zip(*anchors.owned(data, 400, segment=segment), strict=True) for s in range(f, z + 1)]
    assert spread(500) == spread(1 << 20) and len(spread(500)) == len(data) - 399


def test_run_index():
    """Matching statistics from the runs alone, against comparing rows; repetitive rows take few runs."""
    base = [rnd.choice(b"ab") for _ in range(60)]
    rows = np.array([[c if rnd.random() > 0.02 else rnd.choice(b"ab") for c in base] for _ in range(40)], np.uint8)
    group = np.array([0] * 25 + [1] * 15)
    index = runindex.RunIndex(rows, group, 12, 49)
    seen = 0
    for column, got in index.stream():
        for i in range(40):
            longest = 0
            for j in range(40):
                if j != i and group[i] == group[j]:
                    n = 0
                    while n < 12 and rows[i, column + n] == rows[j, column + n]:
                        n += 1
                    longest = max(longest, n)
            assert got[i] == longest
        seen += 1
    assert seen == 49 and index.run_count < 40 * 48 / 3


def test_licenses(spark, docs):
    rows = [r for r in ROWS if r[0] is not None][: len(TEXTS)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(d, t) for d, t, *_ in rows])
    want = sorted(con.sql(catalog.ORACLE["op10_licenses"]).fetchall(), key=repr)
    got = sorted_rows(licenses.license_scan(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    assert got == want
    found = {r[0]: r for r in got}
    assert found[19][6] == "cc-by,cc-by-nc,mit,reserved" and found[20][2] == 2
    assert licenses.license_scan(docs).count() == len(ROWS)


def test_wrapped_licenses(spark):
    texts = {
        "bsd": "x 1\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mpl-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy",
        "cc-by": "This work is licensed under a Creative Commons Attribution\n4.0\nInternational License.",
        "mit": "Released\nunder\r\n the\nMIT\nLicense",
        "": "Redistribution and use in source and binary forms, with or without\n # \nmodification, are permitted",
    }
    far = "Released under\n" + "word " * 17 + "\nthe MIT License"
    docs = spark.createDataFrame([*enumerate(texts.values()), (9, far)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == {i: (label, 1.0 if label else 0.0) for i, label in enumerate(texts)} | {9: ("", 0.0)}


def test_licences_are_told_apart(spark):
    wanted = {
        "Licensed under CC BY 4.0.": "cc-by", "Released under the BSD License": "bsd", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "Released under MIT License": "mit",
        "Licensed under the Apache License, Version 2.0\nreleased today": "apache-2.0", "released under the apache license": "apache", "licensed under the gpl license version 2 0": "gpl",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated": "mit",
        "# you can redistribute it and/or modify\n# it under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation": "gpl,lgpl",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa", "er kam mit dem Hund released under the license": "",
        "This work is dedicated to the public domain": "public-domain", "mit " * 30 + "released under the license": "mit",
    }
    docs = spark.createDataFrame([*enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    # 'general public license' is a base phrase, so the lesser one has the base label too
    assert got == dict(enumerate(wanted.values()))


def naive_licenses(text, threshold=licenses.THRESHOLD):
    """(label, containment) of every block of every paragraph."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = {}
    for para in re.split(licenses.GAP, low):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", para)
        for label, wording, tell, bar in licenses.TEMPLATES:
            different, n = set(wording.split()), len(wording.split())
            for i in range(len(words)):
                block = set(words[i : i + n])
                share = len(block & different) / len(different)
                if share >= threshold - 1e-9 and set(tell.split()) <= block and not block & set(bar.split()):
                    found[label] = max(found.get(label, 0), share)
    return found


def test_licenses_against_every_block(spark):
    base = [w for _, text, _, _ in licenses.TEMPLATES for w in text.split()]
    texts = []
    for _ in range(120):
        _, wording, *_ = rnd.choice(licenses.TEMPLATES)
        words = [w if rnd.random() > 0.12 else rnd.choice(base) for w in wording.split()]
        for _ in range(rnd.randrange(3)):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(base))
        around = [rnd.choice(base) for _ in range(rnd.randrange(60))]
        at = rnd.randrange(len(around) + 1)
        texts.append("".join(w + rnd.choice([" ", ", ", "\n", "\n * ", " ", " ", "\n\n" if rnd.random() < 0.1 else " "]) for w in around[:at] + words + around[at:]))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    paras = licenses.scan(docs)
    got = defaultdict(dict)
    for r in licenses.find_templates(paras.selectExpr("doc_id as row", "explode(paras) as words")).collect():
        got[r.row][r.label] = max(got[r.row].get(r.label, 0), r.containment)
    assert [got[i] for i in range(len(texts))] == [pytest.approx(naive_licenses(t)) for t in texts]
    assert len({label for found in got.values() for label in found}) > 12


def test_vocabulary_size_is_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vocab, "MAX_BYTES", 3)
    path = tmp_path / "v"
    path.write_bytes(b"12345")
    with pytest.raises(ValueError):
        vocab.send(spark, str(path))
