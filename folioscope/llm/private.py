"""Operator 7, personal data: four base patterns, and identifiers found by bootstrapped context.

Base spans (email, ip, card, phone) come from regular expressions, leftmost and without overlap for each kind.

The method then works as bootstrapping does. Every token with several digits or an @ is a candidate with what stands around
it. Seeds are the base entities, and hexadecimal tokens of 32 digits or more for the fifth kind, secrets, which has no base
pattern: a seed of it is a span only where a trusted pattern holds it. Seeds induce lexical patterns: the two tokens
before, the three before, the one before and the one after, the two after; each with the candidate's shape class, and only
if a letter or digit is among them. Context tokens are runs of letters and digits, of which the ``NEAR`` characters next
to the candidate count, and single marks; however far off they stand, nothing else bounds a context.
Candidates and patterns form a graph of distinct (pattern, instance) edges. Spark
scores it in rounds. An instance has the kind and confidence of its best trusted pattern; seeds stay 1. A pattern's
confidence for a kind is what its instances score for it, over that, what they score for other kinds, and ``DOUBT`` for
each instance (or the rest of its score) of which nothing is known. It is trusted with a confidence of at least ``TRUST``
over at least ``SUPPORT`` instances: seeds in the first round, and what trusted patterns found from the second on, so that
identifiers found in one context lead to the next. After the rounds, candidates outside all base spans in the context of a
trusted pattern are spans of the pattern's kind.
Instances and patterns are hashed to 64 bits; scores are sums and counts, so a pattern that a third of all candidates
share is added up partially before it moves.

Positions are code points, ends exclusive. Null text is empty: no spans. Null ids and repeated rows keep a row each, an
empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, id_text, numbered, ship, spare

KINDS = ("email", "ip", "card", "phone")
#: All kinds that a span may have.
NAMES = (*KINDS, "secret")
SECRET, NEAR = 4, 32
TRUST, SUPPORT, ROUNDS = 0.9, 5, 3
#: What an instance of unknown kind weighs against a pattern.
DOUBT = 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9@+(][A-Za-z0-9@._%+()/-]{5,}")
_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind as a place in KINDS), sorted by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def spell(spans) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, b, k in spans)


def _hash(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\x00".join(parts))
    return h - (1 << 64) if h >> 63 else h


def shape(token: str) -> str:
    """The token's shape class, which says what kind it could be: with an @, four short runs of digits, digits of a card's or a phone's number, fewer, or letters as well. Tokens of one class compete for a pattern."""
    if "@" in token:
        return "@"
    if any(c.isalpha() for c in token):
        return "a9"
    runs = _DIGITS.findall(token)
    if len(runs) == 4 and token.count(".") == 3 and "." not in (token[0], token[-1]) and max(map(len, runs)) <= 3 and "+" not in token:
        return "9.9.9.9"
    n = sum(map(len, runs))
    return "+9" if "+" in token or 7 <= n < 14 else "9-9" if n >= 14 else "9"


def context(text: str, tokens: list[tuple[int, int]], starts: list[int], a: int, b: int) -> list[tuple[str, ...]]:
    """The patterns around text[a:b] but for its shape; ``tokens`` are all of the text's."""
    k = bisect_left(starts, a)
    before = [text[max(x, min(y, a) - NEAR) : min(y, a)].lower() for x, y in tokens[max(0, k - 3) : k]]
    k = bisect_left(starts, b)
    if k and tokens[k - 1][1] > b:
        k -= 1
    after = [text[max(x, b) : min(y, max(x, b) + NEAR)].lower() for x, y in tokens[k : k + 2]]
    wanted = [("2", *before[-2:])] if len(before) >= 2 else []
    wanted += [("3", *before)] if len(before) == 3 else []
    wanted += [("1+1", before[-1], *after[:1])] if before else []
    wanted += [("+2", *after)] if len(after) == 2 else []
    return [w for w in wanted if any(x[0].isalnum() for x in w[1:])]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, instance, patterns): the base spans, and tokens outside them with four digits or an @."""
    spans = [(a, b, k) for a, b, k in base]
    if "@" in text or _DIGIT.search(text):
        taken = iter([*base, (len(text) + 1, len(text) + 1, 0)])
        a, b, _ = next(taken)
        for m in _CANDIDATE.finditer(text):
            while b <= m.start():
                a, b, _ = next(taken)
            token = m[0].rstrip(".-/()")
            if m.start() + len(token) <= a and len(token) >= 6 and ("@" in token or len(_DIGIT.findall(token)) >= 4):
                spans.append((m.start(), m.start() + len(token), SECRET if _HEX.fullmatch(token) and not token.isdigit() else -1))
    if not spans:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, out = [x for x, _ in tokens], []
    for a, b, k in spans:
        token = text[a:b]
        like = shape(token)
        out.append((a, b, k, _hash(token), [_hash(p[0], like, *p[1:]) for p in context(text, tokens, starts, a, b)]))
    return out


FOUND = "doc_id long, row long, base array<struct<a:int,b:int,k:int>>, base_sha256 string, candidates array<struct<a:int,b:int,k:int,instance:long,patterns:array<long>>>"
_SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int32())])
_CAND = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _found(batches):
    nth = TaskContext.get().partitionId() << 33
    for b in batches:
        base, sha, cand, row = [], [], [], b.column(2).to_pylist() if b.num_columns > 2 else []
        for t in b.column(1):
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append([{"a": x, "b": y, "k": k} for x, y, k in spans])
            sha.append(hashlib.sha256(spell(spans).encode()).hexdigest())
            cand.append([dict(zip(("a", "b", "k", "instance", "patterns"), c, strict=True)) for c in candidates(text, spans)])
            if b.num_columns == 2:
                row.append(nth)
                nth += 1
        yield pa.record_batch([b.column(0), pa.array(row, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(sha), pa.array(cand, pa.list_(_CAND))], names=["doc_id", "row", "base", "base_sha256", "candidates"])


def trusted_patterns(found: DataFrame, trust: float, support: int, rounds: int) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the bootstrapping trusts."""
    each = found.select(F.explode("candidates").alias("c")).select("c.instance", "c.k", F.explode("c.patterns").alias("pattern"))
    edges = durable(each.groupBy("pattern", "instance").agg(F.max("k").alias("k")), "edges")
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.filter("k >= 0").select("pattern", F.col("k").alias("kind"), F.lit(1.0).alias("score"))
    open_ = edges.filter("k < 0").select("pattern", "instance")
    learned = None
    for _ in range(rounds):
        scored = seeds
        if learned is not None:  # instances that a trusted pattern holds lend their score to their other patterns
            reached = open_.join(learned, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("other"))).alias("best"))
            reached = reached.select("instance", (-F.col("best")["other"]).alias("kind"), F.col("best")["confidence"].alias("score"))
            scored = seeds.unionByName(open_.join(reached, "instance").select("pattern", "kind", "score"))
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("support"))
        known = sums.groupBy("pattern").agg(F.sum("s").alias("known"))
        confidence = F.col("s") / (F.col("known") + DOUBT * (F.col("n") - F.col("known")))
        new = sums.filter(F.col("support") >= support).join(known, "pattern").join(total, "pattern").select("pattern", "kind", confidence.alias("confidence"))
        new = durable(new.filter(F.col("confidence") >= trust), "patterns")
        drop_durable(learned)
        learned = new
    return learned


def private_spans(docs: DataFrame, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, base and all: arrays of (a, b, k: a place in NAMES), and base_sha256. ``row`` tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    found = durable(id_text(docs, id_col, text_col, row_col).mapInArrow(_found, FOUND), "found")
    learned = trusted_patterns(found, trust, support, rounds)
    open_ = found.select("row", F.explode(F.filter("candidates", lambda c: (c["k"] < 0) | (c["k"] == SECRET))).alias("c")).select("row", "c.a", "c.b", F.explode("c.patterns").alias("pattern"))
    best = open_.join(learned, "pattern").groupBy("row", "a", "b").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("k"))
    more = best.groupBy("row").agg(F.collect_list(F.struct("a", "b", "k")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<a:int,b:int,k:int>>"))), lambda x, y: F.when(x["a"] != y["a"], x["a"] - y["a"]).otherwise(x["k"] - y["k"]))
    return found.drop("candidates").join(more, "row", "left").withColumn("all", both).drop("more")


def _name(k):
    return F.get(F.array(*(F.lit(n) for n in NAMES)), k)


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_spans."""
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spelt = F.array_join(F.transform("all", lambda s: F.concat(_name(s["k"]), F.lit(":"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")
    return spans.select("doc_id", *counts, "base_sha256", spelt.alias("spans"), F.size("all").cast("long").alias("n_spans"))


def masked_text(text, spans):
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first hides both."""
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["b"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.when(s["a"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("<"), F.upper(_name(s["k"])), F.lit(">"))).otherwise(F.lit(""))).alias("out"),
                s["b"].alias("at"),
            )
        ),
    )
    return F.concat(step["out"], F.substring(text, step["at"] + 1, F.length(text)))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``n_chars`` counted anew where it is there; rows without spans are as they were."""
    columns = docs.columns
    docs, row = numbered(docs)
    held = spare(docs.columns, "spans")
    spans = private_spans(docs, row_col=row).filter(F.size("all") > 0).select(F.col("row").alias(row), F.col("all").alias(held))
    some = F.col(held).isNotNull()
    out = docs.join(spans, row, "left").withColumn("text", F.when(some, masked_text(F.col("text"), F.col(held))).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in columns))
