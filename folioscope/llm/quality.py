"""Operator 5, quality rules: a learned decision list of threshold conjunctions, as one Spark conditional expression.

Statistics of every whole text are counted once. Rules are learned by sequential covering from labelled documents: a rule
for "reject" grows condition by condition by information gain on two thirds of the rows, is pruned from its end on the
other third while that doesn't lower its worth, and is taken if its precision on both holds ``MIN_PRECISION``; the rows it
covers go and the next one grows. The list is ``when(rule, false) ... otherwise(true)``: it runs in the JVM and can be read.

At most ``SAMPLE`` labelled documents, chosen by a hash of their ids, reach the driver, eleven numbers each: the bound of
what the fit sees. Everything else covers all rows. Without labels of both kinds the list is empty, and the
base rule alone decides.

A null text has no words and fails the base rule. Labels with a null in id or quality don't count, and a document with
several labels counts with each. Null ids and repeated rows keep a row each. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, durable, id_text, numbered, only_rows, ship

SAMPLE = 20_000
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 0.95, 0.002, 12, 4
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: Rates that conditions are about: (numerator, denominator).
RATES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"), "distinct": ("n_distinct", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "symbols_a_char": ("n_symbols", "word_chars"),
}


def repeated_words(ids: np.ndarray, kinds: int, size: int = WINDOW) -> int:
    """How many words stand in windows of ``size`` that occur twice or more. Windows are compared as numbers without loss."""
    if len(ids) < size + 1:
        return 0
    bits, key = max(1, (kinds - 1).bit_length()), ids
    for k in range(1, size):
        if key is not ids and bits * (k + 1) > 63 or bits * 2 > 63:
            key = np.unique(key, return_inverse=True)[1]  # number the windows so far anew
            width = max(1, int(key.max()).bit_length())
            key = (key[: len(ids) - k] << bits | ids[k:]) if width + bits <= 63 else np.unique(np.stack([key[: len(ids) - k], ids[k:]]), axis=1, return_inverse=True)[1]
        else:
            key = key[: len(ids) - k] << bits | ids[k:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text."""
    text = text or ""
    words = text.encode().split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    count = text.count
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.encode().count, _UPPER))
    return (
        len(words), len(text) - sum(map(count, WHITE)), sum(map(count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(number)),
        len(lines), len(number), upper, sum(map(count, "0123456789")), count("!") + count("?"),
    )


_UPPER = [bytes([b]) for b in range(65, 91)]


def _counted(batches):
    for b in batches:
        rows = list(zip(*map(statistics, (t.as_py() for t in b.column(1))), strict=True)) or [()] * len(COUNTS)
        others = [c for c in b.schema.names if c != "text"]
        yield pa.record_batch([*(b.column(c) for c in others), *(pa.array(c, pa.int64()) for c in rows)], names=[*others, *COUNTS])


def rates(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a] / (np.maximum(counts[b], 1) if b else 1.0) for k, (a, b) in RATES.items()}


def _rate(name: str) -> Column:
    a, b = RATES[name]
    return F.col(a).cast("double") / (F.greatest(F.col(b), F.lit(1)).cast("double") if b else F.lit(1.0))


Rule = list[tuple[str, str, float]]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, side, cut in rule:
        out &= x[name] > cut if side == ">" else x[name] <= cut
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition with the most information gained over the rows inside."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return 0.0, None
    base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for name, values in x.items():
        v, b = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        p = np.cumsum(b)[ends]
        n = ends + 1 - p
        for side, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (name, side, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered list of rules, each of which rejects what it covers."""
    fold = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    least = max(5, MIN_COVER * len(bad))
    worth = lambda rule, rows: (lambda c: (bad[c].sum() - (~bad[c]).sum()) / max(1, c.sum()))(covers(rule, x) & rows)
    sure = lambda c: bad[c].sum() >= MIN_PRECISION * c.sum()
    while len(rules) < MAX_RULES and (bad & left).sum() >= least:
        rule: Rule = []
        inside = left & fold
        while len(rule) < MAX_CONDITIONS and not (bad[inside].all() if inside.any() else True):
            _, condition = _best_condition(x, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= covers([condition], x)
        while len(rule) > 1 and worth(rule[:-1], left & ~fold) >= worth(rule, left & ~fold):
            rule = rule[:-1]
        covered = covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        if covered.sum() < least or not (sure(covered & fold) and sure(covered & ~fold)):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def expression(rules: list[Rule]) -> Column:
    """True where no rule rejects."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, side, cut in rule:
            test &= _rate(name) > F.lit(cut) if side == ">" else _rate(name) <= F.lit(cut)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row where ``row_col`` names one, and COUNTS."""
    ship(docs.sparkSession)
    texts = id_text(docs, id_col, text_col, row_col)
    return texts.mapInArrow(_counted, ", ".join(f"{c} long" for c in [*(c for c in texts.columns if c != "text"), *COUNTS]))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from (doc_id, quality 0 or 1) rows; quality 0 is what rules are to reject. Documents that fail the base rule need none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    labelled = stats.filter(~base_failed()).join(known, "doc_id").select("quality", *COUNTS, F.xxhash64("doc_id").alias("_order"))
    if (n := labelled.count()) > sample:  # before rows are sent: each task would send as many as are wanted in all
        labelled = labelled.filter(F.pmod("_order", F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = labelled.orderBy("_order", "quality", *COUNTS).limit(sample).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    return learn(rates({c: rows[c].to_numpy(np.float64) for c in COUNTS}), bad) if bad.any() and not bad.all() else []


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row where ``row_col`` names one, COUNTS, base_failed, kept."""
    stats = durable(text_statistics(docs, id_col, text_col, row_col), "text-statistics")
    verdict = expression(fit(stats, labels, sample))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; every row is judged by its own text, whatever id it has or shares."""
    docs, row = numbered(docs)
    return only_rows(docs, row, quality_rules(docs, labels, row_col=row).filter("kept"))
