"""Scalar text functions of the outline engine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that titles are normalised by, numerals, and the words that mark headings.
SPACES = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NUM = "[零一二三四五六七八九十百千万〇0-9]"
CJK = r"[\x{4e00}-\x{9fff}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
KEYWORDS = ("前言", "序", "序言", "绪论", "引言", "目录", "附录", "参考文献", "总结", "封面", "作者简介", "图表目录", "后记", "尾声", "abstract", "contents", "appendix")
TOP_HEADING = f"^(?:第{NUM}+[卷章]|附录|绪论|尾声|后记|封面|作者简介|目录|图表目录|序言|第[二三四五六七八九十]+版序言|参考文献|索引|.*(?:著作|书目|文献).*目录$)"
TOP_LATIN = r"(?i)^(?:chapter [0-9]+|appendix)"
SECTION, SECTION_LATIN = f"^第{NUM}+节", r"(?i)^section [0-9]+"
DECIMAL = r"^([0-9]+(?:\.[0-9]+){0,5})(?: |$)"
TEXT_PREFIX = f"^(?:第{NUM}+[卷章]|绪论|尾声|附录)$"
OCR_PREFIX = f"^(?:第{NUM}+[卷章节]|附录|绪论[:：]?|尾声)$"
VOLUME, CHAPTER, STRUCTURAL = f"^第{NUM}+卷", f"^第{NUM}+章", f"^(第{NUM}+[卷章])"
#: A word ends here; ASCII only, as in the patterns' origin.
END = r"(?![0-9A-Za-z_])"


def lit(x: float) -> Column:
    return F.lit(float(x))


def normalize(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, SPACES + "+", " "))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, SPACES + "+", "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def candidate_title(c: Column) -> Column:
    """Normalised; a title with CJK characters also loses white space and ASCII punctuation."""
    value = normalize(c)
    return F.when(has_cjk(value), F.regexp_replace(squeeze(value), PUNCTUATION + "+", "")).otherwise(value)


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def join_parts(a: Column, b: Column) -> Column:
    """Two parts of a text heading, candidate titles both."""
    return F.when(a == "", b).when(b == "", a).when(has_cjk(a) | has_cjk(b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def join_ocr_parts(a: Column, b: Column) -> Column:
    return F.when(has_cjk(a) | has_cjk(b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def is_top(value: Column) -> Column:
    return value.rlike(TOP_HEADING) | value.rlike(TOP_LATIN + END)


def is_section(value: Column) -> Column:
    return value.rlike(SECTION) | value.rlike(SECTION_LATIN + END)


def pattern_score(value: Column) -> Column:
    """Of a normalised title."""
    return F.when(value == "", lit(0)).when(is_top(value), lit(1)).when(is_section(value), lit(0.9)).when(value.rlike(DECIMAL), lit(1)).otherwise(lit(0))


def semantic_score(title: Column) -> Column:
    """Of a normalised title."""
    value = F.lower(title)
    found = F.lit(False)
    for word in KEYWORDS:
        found |= value.contains(word)
    return F.when(found, lit(0.6)).otherwise(lit(0))


def numbered_level(value: Column) -> Column:
    """The level that a normalised title's numbering tells, or null."""
    parts = F.size(F.split(F.regexp_extract(value, DECIMAL, 1), r"\."))
    return F.when(value == "", F.lit(None).cast("int")).when(is_top(value), F.lit(1)).when(is_section(value), F.lit(2)).when(value.rlike(DECIMAL), F.least(F.lit(6), parts))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(lit(low), F.least(lit(high), c))


def position_score(top_ratio: Column) -> Column:
    r = clamp(top_ratio)
    return F.when(r <= lit(0.2), lit(1)).when(r <= lit(0.4), lit(0.6)).when(r <= lit(0.6), lit(0.3)).otherwise(lit(0.1))


def style_score(size: Column, body: Column, bold: Column, changed: Column) -> Column:
    base = F.when(body > lit(0), body).otherwise(size)
    ratio = F.when(base <= lit(0), lit(1)).otherwise(size / base)
    return clamp(lit(0.6) * clamp((ratio - lit(1)) / lit(0.55)) + lit(0.3) * F.when(bold, lit(1)).otherwise(lit(0)) + lit(0.1) * F.when(changed, lit(1)).otherwise(lit(0)))


def total_score(weights, style: Column, position: Column, pattern: Column, semantic: Column) -> Column:
    return clamp(lit(weights.style) * style + lit(weights.position) * position + lit(weights.pattern) * pattern + lit(weights.semantic) * semantic)


def top_ratio(y0: Column, height: Column) -> Column:
    return F.when(height <= lit(0), lit(1)).otherwise(clamp(y0 / height))
