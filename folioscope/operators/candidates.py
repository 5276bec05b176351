"""Heading candidates from text lines. Every window and group leads with doc_id, so documents are independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import (
    TEXT_PREFIX,
    candidate_title,
    join_parts,
    lit,
    numbered_level,
    pattern_score,
    position_score,
    semantic_score,
    squeeze,
    style_score,
    top_ratio,
    total_score,
    units,
)

BOX = ("x0", "y0", "x1", "y1")
#: Reading order of fragments: joined ones come before single lines at the same place.
ORDER = ("page_index", "y0", "x0", "single", "line_seq")


def _union(*lines: Column) -> list[Column]:
    return [F.least(*(x["x0"] for x in lines)), F.least(*(x["y0"] for x in lines)), F.greatest(*(x["x1"] for x in lines)), F.greatest(*(x["y1"] for x in lines))]


def heading_fragments(lines: DataFrame) -> DataFrame:
    """Lines with number-only headings joined to the one or two lines below; adds ``single``. One window over a page does it."""
    page = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "line_seq")
    fields = ["text", *BOX, "font_size", "is_bold", "font_name", "page_height", "top_ratio", "line_seq"]
    row = F.struct(*fields, "title")
    seen = lines.withColumn("title", candidate_title(F.col("text"))).select("doc_id", "page_index", "y0", "x0", "line_seq", row.alias("a"), F.lead(row, 1).over(page).alias("b"), F.lead(row, 2).over(page).alias("c"))
    a, b, c = (F.col(x) for x in "abc")
    gap, gap2 = b["y0"] - a["y1"], c["y0"] - b["y1"]
    joins = (
        squeeze(a["title"]).rlike(TEXT_PREFIX) & (a["top_ratio"] <= lit(0.35)) & (b["top_ratio"] <= lit(0.38))
        & (gap >= lit(-2)) & (gap <= F.greatest(lit(50), F.greatest(lit(0), a["y1"] - a["y0"]) * lit(2.4)))
        & (units(b["title"]) <= 32) & (b["font_size"] >= a["font_size"] * lit(0.65))
    )
    extends = (
        (units(c["title"]) <= 24) & (c["font_size"] >= b["font_size"] * lit(0.8)) & (c["font_size"] <= b["font_size"] * lit(1.2))
        & (gap2 >= lit(-2)) & (gap2 <= F.greatest(lit(36), F.greatest(lit(0), b["y1"] - b["y0"]) * lit(2.0)))
        & ~squeeze(c["title"]).rlike("^[一二三四五六七八九十]")
    )
    flagged = seen.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("extends", F.col("joins") & F.coalesce(extends, F.lit(False)))
    before = lambda name, n: F.coalesce(F.lag(name, n).over(page), F.lit(False))
    flagged = flagged.withColumn("gone", F.col("joins") | before("joins", 1) | before("extends", 2))
    first_text = join_parts(a["title"], b["title"])

    def joined(text: Column, *parts: Column) -> Column:
        x0, y0, x1, y1 = _union(*parts)
        bold, name = parts[0]["is_bold"], parts[0]["font_name"]
        for p in parts[1:]:
            bold, name = bold | p["is_bold"], F.when(name != "", name).otherwise(p["font_name"])
        return F.struct(text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.greatest(*(p["font_size"] for p in parts)).alias("font_size"), bold.alias("is_bold"), name.alias("font_name"), a["page_height"].alias("page_height"), top_ratio(y0, a["page_height"]).alias("top_ratio"), a["line_seq"].alias("line_seq"), F.lit(0).alias("single"))

    alone = F.struct(*(a[f].alias(f) for f in fields), F.lit(1).alias("single"))
    both = F.when(F.col("extends"), joined(join_parts(candidate_title(first_text), c["title"]), a, b, c)).when(F.col("joins"), joined(first_text, a, b))
    out = F.filter(F.array(both, F.when(~F.col("gone"), alone)), lambda x: x.isNotNull())
    return flagged.select("doc_id", "page_index", F.explode(out).alias("f")).select("doc_id", "page_index", "f.*")


def body_font(fragments: DataFrame) -> DataFrame:
    """doc_id, body_size (the most frequent, the least of equals, 12 if none), body_name ('' if none; the first of equals).

    Lines are counted once by size and name; what is left of a document is a few sizes and names, looked at in an array.
    """
    counted = fragments.groupBy("doc_id", "font_size", "font_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    told = counted.groupBy("doc_id").agg(F.collect_list(F.struct("font_size", "font_name", "n", "first")).alias("p"))
    rounded = lambda size: F.floor(size * lit(10) + lit(0.5)).cast("double") / lit(10)
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sized = F.filter("p", lambda x: x["font_size"] > lit(0))
    sizes = F.transform(F.array_distinct(F.transform(sized, lambda x: rounded(x["font_size"]))), lambda r: F.struct(-total(F.filter(sized, lambda x: rounded(x["font_size"]) == r)), r.alias("size")))
    body = told.select("doc_id", "p", F.coalesce(F.array_min(sizes)["size"], lit(12)).alias("body_size"))
    near = F.filter("p", lambda x: (F.abs(x["font_size"] - F.col("body_size")) <= lit(1)) & (x["font_name"] != ""))
    of = lambda name: F.filter(near, lambda x: x["font_name"] == name)
    names = F.transform(F.array_distinct(F.transform(near, lambda x: x["font_name"])), lambda name: F.struct(-total(of(name)), F.array_min(F.transform(of(name), lambda x: x["first"])), name.alias("name")))
    return body.select("doc_id", "body_size", F.coalesce(F.array_min(names)["name"], F.lit("")).alias("body_name"))


def scored_lines(fragments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines of fitting length that are candidates, at most so many a page in reading order, with their four scores and the total."""
    rules = config.rules
    titled = fragments.withColumn("text", candidate_title(F.col("text"))).filter(units(F.col("text")).between(rules.min_line_chars, rules.max_line_chars))
    sized = titled.join(body_font(fragments), "doc_id")
    changed = (F.col("body_name") != "") & (F.col("font_name") != F.col("body_name"))
    scored = (
        sized.withColumn("style_score", style_score(F.col("font_size"), F.col("body_size"), F.col("is_bold"), changed))
        .withColumn("position_score", position_score(F.col("top_ratio")))
        .withColumn("pattern_score", pattern_score(F.col("text")))
        .withColumn("semantic_score", semantic_score(F.col("text")))
        .filter((F.col("style_score") >= lit(rules.min_style_candidate)) | (F.col("pattern_score") >= lit(rules.min_pattern_candidate)) | (F.col("semantic_score") >= lit(rules.min_semantic_candidate)))
    )
    page = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "single", "line_seq")
    capped = scored.withColumn("nth", F.row_number().over(page)).filter(F.col("nth") <= rules.max_candidates_per_page).drop("nth")
    return capped.withColumn("total_score", total_score(config.score_weights, *(F.col(f"{k}_score") for k in ("style", "position", "pattern", "semantic"))))


def candidates(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Candidates with their level hints: the numbering's level, else the rank of the font size."""
    scored = scored_lines(heading_fragments(lines), config)
    bucket = F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("font_size").desc())))
    hint = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(numbered_level(F.col("text")), bucket)))
    return scored.withColumn("bucket", bucket).withColumn("level_hint", hint).withColumn("source", F.lit("text"))


def rule_stats(scored: DataFrame) -> DataFrame:
    """The mean of each score of a document's candidates."""
    return scored.groupBy("doc_id").agg(*(F.round(F.avg(f"{k}_score"), 9).alias(f"avg_{k}_score") for k in ("style", "position", "pattern", "semantic", "total")))


def accepted(config: Config = DEFAULT) -> Column:
    """Whether a candidate's scores are high enough."""
    high = config.thresholds.high
    front = (F.col("semantic_score") >= lit(0.6)) & (F.col("position_score") >= lit(0.6))
    text = (front & (F.col("style_score") >= lit(0.45))) | (F.col("total_score") >= lit(high)) | ((F.col("pattern_score") >= lit(1)) & (F.col("style_score") >= lit(0.5)))
    ocr = (front & (F.col("total_score") >= lit(0.5))) | (F.col("total_score") >= lit(max(high, 0.85)))
    return F.when(F.col("source") == "ocr", ocr).otherwise(text)
