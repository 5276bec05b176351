"""Layout views over the driver's ``documents`` table: text lines and OCR lines with made-up geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lit

NUMERALS = "一二三四五六七八九十"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, line_seq, text, x0..y1, font_size, is_bold, font_name, page_height, top_ratio, slot, part.

    Four lines of text make a page. Headings are made up before some of them, of their first words, so such a line is parted
    into up to four; all words of the text stay. ``line_seq`` is four times the line's number plus the part.
    """
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("w", F.split("raw", " "))
    page, slot, cjk = F.floor(F.col("line_no") / 4).cast("int"), F.col("line_no") % 4, F.col("doc_id") % 5 == 0
    numeral = F.substring(F.lit(NUMERALS), page % 10 + 1, F.lit(1))
    named = F.concat(F.lit("第"), numeral, F.when(page % 6 == 0, "卷").otherwise("章"))
    words = lambda first, n=None: F.array_join(F.slice("w", first, F.lit(n) if n else F.size("w")), " ")
    parts = (
        F.when(cjk & (slot == 0) & (page % 2 == 0), F.array(named, words(1, 3), words(4)))
        .when(cjk & (slot == 0), F.array(named, words(1, 2), words(3, 2), words(5)))
        .when(cjk & (slot == 2) & (page == 1), F.array(F.lit("绪论"), F.col("raw")))
        .when(~cjk & (slot == 0), F.array(F.concat(F.lit("Chapter "), (page + 1).cast("string"), F.lit(" "), words(1, 3)), words(4)))
        .when(~cjk & (slot == 2), F.array(F.concat((page + 1).cast("string"), F.lit(".2 "), words(1, 3)), words(4)))
        .otherwise(F.array("raw"))
    )
    out = each.select("doc_id", page.alias("page_index"), slot.alias("slot"), "line_no", cjk.alias("cjk"), F.posexplode(parts).alias("part", "text"))
    heads = (F.col("part") == 0) & (F.col("slot").isin(0) | ((F.col("slot") == 2) & (~F.col("cjk") | (F.col("text") == "绪论"))))
    first = (F.col("part") == 0) & (F.col("slot") == 0)
    short = F.col("cjk") & (F.col("slot") == 0) & ((F.col("part") == 1) | ((F.col("part") == 2) & (F.col("page_index") % 2 == 1)))
    size = F.when(first, lit(22)).when(heads, lit(18)).when(short, lit(16)).otherwise(lit(12))
    y0 = lit(72) + lit(120) * F.col("slot").cast("double") + lit(28) * F.col("part").cast("double")
    out = out.select("*", (F.col("line_no") * 4 + F.col("part")).alias("line_seq"), size.alias("font_size"), first.alias("is_bold"), y0.alias("y0"))
    return out.select(
        "doc_id", "page_index", "line_seq", "text", lit(72).alias("x0"), "y0", (lit(72) + lit(6) * F.length("text").cast("double")).alias("x1"), (F.col("y0") + F.col("font_size")).alias("y1"),
        "font_size", "is_bold", F.when(F.col("is_bold"), "Body-Bold").otherwise("Body").alias("font_name"), lit(792).alias("page_height"), (F.col("y0") / lit(792)).alias("top_ratio"), "slot", "part",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, char_count: characters that aren't white space, four lines to a page."""
    from ..functions.text import squeeze, units

    each = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return each.groupBy("doc_id", F.floor(F.col("line_no") / 4).cast("int").alias("page_index")).agg(F.sum(units(squeeze(F.col("raw")))).cast("int").alias("char_count"))


def ocr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, line_no (on its page), text, render_scale, page_height, bx0..by1 in pixels or null, confidence."""
    held = F.col("doc_id") % 7 != 0
    box = [F.when(held, lit(2) * F.col(c)).alias("b" + c) for c in ("x0", "y0", "x1", "y1")]
    return lines(spark, sf_dir).select("doc_id", "page_index", (F.col("slot") * 4 + F.col("part")).alias("line_no"), "text", lit(2).alias("render_scale"), "page_height", *box, (lit(0.8) + lit(0.02) * (F.col("line_seq") % 10).cast("double")).alias("confidence"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``lines`` as items: doc_id, page_index, item_seq, text, x0..y1, font_size, is_bold, font_name, page_height, has_eol."""
    line = Window.partitionBy("doc_id", "line_seq").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    words = lines(spark, sf_dir).select("*", F.posexplode(F.split("text", " ")).alias("k", "word"))
    each = words.withColumn("x0", lit(72) + lit(6) * F.coalesce(F.sum(F.length("word") + 1).over(line), F.lit(0)).cast("double")).filter(F.trim("word") != "")
    return each.select("doc_id", "page_index", (F.col("line_seq").cast("long") * 1_000_000 + F.col("k")).alias("item_seq"), F.col("word").alias("text"), "x0", "y0", (F.col("x0") + lit(6) * F.length("word").cast("double")).alias("x1"), "y1", "font_size", "is_bold", "font_name", "page_height", F.lit(False).alias("has_eol"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a printed table of contents, made of the volume and chapter lines; every third lacks its printed page."""
    page = F.col("page_index")
    held = lines(spark, sf_dir).filter(F.col("text").startswith("第"))
    return held.select("doc_id", "line_seq", F.when(page % 4 == 1, F.concat(F.lit("一"), F.col("text"))).otherwise(F.col("text")).alias("title"), F.when(page % 3 != 0, page + 3).alias("printed_page"), F.floor(page / 8).cast("int").alias("source_page_index"), F.col("line_seq").cast("double").alias("y"), lit(0.9).alias("confidence"))


def contents_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Made-up pages of contents, twelve headings each and one page of text behind: pages (doc_id, page_index), OCR lines."""
    heads = lines(spark, sf_dir).filter(F.col("text").startswith("第")).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_seq")) - 1)
    page, top = F.floor(F.col("k") / 12).cast("int"), lit(100) + lit(30) * (F.col("k") % 12).cast("double")

    def line(df, at, seq, text, x0, x1, y0, sure):
        return df.select("doc_id", at.cast("int").alias("page_index"), seq.cast("int").alias("line_seq"), text.alias("text"), lit(x0).alias("x0"), y0.alias("y0"), lit(x1).alias("x1"), (y0 + lit(14)).alias("y1"), lit(sure).alias("confidence"), lit(595).alias("page_width"))

    docs = heads.groupBy("doc_id").agg(F.max(page).alias("last"))
    named = line(heads, page, F.col("k") * 2 + 1, F.col("text"), 120, 300, top, 0.9)
    numbered = line(heads.filter("page_index % 3 <> 0"), page, F.col("k") * 2 + 2, (F.col("page_index") + 3).cast("string"), 460, 480, top + lit(3), 0.8)
    title = line(docs, F.lit(0), F.lit(0), F.lit("目 录"), 250, 330, lit(50), 0.9)
    body = line(docs, F.col("last") + 1, F.lit(0), F.lit("body"), 72, 200, lit(72), 0.9)
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("page_index")), named.unionByName(numbered).unionByName(title).unionByName(body)
