"""Entries of a printed table of contents, their pages, and the nodes made of them."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import common_length, match_key, title_similarity
from ..functions.text import CHAPTER, NUM, VOLUME, has_cjk, lit, normalize, squeeze, units
from .layout import same_rows
from .ocr import fragments

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What an entry begins with, and the numerals that OCR puts before it.
ENTRY = f"^(绪论|尾声|后记|附录|第{NUM}+[卷章])"
LEADING = "^[一二三四五六七八九十]+(?=第?[^0-9])"
#: Running headers: what pages of contents are headed, and one that a book of the tests has; ``headers`` arguments change them.
HEADERS = ("目录", "世界文字发展史")
ALIKE, FRONT_PAGES, FIRST_LINES = 0.74, 60, 8


def clean_title(c: Column) -> Column:
    return normalize(F.regexp_replace(F.regexp_replace(normalize(c), "：", ":"), LEADING, ""))


def display_title(c: Column) -> Column:
    value = F.regexp_replace(normalize(c), ":", "：")
    return F.when(has_cjk(value), squeeze(value)).otherwise(value)


def preferred_title(entry: Column, confirmed: Column) -> Column:
    """The entry's title, or the page's where that extends a volume's, an appendix's or an afterword's."""
    a, b = squeeze(normalize(entry)), squeeze(normalize(confirmed))
    better = (a.isin("附录", "后记") | (a.rlike(VOLUME) & (units(b) > units(a)))) & b.startswith(a) & (F.coalesce(confirmed, F.lit("")) != "")
    return F.when(better, display_title(confirmed)).otherwise(display_title(entry))


def entry_level(title: Column) -> Column:
    return F.when(squeeze(normalize(title)).rlike(CHAPTER), 2).otherwise(1)


def _compact(c: Column) -> Column:
    return squeeze(normalize(c))


def is_page_number(text: Column, x0: Column, page_width: Column) -> Column:
    return _compact(text).rlike("^[0-9]{1,4}$") & (x0 / F.greatest(page_width, lit(1)) >= lit(0.72))


def _joined(parts: Column) -> Column:
    """Texts of structs (x0, line_seq, text), from left to right."""
    return clean_title(F.array_join(F.transform(F.array_sort(parts), lambda p: normalize(p["text"])), ""))


def contents_rows(lines: DataFrame, headers: tuple[str, ...] = HEADERS) -> DataFrame:
    """doc_id, line_seq, title, level, printed_page, source_page_index, y, confidence of every page's rows.

    ``lines``: OCR lines (doc_id, page_index, line_seq, text, x0..y1, confidence) with their ``page_width``. A page number at
    the right is joined to what stands to its left in its row; a volume's heading needs no number.
    """
    number = is_page_number(F.col("text"), F.col("x0"), F.col("page_width"))
    known = lines.withColumn("number", number).filter(F.col("number") | ~_compact(F.col("text")).isin(*headers))
    page, height = ["doc_id", "page_index"], lambda r: F.col(f"{r}.y1") - F.col(f"{r}.y0")
    row = F.struct("line_seq", "text", "x0", "y0", "x1", "y1", "confidence")
    right = known.filter("number").select(*page, row.alias("n"))
    left = known.filter("not number").select(*page, row.alias("t"))
    apart = F.abs((F.col("n.y0") + F.col("n.y1")) / 2 - (F.col("t.y0") + F.col("t.y1")) / 2)
    beside = (F.col("t.x1") < F.col("n.x0") - 4) & (apart <= F.greatest(lit(8), F.least(height("n"), height("t")) * lit(0.9)))
    held = F.collect_list(F.struct(F.col("t.x0"), F.col("t.line_seq"), F.col("t.text")))
    own = F.when(F.col("n.confidence").isNotNull(), 1).otherwise(0)
    sure = F.coalesce(F.try_divide(F.coalesce(F.col("n.confidence"), lit(0)) + F.coalesce("total", lit(0)), (own + F.col("told")).cast("double")), lit(0.75))
    numbered = (
        right.join(left, page).filter(beside).groupBy(*page, "n").agg(held.alias("parts"), F.sum("t.confidence").alias("total"), F.count("t.confidence").alias("told"))
        .select("doc_id", "n.line_seq", _joined(F.col("parts")).alias("title"), _compact(F.col("n.text")).cast("int").alias("printed_page"), "page_index", F.col("n.y0").alias("y"), sure.alias("confidence"))
    )
    centre = (F.col("x0") + F.col("x1")) / 2 / F.greatest(F.col("page_width"), lit(1))
    middle = known.filter(~F.col("number") & centre.between(lit(0.18), lit(0.82))).select(*page, "line_seq", "text", "x0", "y0", "x1", "y1", "confidence")
    rows = same_rows(middle).groupBy(*page, "row_id").agg(F.min("line_seq").alias("line_seq"), _joined(F.collect_list(F.struct("x0", "line_seq", "text"))).alias("title"), F.min("y0").alias("y"), F.coalesce(F.avg("confidence"), lit(0.75)).alias("confidence"))
    volumes = rows.filter(_compact(F.col("title")).rlike(VOLUME)).select("doc_id", "line_seq", "title", F.lit(None).cast("int").alias("printed_page"), "page_index", "y", "confidence")
    both = numbered.filter("title <> ''").unionByName(volumes)
    level = F.when(F.col("printed_page").isNull(), 1).otherwise(entry_level(F.col("title")))
    return both.select("doc_id", "line_seq", "title", level.alias("level"), "printed_page", F.col("page_index").alias("source_page_index"), "y", "confidence")


def contents_extent(pages: DataFrame, lines: DataFrame, rows: DataFrame, front_pages: int = FRONT_PAGES) -> DataFrame:
    """doc_id, start_page, content_end, scan_end of documents whose first pages hold a table of contents.

    It starts at the first page titled so. It ends before a later list of figures, else before the first page without rows
    after one with rows, else with the pages. content_end is null where no page has rows.
    """
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "line_seq"))).filter(F.col("nth") <= FIRST_LINES)
    titles = first.groupBy("doc_id", "page_index").agg(F.bool_or(_compact(F.col("text")) == "目录").alias("main"), F.bool_or(_compact(F.col("text")) == "图表目录").alias("figures"))
    filled = rows.select("doc_id", F.col("source_page_index").alias("page_index")).distinct().withColumn("filled", F.lit(True))
    flags = pages.select("doc_id", "page_index").filter(F.col("page_index") < front_pages).join(titles, ["doc_id", "page_index"], "left").join(filled, ["doc_id", "page_index"], "left").na.fill(False)
    doc, at = Window.partitionBy("doc_id"), F.col("page_index")
    least = lambda cond: F.min(F.when(cond, at)).over(doc)
    seen = flags.withColumn("start", least(F.col("main"))).withColumn("figures_at", least(F.col("figures") & (at > F.col("start")))).withColumn("from", least(F.col("filled") & (at >= F.col("start")))).withColumn("gap", least(~F.col("filled") & (at > F.col("from"))))
    told = seen.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("start", "figures_at", "from", "gap")], F.max(at).alias("last")).filter("start is not null")
    by_figures = F.col("figures_at").isNotNull() & (F.col("gap").isNull() | (F.col("figures_at") < F.col("gap")))
    end = F.when(by_figures, F.col("figures_at") - 1).when(F.col("from").isNotNull(), F.coalesce(F.col("gap") - 1, "last"))
    return told.select("doc_id", F.col("start").alias("start_page"), end.alias("content_end"), F.when(by_figures, F.col("figures_at")).otherwise(end).alias("scan_end"))


def structural_entries(entries: DataFrame) -> DataFrame:
    """doc_id, entry_seq, title, level, printed_page, source_page_index, y, confidence.

    The first entry of each heading in reading order. A volume without a printed page takes the next entry's less two, at
    least 1; others take that of the entry before.
    """
    read = [F.col("source_page_index"), F.col("y"), F.col("printed_page").asc_nulls_last(), F.col("line_seq")]
    key = F.regexp_extract(squeeze(F.col("title")), ENTRY, 1)
    titled = entries.withColumn("title", clean_title(F.col("title"))).withColumn("key", key).filter(F.col("key") != "")
    once = titled.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(*read))).filter("nth = 1")
    doc = Window.partitionBy("doc_id").orderBy(*read)
    after = F.first("printed_page", ignorenulls=True).over(doc.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("printed_page", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    guess = F.when(squeeze(F.col("title")).rlike(VOLUME) & after.isNotNull(), F.greatest(F.lit(1), after - 2)).otherwise(before)
    return once.select("doc_id", (F.row_number().over(doc) - 1).alias("entry_seq"), "title", entry_level(F.col("title")).alias("level"), F.coalesce("printed_page", guess).alias("printed_page"), "source_page_index", "y", "confidence")


def _alike(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Of (match key, compact title): the earlier node's and the later one's."""
    if a[1] in b[1] or b[1] in a[1]:
        return True
    (left, _), (right, _) = a, b
    if not left or not right:
        return False
    if left in ("附录", "后记") and right.startswith(left):
        return True
    if left in right or right in left:
        n, m = sorted(len(x.encode("utf-16-le")) for x in (left, right))
        return n / m >= ALIKE
    # The common subsequence is no longer than the shorter key.
    return 2 * min(len(left), len(right)) / (len(left) + len(right)) >= ALIKE and 2 * common_length(left, right) / (len(left) + len(right)) >= ALIKE


def _deduped(schema: list[str]):
    """Batches sorted by page, level and title to the nodes kept, with ``slot`` within their page."""

    def pages(batches):
        key, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != key:
                    if held:
                        yield held
                    key, held = row[:2], []
                held.append(row)
        if held:
            yield held

    def kept(page: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for row in page:
            name = row[-2:]
            at = next((k for k, old in enumerate(out) if _alike(old[-2:], name)), None)
            if at is None:
                out.append(row)
            elif len(name[1].encode("utf-16-le")) > len(out[at][-1].encode("utf-16-le")):
                out[at] = row
        return [(*row[2:-2], k) for k, row in enumerate(out)]

    def run(batches):
        rows: list[tuple] = []
        names = None

        def batch_of():
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def seen():
            nonlocal names, kinds
            for b in batches:
                if names is None:
                    names, kinds = [*schema, "slot"], [*b.schema.types[2:-2], pa.int32()]
                yield b

        kinds = None
        for page in pages(seen()):
            rows += kept(page)
            if len(rows) >= 8192:
                yield batch_of()
                rows = []
        if rows:
            yield batch_of()

    return run


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without those like an earlier one of their page; the longer title of the two takes its place. Adds ``node_seq``.

    Pages are read by level, then title in the order of Unicode's collation.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes)
    keyed = nodes.select(F.col("doc_id").alias("_doc"), F.col("page_index").alias("_page"), "*", match_key(F.col("title")).alias("_key"), squeeze(normalize(F.col("title"))).alias("_compact"))
    read = keyed.repartition("_doc", "_page").sortWithinPartitions("_doc", "_page", "level", F.collate("title", "UNICODE"), "title")
    slots = read.mapInArrow(_deduped(nodes.columns), f"{schema}, slot int")
    return slots.withColumn("node_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "slot")) - 1).drop("slot")


# What front matter is headed, and numerals that are no title.
FRONT_TITLES = ("作者简介", "目录", "图表目录", "序言", "第二版序言", "第三版序言")
LONE = tuple("一二三四五六七八九十上下")
FRONT_LINES, TAIL_PAGES = 12, 8


def is_noise(text: Column, headers: tuple[str, ...] = HEADERS) -> Column:
    name = _compact(text)
    return (name == "") | name.rlike("^[0-9]+$") | name.isin(*headers) | name.isin(*LONE)


def top_lines(lines: DataFrame, headers: tuple[str, ...] = HEADERS) -> DataFrame:
    """Lines in the upper part of their page and not at its sides, without noise."""
    centre = (F.col("x0") + F.col("x1")) / 2 / F.greatest("page_width", lit(1))
    return lines.filter((F.col("y0") / F.greatest("page_height", lit(1)) <= lit(0.42)) & ~is_noise(F.col("text"), headers) & centre.between(lit(0.08), lit(0.92)))


def page_titles(lines: DataFrame, headers: tuple[str, ...] = HEADERS) -> DataFrame:
    """doc_id, page_index, ord, title: what a page's title may be.

    Heading fragments, then rows whose lines are put together, then structural headings with the line below; the first of
    each title counts. ``lines``: coerced OCR lines with their ``page_width``.
    """
    page, top = ["doc_id", "page_index"], top_lines(lines, headers)
    by_page = lambda *order: Window.partitionBy(*page).orderBy(*order)
    pieces = fragments(top).select(*page, F.lit(0).alias("gen"), F.row_number().over(by_page("y0", "x0", units(F.col("text")), "single", "line_seq")).alias("nth"), clean_title(F.col("text")).alias("title"))
    rows = same_rows(top).groupBy(*page, "row_id").agg(_joined(F.collect_list(F.struct("x0", "line_seq", "text"))).alias("title")).select(*page, F.lit(1).alias("gen"), F.col("row_id").alias("nth"), "title")
    order = by_page("y0", "x0", "line_seq")
    part = F.struct("x0", "line_seq", "text")
    near = top.select(*page, "text", "y1", "height", part.alias("a"), F.lead(part).over(order).alias("b"), F.lead("y0").over(order).alias("below"), F.row_number().over(order).alias("nth"))
    near = near.filter(F.col("b").isNotNull() & _compact(F.col("text")).rlike(ENTRY) & (F.col("below") - F.col("y1") <= F.greatest(lit(44), F.col("height") * lit(2.2))))
    both = near.select(*page, F.lit(2).alias("gen"), "nth", _joined(F.array("a", "b")).alias("title"))
    told = pieces.unionByName(rows).unionByName(both).filter((F.col("title") != "") & ~is_noise(F.col("title"), headers))
    once = told.withColumn("again", F.row_number().over(Window.partitionBy(*page, _compact(F.col("title"))).orderBy("gen", "nth"))).filter("again = 1")
    return once.select(*page, (F.row_number().over(by_page("gen", "nth")) - 1).alias("ord"), "title")


def _found(nodes: DataFrame, sure: float) -> DataFrame:
    return nodes.select("doc_id", display_title(F.col("title")).alias("title"), F.lit(1).alias("level"), "page_index", lit(sure).alias("confidence"), F.lit("rule").alias("source"))


def front_nodes(lines: DataFrame) -> DataFrame:
    """Nodes of front matter's titles among the first lines of a page. A title of contents at the very top is a running header."""
    name = _compact(F.col("text"))
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "line_seq"))).filter(F.col("nth") <= FRONT_LINES)
    return _found(first.filter(name.isin(*FRONT_TITLES) & ~((name == "目录") & (F.col("y0") < lit(60)))).withColumnRenamed("text", "title"), 0.9)


def tail_nodes(titles: DataFrame) -> DataFrame:
    """Nodes of afterwords, appendices and lists among page titles."""
    name = _compact(F.col("title"))
    return _found(titles.filter((name == "后记") | name.startswith("附录") | name.endswith("目录")), 0.82)


def page_offset(entries: DataFrame, titles: DataFrame, starts: DataFrame, pages: int = 80, anchors: int = 6) -> DataFrame:
    """doc_id, found_page, page_offset: where a document's first headings stand, and its printed pages' distance from that.

    ``entries`` as ``structural_entries`` returns them; ``titles``: doc_id, page_index, ord, title of the headings that a page
    may have; ``starts``: doc_id, start_page. The search ends with the first page that holds a near-certain match.
    """
    name = _compact(F.col("title"))
    held = entries.filter(F.col("printed_page").isNotNull() & (name.startswith("绪论") | name.rlike(VOLUME) | name.rlike(CHAPTER)))
    first = held.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry_seq")) - 1).filter(F.col("nth") < anchors)
    first = first.select("doc_id", "nth", "printed_page", F.col("title").alias("wanted"))
    near = titles.join(starts, "doc_id").withColumn("least", F.greatest(F.lit(0), F.col("start_page"))).filter((F.col("page_index") >= F.col("least")) & (F.col("page_index") < F.col("least") + pages))
    like = near.join(first, "doc_id").groupBy("doc_id", "page_index", "nth", "printed_page").agg(F.max(title_similarity(F.col("wanted"), F.col("title"))).alias("similarity"))
    scored = like.filter(F.col("similarity") >= lit(0.62)).withColumn("score", F.col("similarity") - lit(0.01) * F.col("nth"))
    sure = scored.withColumn("stop", F.min(F.when(F.col("score") >= lit(0.86), F.col("page_index"))).over(Window.partitionBy("doc_id")))
    best = sure.filter(F.col("stop").isNull() | (F.col("page_index") <= F.col("stop"))).groupBy("doc_id").agg(F.max_by(F.struct("page_index", "printed_page"), F.struct("score", -F.col("page_index"), -F.col("nth"))).alias("b"))
    return best.select("doc_id", F.col("b.page_index").alias("found_page"), (F.col("b.page_index") + 1 - F.col("b.printed_page")).alias("page_offset"))


def confirmed_nodes(entries: DataFrame, offsets: DataFrame, titles: DataFrame, page_counts: DataFrame, window: int = 0) -> DataFrame:
    """doc_id, entry_seq, title, level, page_index, confidence, source: entries at the pages that their numbers lead to.

    Of the pages within ``window`` of that, the one with the likest heading counts; without any the page is held inside the
    document. ``offsets`` as ``page_offset`` returns them, ``titles`` as it takes them, ``page_counts``: doc_id, page_count.
    """
    led = entries.filter("printed_page is not null").join(offsets.select("doc_id", "page_offset"), "doc_id").join(page_counts, "doc_id").withColumn("led", F.col("printed_page") + F.col("page_offset") - 1)
    around = led.select("*", F.explode(F.sequence(F.col("led") - window, F.col("led") + window)).alias("page_index")).withColumn("inside", (F.col("page_index") >= 0) & (F.col("page_index") < F.col("page_count")))
    found = around.join(titles.select("doc_id", "page_index", "ord", F.col("title").alias("there")), ["doc_id", "page_index"], "left")
    similarity = F.when(F.col("inside") & F.col("there").isNotNull(), title_similarity(F.col("title"), F.coalesce("there", F.lit("")))).otherwise(lit(0))
    # A page's first heading of the greatest similarity, if that isn't zero; the first such page of the greatest score.
    rated = found.withColumn("similarity", similarity).withColumn("there", F.when(F.col("similarity") > 0, F.col("there")))
    order = F.struct(F.col("inside"), F.round(F.col("similarity") - lit(0.02) * F.abs(F.col("page_index") - F.col("led")), 12), -F.col("page_index"), -F.coalesce("ord", F.lit(0)))
    best = rated.groupBy("doc_id", "entry_seq", "title", "level", "led", "page_count").agg(F.max_by(F.struct("inside", "page_index", "similarity", "there"), order).alias("b"))
    inside = F.greatest(F.lit(0), F.least(F.col("page_count") - 1, F.col("led")))
    sure = F.greatest(lit(0.5), F.least(lit(0.95), lit(0.6) + lit(0.35) * F.col("b.similarity")))
    return best.select("doc_id", "entry_seq", preferred_title(F.col("title"), F.col("b.there")).alias("title"), "level", F.when(F.col("b.inside"), F.col("b.page_index")).otherwise(inside).cast("int").alias("page_index"), sure.alias("confidence"), F.lit("rule").alias("source"))
