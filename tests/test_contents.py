"""Layout, contents entries, similarity and evaluation: expected cases and plain re-computations."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import similarity as M
from folioscope.operators import contents as P
from folioscope.operators import evaluate as E
from folioscope.operators import layout as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc第一") for _ in range(rng.randrange(12))) for _ in range(2))
        assert M.common_length(a, b) == lcs(a, b)


def test_title_similarity(spark):
    pairs = [("附录", "附录一", 0.9), ("附录一", "附录", 2 / 3), ("", "x", 0.0), ("第 一 章!", "第一章", 1.0), ("abcd", "abxd", 0.75), (None, "x", 0.0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(M.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([p[2] for p in pairs])


ITEM = "doc_id long, page_index int, item_seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, font_name string, page_height double, has_eol boolean"


def item(seq, text, x0, y0, x1, size=10.0, eol=False, bold=False):
    return (1, 0, seq, text, float(x0), float(y0), float(x1), y0 + size, size, bold, "F", 100.0, eol)


def test_items_to_lines(spark):
    rows = [item(0, "b", 30, 10, 40), item(1, "a", 10, 11, 29, bold=True), item(2, "c", 50, 12, 60, eol=True), item(3, "d", 70, 13, 80), item(4, "e", 10, 40, 20)]
    got = L.items_to_lines(spark.createDataFrame(rows, ITEM)).orderBy("line_seq").collect()
    assert [(r.text, r.x0, r.x1, r.is_bold) for r in got] == [("ab c", 10, 60, True), ("d", 70, 80, False), ("e", 10, 20, False)]
    assert L.items_to_lines(spark.createDataFrame([], ITEM)).count() == 0


ENTRY = "doc_id long, line_seq int, title string, printed_page int, source_page_index int, y double, confidence double"


def test_printed_pages(spark):
    rows = [(1, i, t, p, 0, float(i), 0.9) for i, (t, p) in enumerate([("第一卷", None), ("一第一章", 5), ("第二卷", None), ("第一章", 9), ("noise", 7)])]
    got = P.structural_entries(spark.createDataFrame(rows, ENTRY)).orderBy("entry_seq").collect()
    assert [(r.title, r.level, r.printed_page) for r in got] == [("第一卷", 1, 3), ("第一章", 2, 5), ("第二卷", 1, 5)]


def test_dedupe(spark):
    rows = [(1, 0, 1, "第一章"), (1, 0, 2, "第一章总论"), (1, 0, 2, "附录"), (1, 1, 1, "第一章"), (2, 0, 1, "")]
    got = P.dedupe_nodes(spark.createDataFrame(rows, "doc_id long, page_index int, level int, title string")).orderBy("doc_id", "node_seq").collect()
    assert [(r.doc_id, r.page_index, r.title) for r in got] == [(1, 0, "第一章总论"), (1, 0, "附录"), (1, 1, "第一章"), (2, 0, "")]


NODE = "doc_id long, node_seq int, title string, level int, page_index int"


def test_evaluation(spark):
    original = spark.createDataFrame([(1, 0, "Intro", 1, 0), (1, 1, "Intro", 1, 1), (1, 2, "Method", 1, 5), (2, 0, "Alone", 1, 0)], NODE)
    made = spark.createDataFrame([(1, 0, "intro!", 1, 0), (1, 1, "Method x", 1, 6), (1, 2, "Other", 1, 9), (3, 0, "New", 1, 0)], NODE)
    got = {r.doc_id: r for r in E.evaluation(original, made).collect()}
    one = got[1]
    assert (one.original_count, one.made_count, one.matched_count, one.exact_page_matches, one.within_1_page, one.recall, one.precision) == (3, 3, 2, 1, 2, 0.667, 0.667)
    assert (got[2].recall, got[2].precision, got[3].recall, got[3].made_count) == (0.0, 0.0, 0.0, 1)
    assert [r.title for r in E.extras(original, made).orderBy("doc_id").collect()] == ["Other", "New"]


OCR = "doc_id long, page_index int, line_seq int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, page_width double"


def ocr(page, seq, text, x0, y0, sure=0.9):
    return (1, page, seq, text, float(x0), float(y0), float(x0 + 40), float(y0 + 14), sure, 595.0)


def extent(spark, lines, pages):
    rows = P.contents_rows(spark.createDataFrame(lines, OCR))
    got = P.contents_extent(spark.createDataFrame([(1, p) for p in range(pages)], "doc_id long, page_index int"), spark.createDataFrame(lines, OCR), rows).collect()
    return [tuple(r) for r in got]


def test_contents_rows(spark):
    lines = [ocr(0, 0, "目录", 120, 50), ocr(0, 1, "第一章", 120, 100, None), ocr(0, 2, "总论", 180, 101), ocr(0, 3, "7", 460, 104, 0.7), ocr(0, 4, "第二卷", 120, 200), ocr(0, 5, "12", 300, 200), ocr(0, 6, "9", 460, 300)]
    got = P.contents_rows(spark.createDataFrame(lines, OCR)).orderBy("y").collect()
    assert [(r.title, r.level, r.printed_page, pytest.approx(r.confidence)) for r in got] == [("第一章总论", 2, 7, 0.8), ("第二卷12", 1, None, 0.9)]


def test_contents_extent(spark):
    row = lambda p: [ocr(p, 1, "第一章", 120, 100), ocr(p, 2, "7", 460, 100)]
    title = [ocr(1, 0, "目 录", 250, 50)]
    assert extent(spark, row(0) + title + row(1) + row(2) + [ocr(3, 0, "x", 9, 9)] + row(4), 6) == [(1, 1, 2, 2)]
    assert extent(spark, title + row(1) + row(2) + [ocr(3, 0, "图表目录", 250, 50)] + row(3), 6) == [(1, 1, 2, 3)]
    assert extent(spark, title + row(1), 2) == [(1, 1, 1, 1)]
    assert extent(spark, title, 4) == [(1, 1, None, None)]
    assert extent(spark, row(0), 2) == []


def test_offset_and_confirmation(spark):
    entry = "doc_id long, entry_seq int, title string, level int, printed_page int"
    entries = spark.createDataFrame([(1, 0, "第一章总论", 2, 1), (1, 1, "第二章方法", 2, 5), (1, 2, "附录", 1, 9), (1, 3, "后记", 1, 99), (1, 4, "尾声", 1, None)], entry)
    titles = spark.createDataFrame([(1, 2, 0, "第一章总论"), (1, 5, 0, "第一章总"), (1, 6, 0, "x"), (1, 6, 1, "第二章 方法"), (1, 10, 0, "附录一"), (1, 70, 0, "第二章方法"), (2, 3, 0, "第一章总论")], "doc_id long, page_index int, ord int, title string")
    starts = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, start_page int")
    offsets = P.page_offset(entries, titles, starts)
    # Page 5 is like the first entry by .8 only, page 6 the second entry by 1 less .01.
    assert [tuple(r) for r in offsets.collect()] == [(1, 6, 2)]
    counts = spark.createDataFrame([(1, 20)], "doc_id long, page_count int")
    got = P.confirmed_nodes(entries, offsets, titles, counts).orderBy("entry_seq").collect()
    assert [(r.title, r.page_index, pytest.approx(r.confidence)) for r in got] == [("第一章总论", 2, 0.95), ("第二章方法", 6, 0.95), ("附录一", 10, 0.6 + 0.35 * 0.9), ("后记", 19, 0.6)]


def test_same_row_query(spark, sf_dir):
    import __spark_entry__ as entry

    pages = {}
    for r in entry.queries()["same_row_clusters"](spark, sf_dir).collect():
        pages.setdefault((r.doc_id, r.page_index), []).append(r)
    assert pages
    for rows in pages.values():
        heads = []
        for r in sorted(rows, key=lambda r: ((r.y0 + r.y1) / 2, r.x0, r.line_seq)):
            fit = [k for k, c in enumerate(heads) if abs(c - (r.y0 + r.y1) / 2) <= max(8.0, r.y1 - r.y0)]
            if not fit:
                heads.append((r.y0 + r.y1) / 2)
            assert r.row_id == (fit[0] if fit else len(heads) - 1)
