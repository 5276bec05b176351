"""Cases of the outline operators with expected results, and independence of documents."""

import pytest

from folioscope import config
from folioscope.operators import candidates as C
from folioscope.operators import classify as K
from folioscope.operators import ocr as R
from folioscope.operators import outline as O

SCHEMA = "doc_id long, page_index int, line_seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, font_name string, page_height double, top_ratio double"


def line(doc, page, seq, text, top, size, height=841.89):
    return (doc, page, seq, text, 72.0, float(top), 300.0, float(top + size), float(size), False, "Body", height, top / height)


def outline(spark, rows):
    judged = O.judged(C.candidates(spark.createDataFrame(rows, SCHEMA)))
    nodes = [(r.doc_id, r.title, r.level, r.page_index) for r in O.outline(judged).orderBy("doc_id", "node_seq").collect()]
    return nodes, {(r.title, r.reason) for r in O.rejected(judged).collect()}


TEXT = [
    line(1, 0, 0, "Chapter 1 Introduction", 72, 22), line(1, 0, 1, "This is body text for chapter one.", 120, 12), line(1, 1, 2, "1.1 Background", 72, 18),
    line(1, 1, 3, "Additional body text for section 1.1.", 120, 12), line(1, 1, 4, "1.2 Scope", 300, 18), line(1, 1, 5, "Additional body text for section 1.2.", 348, 12),
]
NODES = [("Chapter 1 Introduction", 1, 0), ("1.1 Background", 2, 1), ("1.2 Scope", 2, 1)]


def test_text_document(spark):
    assert outline(spark, TEXT)[0] == [(1, *n) for n in NODES]


def test_documents_do_not_meet(spark):
    other = [line(2, 0, 0, "Chapter 7 Else", 72, 40), line(2, 0, 1, "body", 120, 30)]
    assert [n for n in outline(spark, TEXT + other)[0] if n[0] == 1] == [(1, *n) for n in NODES]


def test_structural_duplicates_are_rejected_document_wide(spark):
    rows = [line(1, p, p, "第一章", 72, 22) for p in (3, 40)] + [line(1, 3, 90 + i, "正文正文", 400 + 20 * i, 12) for i in range(4)]
    nodes, gone = outline(spark, rows)
    assert [n[3] for n in nodes] == [3] and ("第一章", "duplicate_structural_heading") in gone


def test_number_joins_the_line_below(spark):
    rows = [line(1, 0, 0, "第一章", 72, 20), line(1, 0, 1, "总论", 112, 20)]
    got = C.heading_fragments(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.text, r.y0, r.y1) for r in got] == [("第一章总论", 72.0, 132.0)]


def test_three_stacked_lines_overlap(spark):
    rows = [line(1, 0, 0, "第一卷", 72, 20), line(1, 0, 1, "第一章", 112, 20), line(1, 0, 2, "甲", 152, 20)]
    got = C.heading_fragments(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got) == ["第一卷第一章甲", "第一章甲"]


def test_body_font_prefers_the_smaller_of_equals(spark):
    rows = [line(1, 0, i, "x y", 72 + 20 * i, s) for i, s in enumerate((12, 12, 10, 10))]
    assert C.body_font(C.heading_fragments(spark.createDataFrame(rows, SCHEMA))).first().body_size == 10.0


def test_levels_are_guarded(spark):
    wanted = [3, 4, 1, 5]
    rows = [(1, i, 10.0, 0.0, 1, i, f"t{i}", f"t{i}", None, w, 0.9) for i, w in enumerate(wanted)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, y0 double, x0 double, single int, line_seq int, text string, title string, reason string, level_hint int, total_score double")
    assert [r.level for r in O.outline(df).orderBy("node_seq").collect()] == [1, 2, 1, 2]


def test_classification_limits(spark):
    rows = [(d, p, 50 if p < n else 0) for d, n in ((1, 4), (2, 1), (3, 2)) for p in range(5)]
    pages = spark.createDataFrame(rows, "doc_id long, page_index int, char_count int")
    kinds = K.classify(pages)
    assert {r.doc_id: r.doc_type for r in kinds.collect()} == {1: "text", 2: "scanned", 3: "hybrid"}
    assert {(r.doc_id, r.page_index) for r in K.ocr_pages(pages, kinds).collect()} == {(2, p) for p in range(5)} | {(3, p) for p in (2, 3, 4)}


def test_scanned_page(spark):
    raw = [("Chapter 1 OCR", [80, 80, 420, 200]), ("1.1 OCR Background", [80, 240, 420, 360]), ("Plain body text", [80, 300, 420, 322])]
    rows = [(1, 0, i, t, 2.0, 841.89, *map(float, b), 0.98) for i, (t, b) in enumerate(raw)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, render_scale double, page_height double, bx0 double, by0 double, bx1 double, by1 double, confidence double")
    lines = R.coerce_lines(df)
    assert R.body_height(lines).first().body_height == 11.0
    nodes = O.outline(O.judged(R.ocr_candidates(lines))).orderBy("node_seq").collect()
    assert [(r.title, r.level) for r in nodes] == [("Chapter 1 OCR", 1), ("1.1 OCR Background", 2)]


def test_cover(spark):
    titles = ["目录", "序言", "第一章", "第二章", "第三章"]
    df = spark.createDataFrame([(1, i, t, 1, i + 1, 0.9, "rule") for i, t in enumerate(titles)], "doc_id long, node_seq int, title string, level int, page_index int, confidence double, source string")
    many, few = (spark.createDataFrame([(1, n)], "doc_id long, page_count int") for n in (20, 19))
    assert O.with_cover(df, many).orderBy("node_seq").first().title == "封面" and O.with_cover(df, few).count() == 5


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("thresholds:\n  high: 0.5\n")
    assert config.load(str(path)).thresholds.high == 0.5 and config.load().rules.max_candidates_per_page == 80
    path.write_text("rules:\n  min_line_chars: 1.5\n")
    with pytest.raises(ValueError):
        config.load(str(path))
