"""PDF files: reading and writing, and whole jobs over them, with a backend of the test's for OCR."""

import re
import sys
import zlib

import pytest

from folioscope import __main__ as cli
from folioscope.config import Options
from folioscope.operators import layout as L
from folioscope.plans import pipeline
from folioscope.sources import ocr_command as R
from folioscope.sources import pdf as S
from folioscope.sources import pdffile


def build(pages, packed=False, size=(595, 842), extra=b""):
    """A PDF of pages of (x, baseline, size, bold, text) items; ``packed``: with object and cross-reference streams."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R%s>>" % extra, 2: b"<</Type/Pages/Count %d/MediaBox[0 0 %d %d]/Kids[%s]>>" % (len(pages), *size, b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))))}
    objects[3] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[%s]>>" % (b"500 " * 95)
    objects[4] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/FirstChar 32/Widths[%s]>>" % (b"500 " * 95)
    for i, items in enumerate(pages):
        content = zlib.compress(b"BT " + b"".join(b"/F%d %d Tf 1 0 0 1 %d %d Tm (%s) Tj " % (bold, points, x, y, text.encode().replace(b"(", b"\\(")) for x, y, points, bold, text in items) + b"ET")
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F0 3 0 R/F1 4 0 R>>>>>>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(content), content)
    out, places = bytearray(b"%PDF-1.7\n"), {}
    free = max(objects) + 1
    inside = [n for n in objects if packed and b"stream" not in objects[n]]
    if packed:
        head, body = [], bytearray()
        for n in inside:
            head.append(b"%d %d" % (n, len(body)))
            body += objects[n] + b" "
        head = b" ".join(head) + b" "
        data = zlib.compress(head + bytes(body))
        objects[free] = b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(inside), len(head), len(data), data)
    for n, value in sorted(objects.items()):
        if n not in inside:
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, value)
    at = len(out)
    if not packed:
        out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(places.items())) + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (free, at)
        return bytes(out)
    places[free + 1] = at
    rows = {n: b"\x01" + p.to_bytes(4, "big") + b"\0" for n, p in places.items()} | {n: b"\x02" + free.to_bytes(4, "big") + bytes([i]) for i, n in enumerate(inside)}
    raw = b"".join(r for _, r in sorted(rows.items()))
    lined = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(raw[i : i + 6], raw[i - 6 : i] if i else bytes(6), strict=True)) for i in range(0, len(raw), 6))
    data = zlib.compress(lined)
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 1]/Index[%s]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 6>>/Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (free + 1, free + 2, index, len(data), data, at)
    return bytes(out)


BOOK = [[(72, 760, 24, 1, "Chapter 1 Introduction"), (72, 700, 12, 0, "Plain body text that goes on"), (72, 680, 12, 0, "and on for a while.")], [(72, 760, 18, 1, "1.1 Background"), (72, 700, 12, 0, "More body text of this page"), (72, 500, 18, 1, "1.2 Scope"), (72, 480, 12, 0, "still more body")]]
NODES = [("第一章 Intro", 1, 0), ("1.1", 2, 1), ("1.2", 2, 9), ("Two", 1, 0)]


@pytest.mark.parametrize("packed", [False, True])
def test_outline_round_trip(packed):
    data = build(BOOK, packed)
    assert pdffile.with_outline(data, []) == data
    made = pdffile.with_outline(data, NODES)
    assert pdffile.Pdf(made).outline() == [("第一章 Intro", 1, 0), ("1.1", 2, 1), ("1.2", 2, 1), ("Two", 1, 0)]
    assert pdffile.Pdf(pdffile.without_outline(made)).outline() == [] and "PageMode" not in pdffile.Pdf(pdffile.without_outline(made)).catalog
    again = pdffile.with_outline(made, NODES[:1])
    assert pdffile.Pdf(again).outline() == [NODES[0]]
    assert [len(pdffile.page_items(pdffile.Pdf(made), p)) for _, p in pdffile.Pdf(made).pages()] == [3, 4]


def test_broken_files():
    data = pdffile.with_outline(build(BOOK), NODES)
    assert len(pdffile.Pdf(data.replace(b"startxref", b"startxxxx")).outline()) == 4
    with pytest.raises(pdffile.Encrypted):
        pdffile.Pdf(build(BOOK).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R"))
    for bad in (b"", b"no pdf", b"%PDF-1.4\nstartxref\n5\n%%EOF"):
        with pytest.raises(pdffile.BadPdf):
            pdffile.Pdf(bad)
    loop = build([[]]).replace(b"/Kids[10 0 R]", b"/Kids[2 0 R]  ")
    assert pdffile.Pdf(loop).pages() == []


def test_items():
    pdf = pdffile.Pdf(build([[(10, 100, 20, 1, "a(b"), (10, 99, 20, 0, "c"), (10, 50, 10, 0, "d")]]))
    (_, page), = pdf.pages()
    a, b, c = pdffile.page_items(pdf, page)
    assert (a.text, a.transform[4:], a.width, a.height, a.has_eol, b.has_eol, c.has_eol) == ("a(b", (10, 100), 30, 20, False, True, False)
    font = pdffile.Font(text={1: "x"}, widths={1: 0.5}, wide=True)
    assert [*font.codes(b"\0\1\0\2")] == [(1, "x", 0.5), (2, "", 0.5)]
    assert pdffile._to_unicode(b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfchar <0a> <4e00> endbfchar") == {1: "A", 2: "B", 3: "C", 10: "一"}
    assert pdffile.Lexer(b"(a\\(b\\051\\n(c)) <4> /A#20B [1 .5 true null]").next() == b"a(b)\n(c)"
    assert [pdffile.glyph_text(n) for n in ("eacute", "uni4E00", "A", "comma", "unknown")] == ["é", "一", "A", ",", ""]


class Static:
    """OCR of pages whose image says which file and page it is of."""

    def __init__(self, lines):
        self.lines = lines

    def extract(self, image, lang):
        name, page = image.decode().split()
        got = self.lines[name][int(page)]
        if isinstance(got, str):
            raise RuntimeError(got)
        return got


class Names:
    def render(self, content, page, scale):
        return b"%s %d" % (re.search(rb"/Tag\((\w+)\)", content)[1], page)


def line(text, x0, y0, x1, y1):
    return {"text": text, "bbox": [x0, y0, x1, y1], "confidence": 0.98}


def job(spark, folder, books, lines=None, **options):
    """One job over all books; nodes and report by the book's name."""
    folder.mkdir()
    for name, data in books.items():
        (folder / f"{name}.pdf").write_bytes(data)
    files, told = S.read_files(spark, str(folder)), Options.of({}, **options)
    pages = S.pages(files)
    reader = pipeline.Reader(lambda wanted: S.render_pages(files, wanted, Names()), pages, Static(lines), told) if lines is not None else None
    out = pipeline.run_job(L.items_to_lines(S.items(files)), pages, reader, options=told)
    names = {r.doc_id: r.path.rsplit("/", 1)[-1][:-4] for r in files.select("doc_id", "path").collect()}
    nodes = {name: [] for name in books}
    for r in out.nodes.orderBy("doc_id", "node_seq").collect():
        nodes[names[r.doc_id]].append((r.title, r.level, r.page_index))
    return files, out, nodes, {names[r.doc_id]: r for r in out.report.collect()}


def test_no_backend(spark, tmp_path):
    _, _, nodes, reports = job(spark, tmp_path / "in", {"scan": build([[]])}, enable_ocr=True)
    assert (nodes["scan"], reports["scan"].exit_code, reports["scan"].errors) == ([], 2, ["ocr_backend_unavailable"])


def test_without_ocr(spark, tmp_path):
    encrypted = build(BOOK).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")
    files, out, nodes, reports = job(spark, tmp_path / "in", {"book": build(BOOK), "scan": build([[], []]), "locked": encrypted, "junk": b"no pdf"})
    assert nodes == {"book": [("Chapter 1 Introduction", 1, 0), ("1.1 Background", 2, 1), ("1.2 Scope", 2, 1)], "scan": [], "locked": [], "junk": []}
    got = {k: (r.doc_type, r.accepted_count, r.exit_code, r.errors, r.unsupported_doc_type, r.page_count) for k, r in reports.items()}
    assert got == {"book": ("text", 3, 0, [], False, 2), "scan": ("scanned", 0, 2, ["unsupported_doc_type"], True, 2), "locked": (None, 0, 3, ["input_encrypted"], False, 0), "junk": (None, 0, 3, ["processing_error"], False, 0)}
    made = S.with_bookmarks(files.join(out.report.filter("success"), "doc_id", "left_semi"), out.nodes)
    written = S.write_files(made, f"file://{tmp_path}/out").collect()
    assert len(written) == 1
    data = open(written[0].target, "rb").read()
    assert pdffile.Pdf(data).outline() == nodes["book"]
    (tmp_path / "again").mkdir()
    (tmp_path / "again/book.pdf").write_bytes(data)
    again = S.read_files(spark, str(tmp_path / "again"))
    assert [(r.title, r.level, r.page_index) for r in S.outlines(again).orderBy("node_seq").collect()] == nodes["book"]
    assert pdffile.Pdf(bytes(S.without_outlines(again).collect()[0].pdf)).outline() == []


def test_command_line_over_files(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/scan.pdf").write_bytes(tagged([[]], "scan"))
    script = tmp_path / "read.py"
    script.write_text("print('Appendix ' + open(__import__('sys').argv[1]).read()); print('附录')")
    monkeypatch.setenv("FOLIOSCOPE_OCR_COMMAND", f"{sys.executable} {script}")
    cli.main(["--pdfs", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--enable-ocr", "--ocr-strategy", "full-page", "--renderer", f"{__name__}:Names"])
    (made,) = (tmp_path / "out/pdf").iterdir()
    assert pdffile.Pdf(made.read_bytes()).outline() == [("Appendix scan 0", 1, 0), ("附录", 1, 0)]
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out/report")).select("success", "doc_type").collect()] == [(True, "scanned")]


def tagged(pages, name, **more):
    return build(pages, extra=b"/Tag(%s)" % name.encode(), **more)


FULL = [line("Chapter 1 OCR", 80, 80, 420, 200), line("1.1 OCR Background", 80, 240, 420, 360), line("Plain body text", 80, 300, 420, 322)]


def test_full_pages(spark, tmp_path):
    text = [(72, 760, 24, 1, "Chapter 1 Text Page"), (72, 700, 12, 0, "Plain body text that goes on")]
    books = {"scan": tagged([[], []], "scan"), "hybrid": tagged([text, []], "hybrid"), "book": tagged(BOOK, "book"), "blank": tagged([[]], "blank")}
    _, _, nodes, reports = job(spark, tmp_path / "in", books, {"scan": [FULL, "broken"], "hybrid": ["never read", [line("1.1 Scanned Section", 80, 80, 420, 200)]], "book": [], "blank": [[]]}, enable_ocr=True, strategy="full-page", parallelism=4)
    assert nodes["scan"] == [("Chapter 1 OCR", 1, 0), ("1.1 OCR Background", 2, 0)] and nodes["hybrid"] == [("Chapter 1 Text Page", 1, 0), ("1.1 Scanned Section", 2, 1)] and len(nodes["book"]) == 3
    report = reports["scan"]
    stats, flags = report.rule_stats, report.feature_flags
    assert (report.doc_type, report.exit_code, report.errors, [tuple(e) for e in report.ocr_errors]) == ("scanned", 0, ["ocr_backend_error"], [(1, "ocr_backend_error", "broken")])
    assert (stats.ocr_pages_attempted, stats.ocr_pages_with_text, stats.ocr_line_count, stats.ocr_candidate_count, stats.ocr_parallel_fallback_to_serial) == (2, 1, 3, 2, 1)
    assert (flags.ocr_executed, flags.ocr_parallel_mode, flags.ocr_parallelism_requested, flags.ocr_parallelism_effective) == (True, "serial", 4, 1)
    report = reports["hybrid"]
    assert (report.doc_type, report.text_pages, report.rule_stats.ocr_pages_attempted, report.errors) == ("hybrid", 1, 1, [])
    assert (reports["book"].exit_code, reports["book"].feature_flags.ocr_executed) == (0, False)
    assert (reports["blank"].exit_code, reports["blank"].errors) == (2, ["ocr_no_candidates"])


def test_guided(spark, tmp_path):
    contents = [line("目录", 260, 140, 340, 190), line("绪论测试", 180, 320, 340, 350), line("1", 920, 320, 940, 350)]
    more = [line("目录", 260, 140, 340, 190), line("第一章总论", 180, 320, 340, 350), line("1", 920, 320, 940, 350), line("第二章方法", 180, 420, 340, 450), line("3", 920, 420, 940, 450)]
    at = lambda text: line(text, 220, 180, 380, 230)
    lines = {"short": [[], contents, [at("绪论测试")]], "long": [[at("作者简介")], more, [at("序言")], [at("第一章"), line("总论", 220, 240, 380, 290)], [at("text")], [at("第二章方法")], [at("参考书目录")], [at("后 记")]], "none": [FULL]}
    books = {k: tagged([[]] * len(v), k, size=(500, 842)) for k, v in lines.items()}
    _, _, nodes, reports = job(spark, tmp_path / "in", books, lines, enable_ocr=True)
    assert nodes["short"] == [("目录", 1, 1), ("绪论测试", 1, 2)]
    assert nodes["long"] == [("作者简介", 1, 0), ("目录", 1, 1), ("序言", 1, 2), ("第一章总论", 2, 3), ("第二章方法", 2, 5), ("参考书目录", 1, 6), ("后记", 1, 7)]
    assert [n[0] for n in nodes["none"]] == ["Chapter 1 OCR", "1.1 OCR Background"]
    stats = reports["short"].rule_stats
    assert (stats.toc_guided_page_offset, stats.toc_guided_toc_start_page, stats.toc_guided_toc_pages, stats.toc_guided_parsed_rows, stats.toc_guided_structural_entries) == (2, 2, 1, 1, 1)
    assert (stats.ocr_pages_attempted, stats.ocr_unique_pages_attempted, stats.ocr_candidate_count) == (3, 3, 2)
    assert reports["short"].feature_flags.toc_guided_executed and (reports["short"].accepted_count, reports["short"].rejected_count, reports["short"].exit_code) == (2, 0, 0)
    assert reports["long"].rule_stats.toc_guided_page_offset == 3 and reports["long"].toc_guided_errors is None
    report = reports["none"]
    assert report.errors == ["toc_guided_fallback_full_page"] and [e.reason for e in report.toc_guided_errors] == ["toc_guided_toc_not_found"]
    assert report.rule_stats.ocr_pages_attempted == 2 and report.rule_stats.ocr_unique_pages_attempted == 1


def test_settings():
    told = Options.of({"FOLIOSCOPE_OCR_STRATEGY": "Full_Page", "FOLIOSCOPE_CONFIRM_WINDOW": "2x", "FOLIOSCOPE_OCR_RENDER_SCALE": "9.5", "FOLIOSCOPE_FORCE_OCR": " Yes ", "FOLIOSCOPE_TAIL_SCAN_PAGES": "x"}, enable_ocr=True, parallelism=0)
    assert (told.strategy, told.window, told.scale, told.force_ocr, told.tail, told.parallelism) == ("full-page", 2, 4.0, True, 8, 1)
    assert Options.of({"FOLIOSCOPE_FORCE_OCR": "1"}, strategy="other").strategy == "toc-guided" and not Options.of({"FOLIOSCOPE_FORCE_OCR": "1"}).force_ocr
    assert R.resolve_backend(None, {}) is None and R.resolve_backend(None, {"FOLIOSCOPE_OCR_COMMAND": "read {image}"}).template == "read {image}"
    words = {"a 'b c' \"d e\"": ["a", "b c", "d e"], "a '' b": ["a", "b"], "a\\ b 'c\\d'": ["a b", "c\\d"], "a \"b\\\"c": ["a", 'b"c'], "a\\": ["a\\"], " 'open end": ["open end"]}
    assert {k: R.words_of(k) for k in words} == words
