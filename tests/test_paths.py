"""The job over lines, its sinks, and lines by a command."""

import json
import sys

from folioscope import __main__ as cli
from folioscope.operators import candidates as C
from folioscope.operators import layout as L
from folioscope.operators import outline as O
from folioscope.sources import fixtures as S
from folioscope.sources import ocr_command as R
from folioscope.sources import sinks


def test_command_line(spark, sf_dir, tmp_path):
    S.items(spark, sf_dir).write.parquet(str(tmp_path / "items"))
    cli.main(["--items", str(tmp_path / "items"), "--out", str(tmp_path / "out")])
    got = {r.doc_id: json.loads(r.json) for r in spark.read.schema("doc_id long, json string").json(str(tmp_path / "out/outline")).collect()}
    lines = L.items_to_lines(S.items(spark, sf_dir))
    assert got and set(got) <= {r.doc_id for r in lines.select("doc_id").distinct().collect()}
    want = {}
    held = S.lines(spark, sf_dir).filter("trim(text) <> ''")  # no item is blank, so no line is
    for r in sorted(O.outline(O.judged(C.candidates(held))).collect(), key=lambda r: (r.doc_id, r.node_seq)):
        want.setdefault(r.doc_id, []).append((r.title, r.level, r.page_index))
    assert {d: [(n["title"], n["level"], n["page_index"]) for n in ns if n["title"] != "封面"] for d, ns in got.items()} == want
    report = spark.read.json(str(tmp_path / "out/report"))
    assert report.count() == spark.read.parquet(str(tmp_path / "items")).select("doc_id").distinct().count()


def test_one_file(tmp_path):
    sinks.write_one('{"b": 1, "a": "é"}', str(tmp_path / "x/y.json"))
    assert (tmp_path / "x/y.json").read_text(encoding="utf-8") == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_command(spark, tmp_path):
    script = tmp_path / "read.py"
    script.write_text("import sys\nd = open(sys.argv[1], 'rb').read().decode()\nsys.exit('broken') if d == 'bad' else print(d, sys.argv[2], '', sep='\\n\\n ')\n")
    images = spark.createDataFrame([(1, 0, bytearray(b"first")), (1, 1, bytearray(b"bad")), (2, 0, None)], "doc_id long, page_index int, image binary")
    got = {(r.doc_id, r.page_index): (r.lines, r.error) for r in R.read_images(images, f"{sys.executable} {script}", "zh", 2).collect()}
    assert got[1, 0] == (["first", "zh"], None) and got[2, 0] == (["zh"], None)
    assert got[1, 1] == ([], "OCR command failed with exit code 1: broken")
    assert R.read_page(b"", f"{sys.executable} -c 'import time; time.sleep(9)'", "zh", 0.3) == ([], "OCR command timed out after 0.3 seconds.")
    assert R.arguments("ocr --lang {lang} {image}", "/a b.png", "zh") == ["ocr", "--lang", "zh", "/a b.png"]
    sizes = spark.createDataFrame([(1, 0, 800.0), (2, 0, 800.0)], "doc_id long, page_index int, page_height double")
    assert R.raw_lines(R.read_images(images, f"{sys.executable} {script}"), sizes).count() == 3


def test_unwanted_licenses(spark, tmp_path):
    from folioscope.sources.lockfile import unwanted_licenses

    packages = {"": {"license": "GPL-3.0"}, "node_modules/a": {"license": "MIT"}, "node_modules/b": {"license": "(MIT OR AGPL-3.0)"}, "node_modules/c": {"name": "c", "license": "LGPL-2.1"}, "node_modules/d": {}, "src/e": {"license": "GPL"}}
    path = tmp_path / "lock.json"
    path.write_text(json.dumps({"name": "x", "packages": packages}, indent=1))
    assert sorted(tuple(r) for r in unwanted_licenses(spark, str(path)).collect()) == [("node_modules/b", "(MIT OR AGPL-3.0)"), ("node_modules/c", "LGPL-2.1")]
    assert [r.package for r in unwanted_licenses(spark, str(path), ("c",)).collect()] == ["node_modules/b"]
