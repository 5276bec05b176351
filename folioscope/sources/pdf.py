"""PDF files as tables: pages, text items, outlines, page images by a renderer of the user's, and files with bookmarks.

A file is a row of Spark's ``binaryFile`` source and is parsed by the task that holds it. A file that can't be read keeps a
row in ``pages`` with its error: ``input_encrypted`` or ``processing_error``.
"""

from __future__ import annotations

import math
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, units
from . import pdffile

cloudpickle.register_pickle_by_value(pdffile)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BOLD = re.compile("bold|black|heavy", re.IGNORECASE)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, content of the PDF files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _each(files: DataFrame, rows_of, names: str) -> DataFrame:
    """Rows of ``rows_of(doc_id, content)`` for every file, a batch a file."""
    fields = [x.split() for x in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches):
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = rows_of(doc, content.as_py() or b"")
                cols = zip(*rows, strict=True) if rows else [()] * len(fields)
                yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return files.select("doc_id", "content").mapInArrow(run, names)


def _opened(content: bytes):
    """(Pdf, None) or (None, error)."""
    try:
        return pdffile.Pdf(content), None
    except pdffile.Encrypted:
        return None, "input_encrypted"
    except Exception:  # whatever is wrong with a file is the file's error, not the job's
        return None, "processing_error"


def pages(files: DataFrame) -> DataFrame:
    """doc_id, page_index, page_width, page_height, text (of all items, without anything between), char_count, error."""

    def rows(doc, content):
        pdf, error = _opened(content)
        if pdf is None:
            return [(doc, None, None, None, None, error)]
        return [(doc, i, *map(float, pdf.page_size(page)), "".join(x.text for x in pdffile.page_items(pdf, page)), None) for i, (_, page) in enumerate(pdf.pages())]

    read = _each(files, rows, "doc_id long, page_index int, page_width double, page_height double, text string, error string")
    return read.select("doc_id", "page_index", "page_width", "page_height", "text", units(squeeze(F.col("text"))).alias("char_count"), "error")


def items(files: DataFrame) -> DataFrame:
    """What ``layout.items_to_lines`` takes, with ``page_width``: trimmed items that aren't blank, boxes in points from the top left."""

    def rows(doc, content):
        pdf, _ = _opened(content)
        out = []
        for i, (_, page) in enumerate(pdf.pages() if pdf else ()):
            width, height = pdf.page_size(page)
            for seq, item in enumerate(pdffile.page_items(pdf, page)):
                if not (text := item.text.strip()):
                    continue
                size = math.hypot(item.transform[1], item.transform[3])
                size = size if math.isfinite(size) and size > 0 else item.height
                tall, x, base = item.height or size, item.transform[4], item.transform[5]
                top = max(0.0, height - base - tall)
                out.append((doc, i, seq, text, x, top, x + max(0.0, item.width), top + tall, size, bool(_BOLD.search(item.font_name)), item.font_name, float(height), item.has_eol, float(width)))
        return out

    return _each(files, rows, "doc_id long, page_index int, item_seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, font_name string, page_height double, has_eol boolean, page_width double")


def outlines(files: DataFrame) -> DataFrame:
    """doc_id, node_seq, title, level, page_index (null: leads nowhere) of the outlines that the files have."""

    def rows(doc, content):
        pdf, _ = _opened(content)
        return [(doc, n, *node) for n, node in enumerate(pdf.outline())] if pdf else []

    return _each(files, rows, "doc_id long, node_seq int, title string, level int, page_index int")


def render_pages(files: DataFrame, wanted: DataFrame, renderer, scale: float = 2.0) -> DataFrame:
    """doc_id, page_index, image, error of the wanted pages. ``renderer.render(content, page_index, scale)`` returns a PNG; it is the user's, and goes to the executors."""
    held = wanted.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("wanted"))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string()]

    def image(content, page):
        try:
            return renderer.render(content, page, scale), None
        except Exception as e:  # a page that can't be drawn keeps its error
            return None, str(e) or type(e).__name__

    def run(batches):
        for b in batches:
            for doc, content, numbers in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = content.as_py() or b""
                for page in numbers:
                    yield pa.record_batch([pa.array([x], k) for x, k in zip((doc, page, *image(data, page)), kinds, strict=True)], names=["doc_id", "page_index", "image", "error"])

    return files.join(held, "doc_id").select("doc_id", "content", "wanted").mapInArrow(run, "doc_id long, page_index int, image binary, error string")


def with_bookmarks(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, path, pdf, error: each file with its nodes as its outline, in the order of node_seq; without nodes, as it is."""
    held = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_seq", "title", "level", "page_index"))).alias("nodes"))
    return _rewritten(files.join(held, "doc_id", "left"), lambda content, given: pdffile.with_outline(content, [(n["title"], n["level"], n["page_index"]) for n in given or ()]))


def without_outlines(files: DataFrame) -> DataFrame:
    """doc_id, path, pdf, error: the files without their outlines."""
    return _rewritten(files.withColumn("nodes", F.lit(None).cast("array<int>")), lambda content, _: pdffile.without_outline(content))


def _rewritten(files: DataFrame, rewrite) -> DataFrame:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.string()]

    def made(content, nodes):
        try:
            return rewrite(content, nodes), None
        except pdffile.Encrypted:
            return None, "input_encrypted"
        except Exception:  # as in _opened
            return None, "processing_error"

    def run(batches):
        for b in batches:
            for doc, path, content, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([x], k) for x, k in zip((doc, path, *made(content.as_py() or b"", nodes)), kinds, strict=True)], names=["doc_id", "path", "pdf", "error"])

    return files.select("doc_id", "path", "content", "nodes").mapInArrow(run, "doc_id long, path string, pdf binary, error string")


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Writes each ``pdf`` under its file's name and doc_id to a folder that all tasks reach, and returns doc_id, target, size.

    A file appears whole or not at all: it is written under another name first, so a task that runs twice does no harm.
    """
    kinds = [pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for doc, path, pdf in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = pdf.as_py()
                target = f"{base}/{path.rsplit('/', 1)[-1].removesuffix('.pdf')}-{doc & (1 << 64) - 1:016x}.pdf"
                with system.open_output_stream(f"{target}.tmp") as f:
                    f.write(data)
                system.move(f"{target}.tmp", target)
                yield pa.record_batch([pa.array([x], k) for x, k in zip((doc, target, len(data)), kinds, strict=True)], names=["doc_id", "target", "size"])

    return made.filter("pdf is not null").select("doc_id", "path", "pdf").mapInArrow(run, "doc_id long, target string, size long")
