"""Text lines of page images by a command that prints them, or by a backend of the user's.

Each page is a row, and a failing page keeps its error. A backend is any object that can be pickled, with
``extract(image, lang)``: a list of strings, or of dicts with text and, if known, bbox (in pixels) and confidence.
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = "doc_id long, page_index int, lines array<string>, error string"
SECONDS = 60.0


def words_of(template: str) -> list[str]:
    """A command line's words. White space parts them outside quotes; a backslash keeps the next character, but not in single quotes, and stands for itself at the end. Empty words go, open quotes end with the line."""
    words, word, quote, i = [], "", "", 0
    while i < len(template):
        c = template[i]
        i += 1
        if c == "\\" and quote != "'":
            word += template[i : i + 1] or c
            i += 1
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "'\"":
            quote = c
        elif c.isspace():
            words, word = [*words, word], ""
        else:
            word += c
    return [w for w in [*words, word] if w]


def arguments(template: str, image: str, lang: str) -> list[str]:
    """The words of the template with {image} and {lang} filled in; without either, both are added at the end."""
    words = words_of(template)
    if "{image}" in template or "{lang}" in template:
        return [w.replace("{image}", image).replace("{lang}", lang) for w in words]
    return [*words, image, lang]


def read_page(image: bytes, template: str, lang: str, seconds: float = SECONDS) -> tuple[list[str], str | None]:
    """The lines that the command prints, trimmed and without blank ones, or the reason there are none."""
    with tempfile.TemporaryDirectory(prefix="page-") as folder:
        path = os.path.join(folder, "page.png")
        with open(path, "wb") as f:
            f.write(image)
        try:
            done = subprocess.run(arguments(template, path, lang), stdin=subprocess.DEVNULL, capture_output=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            return [], f"OCR command timed out after {seconds:g} seconds."
        except OSError as e:
            return [], str(e)
    out, err = (x.decode("utf-8", "replace") for x in (done.stdout, done.stderr))
    if done.returncode:
        return [], f"OCR command failed with exit code {done.returncode}: {err.strip() or out.strip() or 'unknown OCR command failure'}"
    return [t for line in out.split("\n") if (t := line.strip())], None


def read_images(images: DataFrame, template: str, lang: str = "zh", tasks: int | None = None, seconds: float = SECONDS) -> DataFrame:
    """(doc_id, page_index, image) to doc_id, page_index, lines, error. ``tasks``: how many commands run at once at most.

    Null images read as empty files; an empty table gives an empty table.
    """

    def run(frames):
        for frame in frames:
            rows = [read_page(bytes(x or b""), template, lang, seconds) for x in frame["image"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "page_index": frame["page_index"], "lines": [r[0] for r in rows], "error": [r[1] for r in rows]})

    pages = images.select("doc_id", "page_index", "image")
    return (pages.repartition(tasks) if tasks else pages).mapInPandas(run, PAGE)


def raw_lines(read: DataFrame, sizes: DataFrame, scale: float = 2.0) -> DataFrame:
    """What ``read_images`` returns, as OCR lines without boxes. ``sizes``: doc_id, page_index, page_height."""
    none = [F.lit(None).cast("double").alias("b" + c) for c in ("x0", "y0", "x1", "y1")]
    each = read.select("doc_id", "page_index", F.posexplode("lines").alias("line_no", "text")).join(sizes, ["doc_id", "page_index"])
    return each.select("doc_id", "page_index", "line_no", "text", F.lit(float(scale)).alias("render_scale"), "page_height", *none, F.lit(None).cast("double").alias("confidence"))


class CommandBackend:
    """Reads a page by a command; several pages at once, because every task starts its own."""

    def __init__(self, template: str, seconds: float = SECONDS):
        self.template, self.seconds = template, seconds

    def extract(self, image: bytes, lang: str) -> list[str]:
        lines, error = read_page(image, self.template, lang, self.seconds)
        if error:
            raise RuntimeError(error)
        return lines


def resolve_backend(backend=None, environ=os.environ):
    """The backend given, else the command that the environment names, else none."""
    if backend is not None:
        return backend
    template = environ.get("FOLIOSCOPE_OCR_COMMAND", "").strip()
    return CommandBackend(template) if template else None


RUN = "doc_id long, page_index int, lines array<struct<text:string,bbox:array<double>,confidence:double>>, error string"


def run_pages(images: DataFrame, backend, lang: str = "zh", tasks: int | None = None, progress: bool = False) -> DataFrame:
    """(doc_id, page_index, image and, where rendering failed, error) to RUN, each valid page once. ``progress``: a line to the task's log for each page."""

    def line(x):
        if isinstance(x, dict):
            box = x.get("bbox")
            return {"text": str(x.get("text", "")), "bbox": [float(v) for v in box] if box else None, "confidence": None if x.get("confidence") is None else float(x["confidence"])}
        return {"text": str(x), "bbox": None, "confidence": None}

    def page(doc, index, image, error):
        if progress:
            print(f"OCR document {doc} page {index + 1}", flush=True)
        if error:
            return [], error
        try:
            return [line(x) for x in backend.extract(bytes(image or b""), lang)], None
        except Exception as e:  # a page that can't be read keeps its error
            return [], str(e) or type(e).__name__

    def run(frames):
        for frame in frames:
            rows = [page(*r) for r in zip(frame["doc_id"], frame["page_index"], frame["image"], frame["error"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "page_index": frame["page_index"], "lines": [r[0] for r in rows], "error": [r[1] for r in rows]})

    error = F.col("error") if "error" in images.columns else F.lit(None).cast("string").alias("error")
    pages = images.select("doc_id", "page_index", "image", error).filter("page_index >= 0").dropDuplicates(["doc_id", "page_index"])
    return (pages.repartition(tasks) if tasks else pages).mapInPandas(run, RUN)


def run_stats(read: DataFrame, backend, requested: int = 1) -> DataFrame:
    """doc_id and the counters of its OCR pages. A backend that isn't a command counts as serial, and says so if more was asked for; the tasks run in parallel all the same."""
    requested = max(1, int(requested))
    command = isinstance(backend, CommandBackend)
    pages, many = F.count(F.lit(1)), F.lit(requested > 1 and command)
    told = read.groupBy("doc_id").agg(pages.alias("ocr_pages_attempted"), F.count_if(F.size("lines") > 0).alias("ocr_pages_with_text"), F.sum(F.greatest(F.size("lines"), F.lit(0)).cast("long")).alias("ocr_line_count"))
    process = many & (F.col("ocr_pages_attempted") > 1)
    return told.select(
        "*", F.lit(requested).alias("ocr_parallelism_requested"), F.when(process, F.least(F.lit(requested), F.col("ocr_pages_attempted").cast("int"))).otherwise(1).alias("ocr_parallelism_effective"),
        F.when(process, "process").otherwise("serial").alias("ocr_parallel_mode"), F.lit(int(requested > 1 and not command)).alias("ocr_parallel_fallback_to_serial"),
    )


def run_lines(read: DataFrame, sizes: DataFrame, scale: float = 2.0) -> DataFrame:
    """What ``run_pages`` returns, as raw OCR lines. ``sizes``: doc_id, page_index, page_width, page_height."""
    box = [F.get("line.bbox", F.lit(i)).alias("b" + c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    each = read.select("doc_id", "page_index", F.posexplode("lines").alias("line_no", "line")).join(sizes.select("doc_id", "page_index", "page_width", "page_height"), ["doc_id", "page_index"])
    return each.select("doc_id", "page_index", "line_no", F.col("line.text").alias("text"), F.lit(float(scale)).alias("render_scale"), "page_width", "page_height", *box, F.col("line.confidence").alias("confidence"))
