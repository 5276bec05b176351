"""python -m folioscope --pdfs DIR | --lines DIR | --items DIR --out DIR [options]: outlines of PDF files, or of positioned text in Parquet."""

from __future__ import annotations

import argparse
import os
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators.layout import items_to_lines
from .plans import pipeline
from .sources import ocr_command, pdf, sinks


def _job(spark, told) -> pipeline.Result:
    """The whole job over PDF files; files that succeed are written with their bookmarks."""
    files = pdf.read_files(spark, told.pdfs)
    options = config.Options.of(os.environ, enable_ocr=told.enable_ocr, strategy=told.ocr_strategy, parallelism=told.ocr_parallelism, lang=told.lang)
    pages, reader = pdf.pages(files), None
    if told.renderer and (backend := ocr_command.resolve_backend()):
        module, _, name = told.renderer.partition(":")
        renderer = getattr(import_module(module), name)()
        reader = pipeline.Reader(lambda wanted: pdf.render_pages(files, wanted, renderer, options.scale), pages, backend, options)
    out = pipeline.run_job(items_to_lines(pdf.items(files)), pages, reader, config.load(told.config), options)
    good = files.join(out.report.filter("success").select("doc_id"), "doc_id", "left_semi")
    sinks.write_json(pdf.write_files(pdf.with_bookmarks(good, out.nodes), f"{told.out}/pdf" if "://" in told.out else f"file://{os.path.abspath(told.out)}/pdf"), f"{told.out}/files")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folioscope", description="Outlines of documents from their text and its place on the page.")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--pdfs", help="folder of PDF files")
    given.add_argument("--lines", help="Parquet of positioned lines")
    given.add_argument("--items", help="Parquet of positioned items")
    p.add_argument("--out", required=True, help="folder for outline, bookmarks, rejected and report")
    p.add_argument("--config", help="YAML settings")
    p.add_argument("--enable-ocr", action="store_true", help="read pages without text by the command in FOLIOSCOPE_OCR_COMMAND")
    p.add_argument("--ocr-strategy", choices=config.STRATEGIES)
    p.add_argument("--ocr-parallelism", type=int, default=1)
    p.add_argument("--lang", default="zh")
    p.add_argument("--renderer", help="module:Class that draws pages for OCR")
    told = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    if told.pdfs:
        out = _job(spark, told)
    else:
        lines = spark.read.parquet(told.lines) if told.lines else items_to_lines(spark.read.parquet(told.items))
        pages = lines.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
        out = pipeline.run(lines, pages, config.load(told.config))
    sinks.write_json(sinks.outline_json(out.nodes), f"{told.out}/outline")
    for name in ("bookmarks", "rejected", "report"):
        sinks.write_json(getattr(out, name), f"{told.out}/{name}")


if __name__ == "__main__":
    main()
