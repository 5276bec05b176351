"""The guided path as one job: a printed table of contents is read, its pages' distance found, and its entries confirmed.

Pages are read by OCR in four steps, each of which needs the one before: the first pages, those after the table of
contents, those that the entries lead to, and those behind the last entry. A step reads only pages that no step before
has read. All documents go through a step together. What a step finds is written, because the next ones use it several times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..operators import contents as P
from ..operators.ocr import coerce_lines
from ..tables import durable


@dataclass(frozen=True)
class Guided:
    """nodes: doc_id, node_seq, title, level, page_index, confidence, source. stats: a row for each document. errors: doc_id, reason, detail. reads: the steps' pages as the reader returned them."""

    nodes: DataFrame
    stats: DataFrame
    errors: DataFrame
    reads: list[DataFrame]


def run(sizes: DataFrame, reader, limits: Options = Options(), headers: tuple[str, ...] = P.HEADERS) -> Guided:
    """``sizes``: doc_id, page_index, page_width, page_height of every page. ``reader.read(pages)``: a step's pages as ``ocr_command.run_pages`` returns them; ``reader.lines(read)``: their raw lines."""
    sizes = durable(sizes, "page-sizes")
    counts = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    every, reads, known = sizes.select("doc_id", "page_index"), [], []

    def read(wanted: DataFrame) -> DataFrame:
        """All lines read so far, after the wanted pages that are new."""
        new = every.join(wanted.distinct(), ["doc_id", "page_index"], "left_semi")
        for old in reads:
            new = new.join(old.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti")
        reads.append(reader.read(new))
        known.append(durable(coerce_lines(reader.lines(reads[-1])), "guided-lines"))
        out = known[0]
        for more in known[1:]:
            out = out.unionByName(more)
        return out

    front = read(every.filter(F.col("page_index") < limits.front))
    rows = durable(P.contents_rows(front, headers), "contents-rows")
    extent = durable(P.contents_extent(every, front, rows, limits.front).filter("content_end is not null"), "contents-extent")
    inside = rows.join(extent, "doc_id").filter((F.col("source_page_index") >= F.col("start_page")) & (F.col("source_page_index") <= F.col("content_end")))
    entries = durable(P.structural_entries(inside.select(*rows.columns)), "entries")
    able = extent.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")

    starts = able.select("doc_id", (F.col("scan_end") + 1).alias("start_page"))
    near = every.join(starts, "doc_id").filter((F.col("page_index") >= F.col("start_page")) & (F.col("page_index") < F.col("start_page") + limits.probe)).select("doc_id", "page_index")
    probed = read(near)
    anchored = P.page_offset(entries, P.page_titles(probed, headers), starts, limits.probe)
    first = Window.partitionBy("doc_id").orderBy("entry_seq")
    printed = entries.filter("printed_page is not null").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("doc_id", "printed_page")
    offsets = able.join(anchored, "doc_id", "left").join(printed, "doc_id", "left").join(counts, "doc_id")
    weak = F.col("scan_end") + 1 - F.coalesce("printed_page", F.lit(1))
    offsets = durable(offsets.select("doc_id", "start_page", "content_end", "scan_end", "page_count", F.coalesce("page_offset", weak).alias("page_offset"), F.col("page_offset").isNull().alias("weak"), F.least(F.coalesce("found_page", F.col("scan_end") + 1 + limits.probe), "page_count").alias("preface_stop")), "offsets")

    led = entries.filter("printed_page is not null").join(offsets, "doc_id").withColumn("led", F.col("printed_page") + F.col("page_offset") - 1)
    confirmed_from = read(led.select("doc_id", F.explode(F.sequence(F.col("led") - limits.window, F.col("led") + limits.window)).alias("page_index")))
    main = durable(P.confirmed_nodes(entries, offsets, P.page_titles(confirmed_from, headers), counts, limits.window), "main-nodes")

    last = main.groupBy("doc_id").agg(F.max_by("page_index", "entry_seq").alias("tail_start"))
    behind = F.sequence(F.col("tail_start"), F.col("tail_start") + limits.tail)
    after = last.select("doc_id", F.explode(behind).alias("page_index"))
    lines = read(after)
    tail = P.tail_nodes(P.page_titles(lines.join(after, ["doc_id", "page_index"], "left_semi"), headers))

    # The scan for contents stops at a later list of figures or the first page behind the rows, which is still looked at.
    stop = F.when(F.col("scan_end") > F.col("content_end"), F.col("scan_end")).otherwise(F.col("content_end") + 1)
    scanned = offsets.select("doc_id", F.least(stop, F.lit(limits.front - 1)).alias("stop"), "scan_end", "preface_stop")
    before = lines.join(scanned, "doc_id").filter((F.col("page_index") <= F.col("stop")) | ((F.col("page_index") > F.col("scan_end")) & (F.col("page_index") < F.col("preface_stop"))))
    plain = ["doc_id", "title", "level", "page_index", "confidence", "source"]
    nodes = P.front_nodes(before.select(*lines.columns)).unionByName(main.select(*plain)).unionByName(tail)
    deduped = durable(P.dedupe_nodes(nodes), "guided-nodes")

    parsed = inside.groupBy("doc_id").agg(F.count(F.lit(1)).alias("toc_guided_parsed_rows"))
    structural = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("toc_guided_structural_entries"))
    made = deduped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("toc_guided_node_count"))
    pages = reads[0]
    for more in reads[1:]:
        pages = pages.unionByName(more)
    told = extent.select("doc_id", (F.col("start_page") + 1).alias("toc_guided_toc_start_page"), (F.col("content_end") - F.col("start_page") + 1).alias("toc_guided_toc_pages"))
    stats = counts.select("doc_id").join(told, "doc_id", "left").join(parsed, "doc_id", "left").join(structural, "doc_id", "left").join(offsets.select("doc_id", F.col("page_offset").alias("toc_guided_page_offset"), "weak"), "doc_id", "left").join(made, "doc_id", "left")
    stats = durable(stats, "guided-stats")
    reason = (
        F.when(F.col("toc_guided_toc_pages").isNull(), "toc_guided_toc_not_found")
        .when(F.coalesce("toc_guided_structural_entries", F.lit(0)) == 0, "toc_guided_no_structural_entries")
        .when(F.col("weak"), "toc_guided_offset_inferred_weakly")
    )
    errors = stats.select("doc_id", reason.alias("reason"), F.when(reason == "toc_guided_offset_inferred_weakly", F.col("toc_guided_page_offset").cast("string")).alias("detail")).filter("reason is not null")
    failed = pages.filter("error is not null").select("doc_id", F.lit("ocr_backend_error").alias("reason"), F.concat_ws(": ", F.col("page_index").cast("string"), "error").alias("detail"))
    return Guided(deduped, stats.drop("weak").na.fill(0, ["toc_guided_node_count"]), errors.unionByName(failed), reads)
