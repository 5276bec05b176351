"""The registered queries of the outline engine; their SQL is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Rules, Thresholds
from ..functions import similarity as M
from ..functions import text as T
from ..operators import candidates as C
from ..operators import classify as K
from ..operators import contents as P
from ..operators import evaluate as E
from ..operators import layout as L
from ..operators import ocr as R
from ..operators import outline as O
from ..sources import fixtures as S
from ..tables import durable
from . import pipeline
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

_SCORES = ["style_score", "position_score", "pattern_score", "semantic_score", "total_score"]


def normalize_titles(spark, sf_dir):
    text = F.col("text")
    return S.lines(spark, sf_dir).select("doc_id", "line_seq", T.normalize(text).alias("title"), T.candidate_title(text).alias("candidate"), T.has_cjk(text).alias("cjk"))


def position_pattern_semantic(spark, sf_dir):
    text = F.col("title")
    return S.lines(spark, sf_dir).withColumn("title", T.normalize(F.col("text"))).select("doc_id", "line_seq", T.position_score(F.col("top_ratio")).alias("position"), T.pattern_score(text).alias("pattern"), T.semantic_score(text).alias("semantic"), T.numbered_level(text).alias("level"))


def heading_fragments(spark, sf_dir):
    return C.heading_fragments(S.lines(spark, sf_dir)).select("doc_id", "page_index", "line_seq", "single", "text", "x0", "y0", "x1", "y1", "font_size", "is_bold", "font_name", "top_ratio")


def body_font_profile(spark, sf_dir):
    return C.body_font(C.heading_fragments(S.lines(spark, sf_dir)))


def scored_candidates(spark, sf_dir):
    return C.candidates(S.lines(spark, sf_dir)).select("doc_id", "page_index", "line_seq", "single", "text", *_SCORES, "level_hint")


def rule_stats(spark, sf_dir):
    return C.rule_stats(C.scored_lines(C.heading_fragments(S.lines(spark, sf_dir))))


def candidate_cap(spark, sf_dir):
    one = Config(DEFAULT.score_weights, DEFAULT.thresholds, Rules(max_candidates_per_page=1))
    return C.scored_lines(C.heading_fragments(S.lines(spark, sf_dir)), one).select("doc_id", "page_index", "line_seq", "single", "text")


def font_bucket_levels(spark, sf_dir):
    return C.candidates(S.lines(spark, sf_dir)).select("doc_id", "font_size", "bucket").distinct()


def _judged(spark, sf_dir):
    return O.judged(C.candidates(S.lines(spark, sf_dir)))


def accept_reject(spark, sf_dir):
    return C.candidates(S.lines(spark, sf_dir)).select("doc_id", "page_index", "line_seq", "single", "text", C.accepted().alias("accepted"))


def outline_tree(spark, sf_dir):
    return O.outline(_judged(spark, sf_dir))


def rejected_nodes(spark, sf_dir):
    return O.rejected(_judged(spark, sf_dir))


def outline_text(spark, sf_dir):
    return O.outline_text(O.outline(_judged(spark, sf_dir)))


def classify_documents(spark, sf_dir):
    return K.classify(S.pages(spark, sf_dir))


def ocr_page_routing(spark, sf_dir):
    pages = S.pages(spark, sf_dir)
    return K.ocr_pages(pages, K.classify(pages))


def ocr_line_coercion(spark, sf_dir):
    return R.coerce_lines(S.ocr_raw(spark, sf_dir)).select("doc_id", "page_index", "line_seq", "text", "x0", "y0", "x1", "y1", "height")


def ocr_body_height(spark, sf_dir):
    return R.body_height(R.coerce_lines(S.ocr_raw(spark, sf_dir)))


def ocr_candidates(spark, sf_dir):
    return R.ocr_candidates(R.coerce_lines(S.ocr_raw(spark, sf_dir))).select("doc_id", "page_index", "line_seq", "single", "text", *_SCORES, "level_hint")


def ocr_accept(spark, sf_dir):
    return R.ocr_candidates(R.coerce_lines(S.ocr_raw(spark, sf_dir))).select("doc_id", "page_index", "line_seq", "single", C.accepted().alias("accepted"))


def items_to_lines(spark, sf_dir):
    return L.items_to_lines(S.items(spark, sf_dir)).select("doc_id", "page_index", "text", "y0", "y1", "font_size", "is_bold", "font_name", "top_ratio")


def same_row_clusters(spark, sf_dir):
    return L.same_rows(R.coerce_lines(S.ocr_raw(spark, sf_dir)).select("doc_id", "page_index", "line_seq", "x0", "y0", "y1"))


def structural_entries(spark, sf_dir):
    return P.structural_entries(S.entries(spark, sf_dir))


def toc_row_join(spark, sf_dir):
    rows = P.contents_rows(S.contents_pages(spark, sf_dir)[1])
    return rows.select("doc_id", "title", "level", "printed_page", "source_page_index", "y", F.round("confidence", 9).alias("confidence"))


def toc_extent(spark, sf_dir):
    pages, lines = S.contents_pages(spark, sf_dir)
    return P.contents_extent(pages, lines, P.contents_rows(lines))


def cover_node(spark, sf_dir):
    """Outlines put 30 pages on, with front matter before them."""
    nodes = O.outline(_judged(spark, sf_dir)).withColumn("page_index", F.col("page_index") + 30)
    count = nodes.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
    front = count.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("node_seq"), F.lit(t).alias("title")) for i, t in ((-3, "目录"), (-2, "序言"))])).alias("f")).select("doc_id", "f.*")
    front = front.select("*", F.lit(1).alias("level"), F.lit(2).alias("page_index"), T.lit(0.9).alias("confidence"), F.lit("rule").alias("source"))
    return O.with_cover(front.unionByName(nodes), count)


def title_similarity(spark, sf_dir):
    """Of each candidate's title and the next one's."""
    titled = C.candidates(S.lines(spark, sf_dir)).withColumn("following", F.lead("text", 1, "").over(Window.partitionBy("doc_id").orderBy(*C.ORDER)))
    return titled.select("doc_id", "line_seq", "single", F.round(M.title_similarity(F.col("text"), F.col("following")), 12).alias("similarity"))


def dedupe_nodes(spark, sf_dir):
    return P.dedupe_nodes(C.candidates(S.lines(spark, sf_dir)).select("doc_id", "page_index", "line_seq", F.col("text").alias("title"), F.col("level_hint").alias("level")))


def _moved(nodes):
    """An outline with every fifth title missing, some titles longer and some pages off."""
    n = F.col("node_seq")
    return nodes.filter(n % 5 != 3).withColumn("title", F.when(n % 4 == 1, F.concat("title", F.lit(" x"))).otherwise(F.col("title"))).withColumn("page_index", F.col("page_index") + n % 4)


def outline_eval(spark, sf_dir):
    nodes = durable(O.outline(_judged(spark, sf_dir)), "outline")  # both sides read it
    return E.evaluation(nodes, _moved(nodes))


def ocr_full_page(spark, sf_dir):
    """Outlines of the text's candidates and, on sparse pages of hybrid documents, OCR's; a page is sparse under 600 characters."""
    config = Config(DEFAULT.score_weights, Thresholds(min_text_chars_per_page=600), DEFAULT.rules)
    pages = S.pages(spark, sf_dir)
    read = S.ocr_raw(spark, sf_dir).join(K.ocr_pages(pages, K.classify(pages, config), False, config), ["doc_id", "page_index"], "left_semi")
    both = pipeline.both_candidates(C.candidates(S.lines(spark, sf_dir), config), R.ocr_candidates(R.coerce_lines(read), config))
    return O.outline(O.judged(both, config), config)


def _page_headings(spark, sf_dir):
    """What a page's title may be: the heading alone, and with the line it is joined to: doc_id, page_index, ord, title."""
    lines = S.lines(spark, sf_dir)
    held = lines.select("doc_id", "page_index", "line_seq", F.lit(0).alias("gen"), "text").unionByName(C.heading_fragments(lines).filter("single = 0").select("doc_id", "page_index", "line_seq", F.lit(1).alias("gen"), "text"))
    order = Window.partitionBy("doc_id", "page_index").orderBy("gen", "line_seq")
    return held.filter(F.col("text").startswith("第")).select("doc_id", "page_index", (F.row_number().over(order) - 1).alias("ord"), F.col("text").alias("title"))


def _page_offsets(spark, sf_dir):
    entries = P.structural_entries(S.entries(spark, sf_dir))
    return entries, P.page_offset(entries, _page_headings(spark, sf_dir), entries.select("doc_id").distinct().withColumn("start_page", F.lit(1)))


def page_offset(spark, sf_dir):
    return _page_offsets(spark, sf_dir)[1]


def confirm_nodes(spark, sf_dir):
    entries, offsets = _page_offsets(spark, sf_dir)
    counts = S.lines(spark, sf_dir).groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
    return P.confirmed_nodes(entries, offsets, _page_headings(spark, sf_dir), counts, 1).withColumn("confidence", F.round("confidence", 9))


def html_heading_lines(spark, sf_dir):
    """Lines of web pages: what the heading, paragraph, list and bold tags hold, with a size for each tag, and the scores of their text."""
    tag = F.regexp_extract("part", "^<(h1|h2|h3|p|li|b)>", 1)
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(<(?:h1|h2|h3|p|li|b)>[^<]*)"), 1)
    parts = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(found).alias("line_seq", "part"))
    lines = parts.select("page_id", "line_seq", tag.alias("tag"), T.normalize(F.regexp_replace("part", "^<[^>]*>", "")).alias("title")).filter(F.col("title") != "")
    size = F.when(F.col("tag") == "h1", T.lit(22)).when(F.col("tag").isin("h2", "h3"), T.lit(18)).otherwise(T.lit(12))
    return lines.select("*", size.alias("font_size"), F.col("tag").isin("b", "h1", "h2", "h3").alias("is_bold"), T.pattern_score(F.col("title")).alias("pattern"), T.semantic_score(F.col("title")).alias("semantic"), T.numbered_level(F.col("title")).alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_titles, position_pattern_semantic, heading_fragments, body_font_profile, scored_candidates, rule_stats, candidate_cap, font_bucket_levels, accept_reject,
        outline_tree, rejected_nodes, outline_text, classify_documents, ocr_page_routing, ocr_line_coercion, ocr_body_height, ocr_candidates, ocr_accept,
        items_to_lines, same_row_clusters, structural_entries, toc_row_join, toc_extent, cover_node, title_similarity, dedupe_nodes, outline_eval,
        ocr_full_page, page_offset, confirm_nodes, html_heading_lines,
    )
}
