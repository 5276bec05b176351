"""Holds a made outline against the one a document came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as M
from ..functions.text import lit, units

ALIKE, FAR, NEAR = 0.72, 999, 2


_PARTS = ("node_seq", "title", "level", "page_index", "key")


def _sides(original: DataFrame, made: DataFrame) -> DataFrame:
    """doc_id, original and made: a document's nodes of either kind as arrays, by one shuffle."""
    side = lambda df, name: df.select("doc_id", F.struct("node_seq", "title", "level", "page_index", M.match_key(F.col("title")).alias("key")).alias(name))
    both = side(original, "original").unionByName(side(made, "made"), allowMissingColumns=True)
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_list("original")).alias("original"), F.array_sort(F.collect_list("made")).alias("made"))


def _paired(sides: DataFrame) -> DataFrame:
    """Each original node with the best made one of its document, as structs o and m, with similarity, page_delta and fits.

    The best possible is a node of the same key on the same page; an original node that has one needs no other comparison.
    """
    each = sides.select("doc_id", F.explode("original").alias("o"), "made", F.size("made").cast("long").alias("made_count"))
    same = F.filter("made", lambda m: (m["key"] == F.col("o.key")) & (F.col("o.key") != "") & (m["page_index"] == F.col("o.page_index")))
    each = each.withColumn("made", F.when(F.col("o").isNull(), F.slice("made", 1, 1)).when(F.size(same) > 0, F.slice(same, 1, 1)).otherwise(F.col("made")))
    pairs = each.select("doc_id", "o", "made_count", F.explode_outer("made").alias("m"))
    a, b = F.col("o.key"), F.col("m.key")
    pairs = pairs.withColumn("similarity", F.coalesce(M.key_similarity(a, b, units(a) + units(b)), lit(0)))
    begins = (a.startswith(b) & (units(b) >= 2)) | (b.startswith(a) & (units(a) >= 2))
    fits = F.coalesce((a != "") & (b != "") & ((a == b) | begins | (F.col("similarity") >= lit(ALIKE))), F.lit(False))
    delta = F.when(F.col("m.node_seq").isNotNull(), F.coalesce(F.abs(F.col("o.page_index") - F.col("m.page_index")), F.lit(FAR)))
    scored = pairs.withColumn("fits", fits).withColumn("page_delta", delta)
    score = F.col("fits").cast("double") + F.col("similarity") * lit(0.1) - F.least(F.col("page_delta"), F.lit(50)) * lit(0.01)
    best = F.max_by(F.struct("m", "similarity", "page_delta", "fits", "o", "made_count"), F.struct(F.coalesce(score, lit(0)), -F.coalesce("m.node_seq", F.lit(0))))
    return scored.groupBy("doc_id", F.col("o.node_seq").alias("seq")).agg(best.alias("b")).select("doc_id", "b.*")


def _claimed(paired: DataFrame) -> DataFrame:
    able = paired.withColumn("able", F.col("fits") & (F.col("page_delta") <= NEAR))
    claim = F.row_number().over(Window.partitionBy("doc_id", "m.node_seq", "able").orderBy("o.node_seq"))
    return able.withColumn("matched", F.coalesce(F.col("able") & (claim == 1), F.lit(False)))


def matches(original: DataFrame, made: DataFrame) -> DataFrame:
    """A row per original node (doc_id, node_seq, title, level, page_index): the best made node of its document, and ``matched``.

    A made node is claimed by the first original node that fits it.
    """
    names = [F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("o", "original"), ("m", "made")) for c in _PARTS[:-1]]
    return _claimed(_paired(_sides(original, made))).select("doc_id", *names, F.round("similarity", 3).alias("similarity"), "page_delta", "matched")


def extras(original: DataFrame, made: DataFrame) -> DataFrame:
    """Made nodes that no original node claims."""
    claimed = matches(original, made).filter("matched").select("doc_id", F.col("made_node_seq").alias("node_seq"))
    return made.join(claimed, ["doc_id", "node_seq"], "left_anti")


def evaluation(original: DataFrame, made: DataFrame) -> DataFrame:
    """Counts, recall and precision for each document with an outline of either kind. Either side is read once."""
    sides = _sides(original, made)
    hit, delta = F.col("matched"), F.col("page_delta")
    # A document with made nodes alone keeps a row, of an original node that isn't there.
    none = F.array(F.lit(None).cast(sides.schema["original"].dataType.elementType))
    sized = _claimed(_paired(sides.withColumn("original", F.when(F.size("original") > 0, F.col("original")).otherwise(none))))
    both = sized.groupBy("doc_id").agg(F.first("made_count").alias("made_count"), F.count("o.node_seq").alias("original_count"), F.count_if(hit).alias("matched_count"), F.count_if(hit & (delta == 0)).alias("exact_page_matches"), F.count_if(hit & (delta <= 1)).alias("within_1_page"), F.count_if(hit & (delta <= 2)).alias("within_2_pages"))
    share = lambda n: F.when(F.col(n) == 0, lit(0)).otherwise(F.round(F.col("matched_count") / F.col(n), 3))
    return both.select("*", share("original_count").alias("recall"), share("made_count").alias("precision"))
