"""Outlines and reports as JSON, a row per document."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ("confidence", "level", "page_index", "source", "title")


def outline_json(nodes: DataFrame) -> DataFrame:
    """doc_id, json: the nodes of each outline in order, keys sorted."""
    held = F.array_sort(F.collect_list(F.struct("node_seq", F.struct(*NODE).alias("node"))))
    return nodes.groupBy("doc_id").agg(held.alias("h")).select("doc_id", F.to_json(F.col("h.node"), {"ignoreNullFields": "false"}).alias("json"))


def report(nodes: DataFrame, classes: DataFrame, rejected: DataFrame) -> DataFrame:
    """doc_id, then what became of each document: its class, the nodes kept and the nodes rejected by reason."""
    kept = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("node_count"), F.avg("confidence").alias("avg_confidence"))
    out = rejected.groupBy("doc_id", "reason").count().groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("rejected"))
    return classes.join(kept, "doc_id", "left").join(out, "doc_id", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in a folder, for any number of documents."""
    rows.write.mode("overwrite").json(path)


def write_one(json_text: str, path: str) -> None:
    """One document's JSON as a file for people: sorted keys, indented, folders made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(json_text), sort_keys=True, indent=2, ensure_ascii=False) + "\n")
