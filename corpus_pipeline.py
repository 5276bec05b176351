"""The corpus pipeline: quality rules, exact duplicates, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what a stage returns to the
shared folder as Parquet and reads it again for the next. The first four return the columns of ``documents``: rejected and
duplicate rows are gone, and personal data is masked in ``text`` with ``n_chars`` counted anew. The last returns the pieces
of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import durable, read_table
from folioscope.llm.exact import keep_first
from folioscope.llm.packing import pack
from folioscope.llm.private import mask
from folioscope.llm.quality import keep_good
from folioscope.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]
#: Token ids and learned rules are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, f"stage-{k}")
    return docs
