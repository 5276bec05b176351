"""Which packages of a package lock file (JSON, ``packages`` by path) have a licence that isn't wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences that aren't wanted (fixed value).
UNWANTED = r"(?i)\b(A?GPL|LGPL)\b"


def unwanted_licenses(spark: SparkSession, path: str, excepted: tuple[str, ...] = (), pattern: str = UNWANTED) -> DataFrame:
    """package, license of installed packages whose licence matches; ``excepted`` are names that may have it. Reads one lock file or a folder of them."""
    kind = "struct<packages:map<string,struct<name:string,license:string>>>"
    held = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["packages"]).alias("package", "told"))
    found = held.filter(F.col("package").startswith("node_modules/")).select("package", F.col("told.name").alias("name"), F.coalesce("told.license", F.lit("")).alias("license"))
    return found.filter(F.col("license").rlike(pattern) & ~F.coalesce(F.col("name").isin(*excepted), F.lit(False))).select("package", "license")
