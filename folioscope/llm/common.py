"""What the operators share: the shared folder, written tables, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import clean, drop_durable, durable, fresh_path, shared_dir

__all__ = ["WHITE", "clean", "drop_durable", "durable", "fresh_path", "id_text", "join_unique", "numbered", "only_rows", "read_table", "shared_dir", "ship", "spare", "task_count"]

#: Whitespace that parts words: space and U+0009 to U+000D. ``bytes.split()`` parts at the same six.
WHITE = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' path, those that join later included."""
    sc = spark.sparkContext
    if getattr(sc, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="folioscope-code-"), "folioscope-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._folioscope_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the size of the job decides them, not these operators."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The columns an operator reads, under fixed names; other columns, whatever their names, stay behind. A row number comes along where one is named."""
    row = [F.col(f"`{row_col}`").cast("long").alias("row")] if row_col else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row)


#: Keys with more than a PARTS-th of the rows are joined by broadcast: there can't be PARTS of them.
PARTS = 1024


def join_unique(left: DataFrame, right: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``held`` how many of left's ``total`` rows have it.

    A key with more than total / PARTS rows would gather them in one task. Since the rows add up to ``total``, fewer than
    PARTS keys can, so these are broadcast whatever the input's size, and the others are shuffled. ``left`` is read twice.
    A null key joins nothing.
    """
    heavy = F.broadcast(right.filter(F.col(held) > total / PARTS))
    light = right.filter(F.col(held) <= total / PARTS)
    few = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(heavy, key).unionByName(few.join(light, key))


def spare(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of the columns has, whatever their case."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan only reads files: columns may be chosen, nothing else happens."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() == "Project" and node.deterministic():
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the number's column, which is new whatever columns there are.

    The number tells the task and the place in it, and must be the same whenever the table is read. Reading files it is, as
    files are always parted alike and a task that runs again reads the same; anything else is written first.
    """
    name = spare(docs.columns, "row")
    out = docs.withColumn(name, F.monotonically_increasing_id())
    return (out if _is_scan(docs) else durable(out, "numbered")), name


def only_rows(docs: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table whose numbers are in kept.row, without the number."""
    return docs.join(kept.select(F.col("row").alias(name)), name, "left_semi").drop(name)
