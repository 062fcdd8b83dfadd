"""Tables written to the folder that all executors share, and common input handling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One space, tab, newline, vertical tab, form feed or carriage return.
BLANK = r"[\x20\x09-\x0D]+"


#: Spark deletes the shuffle files of an execution when it ends where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (tests), a folder beside the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Parquet tables of one operator call, in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written and read again; the shuffle files that only this needed go when it is done."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more`` of the rows that have a doc_id."""
    return docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def whole_row(docs: DataFrame, *but: str) -> Column:
    """_row: all columns of ``docs`` in one, so that whatever they are called, names of an operator's own do not clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("_row")


def blanks_to_space(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, " ")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
