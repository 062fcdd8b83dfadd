"""Loaders for the driver's Parquet tables and their mapping to coordination records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; a path that only Spark can open is fine."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as bus events: version, type, ts (TIMESTAMP), source_node_id, value, payload."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("version"),
        F.col("event_type").alias("type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("source_node_id"),
        "value",
        F.col("props").alias("payload"),
    )


def entity_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: one entity per user, the event type decides the operation."""
    op = (
        F.when(F.col("event_type") == "signup", "CREATE")
        .when(F.col("event_type") == "purchase", "TRANSFER")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"),
        F.col("user_id").alias("entity_id"),
        F.concat(F.lit("node-"), (F.col("event_id") % 5).cast("string")).alias("owner"),
        F.col("event_id").alias("version"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        op.alias("operation"),
        "value",
    )
