"""Conflicts between replicas of one service, and their resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far each strategy is trusted.
CONFIDENCE = {"max-value": 0.9, "min-value": 0.9, "average": 0.7, "union-merge": 0.8, "last-writer-wins": 0.6, "first-writer-wins": 0.8}


def version_conflicts(replicas: DataFrame, key: str, version: str) -> DataFrame:
    """Services that replicas have in different versions."""
    found = replicas.groupBy(key).agg(F.count("*").alias("replicas"), F.min(version).alias("lowest"), F.max(version).alias("highest"))
    return found.filter("replicas > 1 AND lowest <> highest")


def stat_conflicts(stats: DataFrame, key: str, name: str, value: str, share: float = 0.2, absolute: float = 10.0) -> DataFrame:
    """Statistics (key, name, value; one row a replica) that spread by over a share of their mean, or over an absolute bound."""
    found = stats.groupBy(key, name).agg(F.count("*").alias("replicas"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"))
    return found.filter((F.col("replicas") > 1) & ((F.col("spread") > F.col("mean") * share) | (F.col("spread") > absolute)))


def metadata_conflicts(fields: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Metadata fields (key, name, value as JSON) with different values."""
    found = fields.groupBy(key, name).agg(F.count("*").alias("replicas"), F.min(value).alias("_a"), F.max(value).alias("_b"), F.countDistinct(value).alias("values"))
    return found.filter("replicas > 1 AND _a <> _b").drop("_a", "_b")


def resolved(values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each conflict the value of every strategy: highest, lowest, average, majority (the first of the most frequent), first.

    The last- and the first-writer rule both take the first value in ``order``.
    """
    counts = values.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("average"),
        F.max_by(value, F.struct("_n", -F.col("_first"))).alias("majority"),
        F.min_by(value, "_first").alias("first_value"),
    )


def union_merged(values: DataFrame, key: str, items: str) -> DataFrame:
    """The distinct elements of all arrays of a key, sorted."""
    return values.select(key, F.explode(items).alias("_i")).groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias(items))


def confidence(values: DataFrame, key: str, value: str, strategy: str) -> DataFrame:
    """key, confidence: similarity of the values times the strategy's factor, within 0.1 and 1; a single value is certain."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("_n"))
    found = counts.groupBy(key).agg(F.sum("_n").alias("_all"), F.count("*").alias("_unique"), F.max("_n").alias("_most"))
    similarity = 1 - (F.col("_unique") - 1) / F.nullif(F.col("_all") - 1, F.lit(0))
    factor = F.when(F.col("_most") / F.col("_all") > 0.6, 0.9).otherwise(0.6) if strategy == "majority" else F.lit(CONFIDENCE.get(strategy, 0.8))
    score = F.when(F.col("_all") <= 1, 1.0).otherwise(F.least(F.greatest(similarity * factor, F.lit(0.1)), F.lit(1.0)))
    return found.select(key, score.alias("confidence"))


def pattern_matches(field: Column, pattern: str) -> Column:
    """A field pattern in which * stands for anything; it must match the whole field."""
    return field.rlike("^(?:" + pattern.replace("*", ".*") + ")$")


def strategy_of(field: Column, kind: Column, by_pattern: list[tuple[str, str]], by_kind: dict[str, str], default: str) -> Column:
    """The strategy of the first field pattern that matches, else that of the conflict's kind, else the default."""
    out = F.lit(default)
    for name, strategy in by_kind.items():
        out = F.when(kind == name, strategy).otherwise(out)
    for pattern, strategy in reversed(by_pattern):
        out = F.when(pattern_matches(field, pattern), strategy).otherwise(out)
    return out


def with_resolutions(state: DataFrame, resolutions: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Rows (key, name, value) with the resolved value of their key and name where there is one."""
    new = resolutions.select(key, name, F.col(value).alias("_r"))
    return state.join(new, [key, name], "left").withColumn(value, F.coalesce("_r", value)).drop("_r")


def object_union(values: DataFrame, key: str, objects: str, order: str) -> DataFrame:
    """key, objects: the entries of all maps of a key; of an entry that several have, the last by ``order``."""
    entries = values.select(key, F.col(order).alias("_o"), F.explode(objects).alias("_k", "_v"))
    last = entries.groupBy(key, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(objects))


def resolved_by(values: DataFrame, key: str, value: str, order: str, strategy: str, resolver: Callable[[list], object]) -> DataFrame:
    """key, value for conflicts whose ``strategy`` column names ``resolver`` (by its __name__): what the caller's function makes of
    the values in order. A conflict's values are one a replica, so they are few."""
    kind = values.schema[value].dataType
    own = values.filter(F.col(strategy) == resolver.__name__)
    listed = own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda r: r.v).alias("_v"))

    @F.pandas_udf(kind)
    def made(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: resolver(list(x)))

    return listed.select(key, made("_v").alias(value))


def history(resolutions: DataFrame, at: str, n: int) -> DataFrame:
    """The ``n`` latest resolutions."""
    return resolutions.orderBy(F.desc(at)).limit(n)


def preview(state: DataFrame, resolutions: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, name, before, after of the values that ``resolutions`` would change; nothing is written."""
    new = resolutions.select(key, name, F.col(value).alias("after"))
    changed = state.select(key, name, F.col(value).alias("before")).join(new, [key, name])
    return changed.filter(~F.col("before").eqNullSafe(F.col("after")))
