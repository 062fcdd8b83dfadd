"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed size. Every distinct block gets an integer name by its place in a
sort, then adjacent names are paired and every distinct pair is named in the same way, until each text is
one integer. Two texts of as many blocks have the same integer only if they are equal, block by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewright.llm.shared import Scratch, blanks_to_space, partitions, whole_row, whole_text

#: Bytes of a block: most texts are a few blocks, and a very long one takes log2(length / BLOCK) rounds.
BLOCK = 4096


def _named(distinct: DataFrame, by: list[str], spread: int) -> DataFrame:
    """``distinct`` with ``name``, from a sort within ``spread`` buckets; equal rows must have been merged."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(spread))
    within = Window.partitionBy("_bucket").orderBy(*by)
    return distinct.withColumn("_bucket", bucket).select(
        *by, ((F.row_number().over(within).cast("long") - 1) * spread + F.col("_bucket")).alias("name")
    )


def _blocks(rows: DataFrame, salt: int) -> DataFrame:
    """One row a block: row key, its number, 128-bit fingerprint, bytes."""
    cut = F.expr(f"transform(sequence(0, n_blocks - 1), k -> struct(k AS k, substring(bytes, k * {BLOCK} + 1, {BLOCK}) AS block))")
    return rows.select("*", F.explode(cut).alias("_b")).select(
        "doc_id",
        "text_sha256",
        "n_blocks",
        F.col("_b.k").cast("long").alias("k"),
        F.xxhash64("_b.block", F.lit(salt)).alias("h1"),
        F.xxhash64(F.lit(salt), "_b.block").alias("h2"),
        F.col("_b.block").alias("block"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text, anything else).

    Texts are equal when they are identical after each run of blanks is one space. A null text is empty;
    all empty texts are one group. Of equal texts the smallest doc_id stays. Rows with the same doc_id and
    equal texts give one row here and count one by one in group_size; the same doc_id with different texts
    gives a row for each. Rows without a doc_id are left out. An empty table gives an empty result.

    Texts are read and cut once and written as blocks; these cross the network once, after equal blocks of a task have
    been merged, and all further rounds move integers. Hot groups: names are joined back by sort-merge joins, which Spark splits where one key is hot.
    """
    spark = docs.sparkSession
    scratch, spread = Scratch(spark, "exact-dedup"), max(64, partitions(spark))
    rows = (
        whole_text(docs)
        .select("doc_id", blanks_to_space(F.col("text")).cast("binary").alias("bytes"))
        .select("doc_id", "bytes", F.sha2("bytes", 256).alias("text_sha256"))
        .withColumn("n_blocks", F.expr(f"greatest(1L, (octet_length(bytes) + {BLOCK - 1}) div {BLOCK})"))
    )
    for salt in range(8):
        # The fingerprint stands for the block's bytes only if it is one-to-one on this corpus: that is checked on the bytes.
        blocks = scratch.table(_blocks(rows, salt), f"cut-{salt}")  # read twice: with the bytes to check, without them to name
        seen = blocks.select("h1", "h2", "block").distinct().groupBy("h1", "h2").agg(F.count("*").alias("variants"))
        seen = scratch.table(seen, f"blocks-{salt}")
        if seen.filter("variants > 1").isEmpty():
            break
    else:
        raise RuntimeError("no one-to-one fingerprint found")
    names = _named(seen.select("h1", "h2"), ["h1", "h2"], spread)
    current = blocks.drop("block").join(names, ["h1", "h2"]).drop("h1", "h2")
    # Repeated rows are one from here on: each of their blocks comes as often as the row does.
    current = current.groupBy("doc_id", "text_sha256", "n_blocks", "k", "name").agg(F.count("*").alias("rows"))
    current = scratch.table(current, "names-0")
    scratch.drop(f"cut-{salt}")
    most = current.agg(F.max("n_blocks")).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(current.filter(F.col("n_blocks") <= 2**level).filter(F.col("n_blocks") > 2**level // 2))
        if 2**level >= most:
            break
        level += 1
        open_ = current.filter(F.col("n_blocks") > 2 ** (level - 1))
        pairs = open_.groupBy("doc_id", "text_sha256", "n_blocks", F.expr("k div 2").alias("k")).agg(
            F.max(F.when(F.col("k") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("k") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("rows").alias("rows"),
        )
        pairs = scratch.table(pairs, f"pairs-{level}")
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"], spread)
        current = scratch.table(pairs.join(names, ["left", "right"]).drop("left", "right"), f"names-{level}")
    whole = reduce(DataFrame.unionByName, done)
    rows_of = whole.select("doc_id", "text_sha256", "n_blocks", "name", "rows")
    groups = rows_of.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    return rows_of.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no smaller doc_id has, with all their columns; one row for each such doc_id.

    Of rows without a doc_id, one stays for each text that no row with a doc_id has.
    """
    staying = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    own = docs.select(whole_row(docs), F.col("doc_id").alias("_id"), F.sha2(blanks_to_space(F.coalesce(F.col("text"), F.lit(""))), 256).alias("_own"))
    once = Window.partitionBy("_id", "_own").orderBy("_own")
    kept = own.join(staying, (F.col("_id") == F.col("_keep")) & (F.col("_own") == F.col("_sha")), "left_semi")
    unnamed = own.filter(F.col("_id").isNull())
    if not unnamed.isEmpty():
        kept = kept.unionByName(unnamed.join(staying, F.col("_own") == F.col("_sha"), "left_anti"))
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")
