"""Mixing sources to target weights by Poisson replication.

Each document of a source with repetition rate L is repeated as often as a Poisson distribution of mean L says at a
point that a hash of its doc_id and the seed picks; the copies are then put in one global random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.llm.shared import Scratch, partitions, whole_row

#: Bytes of a rate table that is sent to every task; a larger one is joined by key, salted.
SENT_BYTES, SALTS = 8 << 20, 16
#: The distribution is listed within so many deviations of its mean, and so many counts more.
DEVIATIONS, MORE = 12, 40
#: Random orders are numbers below this.
ORDERS = 1 << 52


def unit(*parts: Column | str) -> Column:
    """A double in [0, 1) from a hash of the parts."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, rate: float = 1.0) -> DataFrame:
    """_source, lam, low, cdf: the mean repetitions that give each source its share, and the Poisson distribution of that mean
    from the count ``low`` on.

    A source's share is its weight, or by default its row count to the power ``temperature``, over the sum of all;
    ``rate`` is the size of the result over that of ``docs``. Sources without a weight get none of it.
    The distribution is listed where it rises: both tails left out are below 2**-52, so a list grows with the root of the mean.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "_source string, w double")
        counts = counts.join(given, "_source", "left").fillna(0.0, "w")
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    lam = F.when(F.col("w") > 0, F.col("all_n") * (F.col("w") / F.col("all_w")) / F.col("n") * F.lit(rate)).otherwise(0.0)
    lam = counts.join(F.broadcast(total)).select("_source", lam.alias("lam"))
    up_to = Window.partitionBy("_source").orderBy("k")
    steps = lam.withColumn("k", F.explode(F.expr(f"sequence(0L, cast(ceil(lam + {DEVIATIONS} * sqrt(lam) + {MORE}) AS bigint))")))
    steps = steps.withColumn("lf", F.sum(F.log(F.greatest("k", F.lit(1)))).over(up_to))
    p = F.when(F.col("lam") > 0, F.exp(-F.col("lam") + F.col("k") * F.log("lam") - F.col("lf"))).otherwise(1.0)
    steps = steps.withColumn("cdf", F.sum(p).over(up_to))
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.col("lam") - DEVIATIONS * F.sqrt("lam") - MORE))
    steps = steps.withColumn("low", low).filter(F.col("k") >= F.col("low"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda s: s.cdf)
    return steps.groupBy("_source").agg(F.first("lam").alias("lam"), F.first("low").alias("low"), listed.alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, rate: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, source, anything else) with copy (from 1) and shuffle_key, in the order of shuffle_key.

    A row appears as often as its source's distribution says, perhaps never. A null source is the source ''. Rows of
    equal doc_id are repeated alike, and a null doc_id counts as ''. An empty table gives an empty result. Columns called copy or
    shuffle_key are replaced.
    """
    spark = docs.sparkSession
    table = Scratch(spark, "mixing").table(rates(docs, weights, temperature, rate).select("_source", F.col("low").alias("_low"), F.col("cdf").alias("_cdf")), "rates")
    sent = table.agg(F.coalesce(F.sum(8 * F.size("_cdf") + F.length("_source") + 64), F.lit(0))).first()[0]
    own = docs.select(whole_row(docs, "copy", "shuffle_key"), F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_source"))
    if sent <= SENT_BYTES:
        own = own.join(F.broadcast(table), "_source")
    else:
        own = own.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
        own = own.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_source", "_salt"])
    point = unit("_id", F.lit(str(seed)))
    n = (F.col("_low") + F.size(F.filter("_cdf", lambda c: c <= point))).cast("int")
    copies = own.withColumn("_n", n).filter("_n > 0").select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    key = (unit("_id", "copy", F.lit(f"{seed}:order")) * F.lit(float(ORDERS))).cast("long")
    parts = max(partitions(spark), 8)
    keyed = copies.withColumn("shuffle_key", key)
    # Keys are spread evenly, so ranges of equal width are even partitions, and no sample has to be drawn first.
    width = -(-ORDERS // parts)
    return keyed.repartitionById(parts, F.expr(f"cast(shuffle_key div {width} AS int)")).sortWithinPartitions("shuffle_key", "_id", "copy").select("_row.*", "copy", "shuffle_key")


#: DuckDB SQL for replicated(documents) with its default parameters.
SQL = """
WITH s AS (SELECT coalesce(source, '') AS src, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY 1),
r AS (SELECT src, (SELECT sum(n) FROM s)::DOUBLE * (w / (SELECT sum(w) FROM s)) / n AS lam FROM s),
k AS (SELECT src, lam, unnest(range(0, ceil(lam + 12 * sqrt(lam) + 40)::BIGINT + 1)) AS k FROM r),
f AS (SELECT src, lam, k, sum(ln(greatest(k, 1))) OVER (PARTITION BY src ORDER BY k) AS lf FROM k),
c AS (SELECT src, k, sum(exp(-lam + k * ln(lam) - lf)) OVER (PARTITION BY src ORDER BY k) AS cdf FROM f),
d AS (SELECT *, coalesce(source, '') AS src, ('0x' || substr(md5(doc_id || ':17'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM c WHERE c.src = d.src AND c.cdf <= d.u) AS n FROM d),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
SELECT *, ('0x' || substr(md5(doc_id || ':' || copy || ':17:order'), 1, 13))::BIGINT AS shuffle_key FROM e"""
