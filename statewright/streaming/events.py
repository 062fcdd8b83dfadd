"""Event streams: windows, dedup, rate limits and durable subscription. All time is event time under a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statewright.operators.flow import SharedState
from statewright.sources.scratch import shared_path, written
from statewright.sources.wal import replayed


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: str, lateness: str) -> DataFrame:
    """Inactivity windows; rows later than ``lateness`` behind the newest are dropped. For append mode."""
    found = events.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return found.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events")).drop("w")


def once(events: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """The first row of each key within ``ttl``; state older than the watermark is dropped."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def rolling_counters(events: DataFrame, keys: Sequence[str], ts: str, value: str, window: str, lateness: str) -> DataFrame:
    """Sums and counts of each key in tumbling windows."""
    found = events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, window).alias("w"))
    return found.agg(F.sum(value).alias("total"), F.count("*").alias("events")).select(*keys, "w.start", "w.end", "total", "events")


#: Groups over which the keys of a stateful fold are dealt: a call of Python for each key of each batch takes longer than its rows.
GROUPS = 1024


def _grouped(events: DataFrame, key: str):
    """``events`` by group of keys; the state of a group lists its keys. The number is fixed, as checkpoints hold the groups."""
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)))  # pandas has no nulls among integers
    return events.withColumn("_group", group).groupBy("_group")


def _names(column: pd.Series) -> list:
    return [None if pd.isna(k) else k for k in column.tolist()]


def token_bucket(events: DataFrame, key: str, micros: str, seq: str, a_second: float, burst: float) -> DataFrame:
    """key, seq, allowed: the batch token bucket over a stream; a key's state is its tokens and its last time.

    Rows of a batch are taken in time order; rows behind the key's last time refill nothing.
    """

    def refill(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (last, tokens) for k, last, tokens in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values([micros, seq])
        allowed = []
        names = _names(rows[key])
        for name, t in zip(names, rows[micros].tolist(), strict=True):
            last, tokens = held.get(name, (t, burst))
            tokens = min(burst, tokens + max(0, t - last) / 1e6 * a_second)
            allowed.append(tokens >= 1)
            held[name] = (max(t, last), tokens - (tokens >= 1))
        state.update(([*held], [last for last, _ in held.values()], [tokens for _, tokens in held.values()]))
        yield pd.DataFrame({key: names, seq: rows[seq].tolist(), "allowed": allowed})

    kept = "names array<long>, last array<long>, tokens array<double>"
    return _grouped(events, key).applyInPandasWithState(refill, f"{key} long, {seq} long, allowed boolean", kept, "append", GroupStateTimeout.NoTimeout)


def subscribe(events: DataFrame, types: Sequence[str], handle: Callable[[DataFrame, int], None], dead_letters: str, checkpoint: str) -> StreamingQuery:
    """Gives the rows of ``types`` to ``handle`` batch by batch; a batch that fails goes to ``dead_letters``.

    Progress is in ``checkpoint``: a restart resumes after the last batch done. Runs until what is there is done.
    """

    def one(batch: DataFrame, number: int) -> None:
        wanted = batch.filter(F.col("type").isin(*types))
        try:
            handle(wanted, number)
        except Exception as error:  # noqa: BLE001  whatever a handler raises, the stream goes on
            wanted.withColumn("error", F.lit(str(error)[:500])).write.mode("append").parquet(dead_letters)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe_each(
    events: DataFrame, types: Sequence[str], handle: Callable[[dict], None], state: str, checkpoint: str, version: str = "version", every: int = 10
) -> StreamingQuery:
    """Calls ``handle`` with each event (a dictionary) of ``types``, in order of ``version`` within a type.

    An event that ``handle`` raises for goes alone to the table ``state``/dead (with the error) and does not count. After each
    batch in which ``every`` successes have come together, ``state``/progress gets the highest version that is done. A restart,
    also one with a new ``checkpoint``, leaves out events up to that version; what was handled after it is handled again.
    Handlers run in the tasks. Runs until what is there is done.
    """
    spark = events.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        done = _progress(spark, f"{state}/progress")
        wanted = batch.filter(F.col("type").isin(*types)).filter(F.col(version) > done.version)
        results = written(replayed(wanted, handle, "type", version), "subscription")
        failed = wanted.join(results.filter("error IS NOT NULL"), ["type", version])
        if not failed.isEmpty():
            failed.write.mode("append").parquet(f"{state}/dead")
        worked = results.agg(F.count_if(F.col("error").isNull()).alias("n"), F.max(version).alias("version")).first()
        count = done.since + worked.n
        if worked.version is not None:
            reached = max(done.seen, worked.version)
            row = (reached, count % every, reached) if count >= every else (done.version, count, reached)
            spark.createDataFrame([(number, *row)], "batch long, version long, since long, seen long").coalesce(1).write.mode("append").parquet(f"{state}/progress")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _progress(spark: SparkSession, path: str) -> Row:
    """version (done), since (successes after it), seen (the highest version met) of a subscription."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    none = Row(version=-1, since=0, seen=-1)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return none
    return spark.read.parquet(path).agg(F.max_by(F.struct("version", "since", "seen"), F.struct("seen", "batch")).alias("p")).first().p or none


def session_state(updates: DataFrame, session: str, order: Sequence[str], update: str, adapter: SharedState, load: Callable[[str], object], idle_us: int | None = None, ts: str | None = None) -> DataFrame:
    """session, updates, state: each session's state, as ``adapter`` serializes it, after each batch that has updates for it.

    Only the text is kept between batches; ``load`` reads it back. With ``ts`` (a timestamp under a watermark) a session that has been
    idle for ``idle_us`` is dropped and starts anew.
    """
    kind = updates.schema[session].dataType.simpleString()

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: tuple(kept) for k, *kept in zip(*state.get, strict=True)} if state.exists else {}
        news: dict[object, list] = {}
        newest: dict[object, int] = {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(list(order))
            for name, value in zip(_names(rows[session]), rows[update].tolist(), strict=True):
                news.setdefault(name, []).append(value)
            if idle_us:
                for name, t in zip(_names(rows[session]), rows[ts].tolist(), strict=True):
                    newest[name] = max(newest.get(name, 0), int(t.timestamp() * 1000))
        for name, values in news.items():
            n, text, _until = held.get(name, (0, None, None))
            inner = adapter.create() if text is None else load(text)
            for value in adapter.merge(values):
                inner = adapter.apply(inner, value)
            until = max(state.getCurrentWatermarkMs() + 1, newest[name] + idle_us // 1000) if idle_us else 0
            held[name] = (n + len(values), adapter.serialize(inner), until)
        if idle_us:  # sessions without updates in this batch that have been idle for too long
            held = {k: kept for k, kept in held.items() if k in news or kept[2] >= state.getCurrentWatermarkMs()}
        if not held:
            state.remove()
        else:
            state.update(([*held], *[list(kept) for kept in zip(*held.values(), strict=True)]))
            if idle_us:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(until for _, _, until in held.values())))
        if news:
            yield pd.DataFrame({session: [*news], "updates": [held[k][0] for k in news], "state": [held[k][1] for k in news]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle_us else GroupStateTimeout.NoTimeout
    kept_ = f"names array<{kind}>, updates array<long>, states array<string>, until array<long>"
    return _grouped(updates, session).applyInPandasWithState(step, f"{session} {kind}, updates long, state string", kept_, "update", timeout)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for the files that are there, as a table in the shared folder (its checkpoint lies beside it)."""
    spark = stream.sparkSession
    at = shared_path(spark, "stream")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows").select(*stream.columns)
