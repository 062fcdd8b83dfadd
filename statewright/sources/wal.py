"""Log files of JSON lines: reading with checksums, appending, truncation, checkpoints and segment scans."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from statewright.sources.scratch import written

#: The file that names the newest checkpoint; Spark's readers skip names that begin so.
POINTER = "_latest.json"

DATA = "entityId string, ownerNodeId string, version bigint, timestamp bigint, operation string, metadata string, previousVersion bigint"
ENTRY = f"logSequenceNumber bigint, timestamp bigint, checksum string, data struct<{DATA.replace(' string', ':string').replace(' bigint', ':bigint')}>"


def parsed(lines: DataFrame, *more: str) -> DataFrame:
    """lsn, ts, valid and the fields of the change (and ``more``) for each line (column value) that is a log entry; others are left out.

    The checksum is the SHA-256 of the text of ``data``, which is the last field that writers put in a line, so it is taken
    from the line as it stands: no other program's number format has to be met. A line without a checksum is valid.
    """
    raw = F.regexp_extract("value", r'"data":(\{.*\})\}\s*$', 1)
    entry = F.from_json("value", ENTRY)
    # A line is parsed once: fields of a parsed column alone would each have the line parsed again.
    rows = lines.select(F.explode(F.array(entry)).alias("e"), raw.alias("raw"), *more).filter(F.col("e.logSequenceNumber").isNotNull() & F.col("e.data").isNotNull())
    valid = F.col("e.checksum").isNull() | (F.sha2("raw", 256) == F.col("e.checksum"))
    data = [F.col(f"e.data.{name}").alias(alias) for name, alias in (
        ("entityId", "entity_id"), ("ownerNodeId", "owner"), ("version", "version"), ("timestamp", "changed_at"),
        ("operation", "operation"), ("metadata", "metadata"), ("previousVersion", "previous_version"),
    )]
    return rows.select(F.col("e.logSequenceNumber").alias("lsn"), F.col("e.timestamp").alias("ts"), valid.alias("valid"), *data, *more)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The valid entries with first <= lsn <= last, with the file each is from."""
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))
    found = parsed(lines.select("value")).filter("valid").drop("valid")
    if first is not None:
        found = found.filter(F.col("lsn") >= first)
    return found if last is None else found.filter(F.col("lsn") <= last)


def lines(changes: DataFrame) -> DataFrame:
    """value: a log line with its checksum for each change (lsn, ts, entity_id, owner, version, changed_at, operation)."""
    data = F.to_json(F.struct(F.col("entity_id").alias("entityId"), F.col("owner").alias("ownerNodeId"), "version", F.col("changed_at").alias("timestamp"), "operation"))
    head = F.concat(F.lit('{"logSequenceNumber":'), F.col("lsn").cast("string"), F.lit(',"timestamp":'), F.col("ts").cast("string"), F.lit(',"checksum":"'))
    return changes.select(F.concat(head, F.sha2(data, 256), F.lit('","data":'), data, F.lit("}")).alias("value"))


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def log_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a log's files; none where there is no log."""
    fs, at = _hadoop(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def append(changes: DataFrame, path: str, next_lsn: int, order: str, max_bytes: int | None = None) -> int:
    """Writes ``changes`` as new files of the log, numbered from ``next_lsn`` in ``order``; the next free number.

    The rows are first written in sorted ranges of ``order`` with their range and their place in it: what is counted, and what
    is numbered by prefix sums of those counts, is the same table, however Spark plans the two. A log of more than
    ``max_bytes`` takes no more.
    """
    spark = changes.sparkSession
    if max_bytes is not None and (size := log_bytes(spark, path)) > max_bytes:
        raise ValueError(f"the log has {size} bytes, more than {max_bytes}")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The row's place in its range stands in the lower 33 bits of the number that the task which writes it gives.
    sorted_ = changes.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ordered = written(sorted_, "log-append").withColumn("_p", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = ordered.join(F.broadcast(before.select("_p", "_base")), "_p").withColumn("lsn", F.lit(next_lsn) + F.col("_base") + place)
    lines(numbered).write.mode("append").text(path)
    return next_lsn + ordered.count()


def replayed(entries: DataFrame, handle: Callable[[dict], None], key: str = "entity_id", order: str = "lsn", keep: Sequence[str] = ()) -> DataFrame:
    """key, order, error, and the columns ``keep`` of the entry: ``handle`` called with each entry (a dictionary), in order for
    each key; error is null where it worked.

    An entry that fails is left behind and the next one goes on. ``handle`` runs in the tasks, once more if a task is repeated.
    """
    names = [key, order, *keep]
    out = StructType([entries.schema[c] for c in names]).add("error", "string")
    types = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.schema.names
            errors = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    handle(dict(zip(columns, row, strict=True)))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a handler raises, the replay goes on
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            found = [batch.column(columns.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*found, pa.array(errors, pa.string())], schema=types)

    return entries.repartition(key).sortWithinPartitions(key, order).mapInArrow(task, out)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """file, start_lsn, end_lsn, entry_count, tombstone_count, size_bytes of each log file that has entries."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"))
    entry = F.from_json("value", ENTRY)
    rows = raw.select("file", "size_bytes", F.explode(F.array(entry)).alias("e")).select("file", "size_bytes", F.col("e.logSequenceNumber").alias("lsn"), F.col("e.data.operation").alias("operation")).filter("lsn IS NOT NULL")
    return rows.groupBy("file").agg(
        F.min("lsn").alias("start_lsn"), F.max("lsn").alias("end_lsn"), F.count("*").alias("entry_count"),
        F.count_if(F.col("operation") == "DELETE").alias("tombstone_count"), F.first("size_bytes").alias("size_bytes"),
    )


def truncated(entries: DataFrame, before: int) -> DataFrame:
    """The entries from LSN ``before`` on."""
    return entries.filter(F.col("lsn") >= before)


def truncate(spark: SparkSession, path: str, before: int) -> None:
    """Rewrites the log without its lines below LSN ``before`` and without damaged ones.

    Only files that have such lines are touched. What stays of them is written to a hidden folder in the log, then each old
    file goes and the new ones come in by renaming.
    """
    fs, _ = _hadoop(spark, path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    name = uuid.uuid4().hex[:8]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    kept = parsed(rows, "value", "file").filter(F.col("valid") & (F.col("lsn") >= before)).select("file", "value")
    counts = rows.groupBy("file").agg(F.count("*").alias("n")).join(kept.groupBy("file").agg(F.count("*").alias("kept")), "file", "left")
    touched = [r.file for r in counts.filter("kept IS NULL OR kept < n").select("file").collect()]  # names of files, not rows
    if not touched:
        return
    hidden = f"{path.rstrip('/')}/_truncated-{name}"
    parsed(spark.read.text(touched), "value").filter(F.col("valid") & (F.col("lsn") >= before)).select("value").write.text(hidden)
    for file in touched:
        if not fs.delete(of(spark._jvm.java.net.URI(file)), False):
            raise OSError(f"{file} could not be replaced; what stays of the old files is in {hidden}")
    for new in fs.listStatus(of(hidden)):
        if new.getLen() and not new.getPath().getName().startswith(("_", ".")) and not fs.rename(new.getPath(), of(f"{path.rstrip('/')}/{new.getPath().getName()}")):
            raise OSError(f"{new.getPath()} could not be put into the log")
    fs.delete(of(hidden), True)


def write_checkpoint(state: DataFrame, path: str, lsn: int, keep: int | None = None) -> None:
    """The state after ``lsn`` as one partition of the checkpoint table, which the pointer then names; the newest ``keep`` stay."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{path}/lsn={lsn}")
    fs, at = _hadoop(spark, path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    out = fs.create(of(f"{path}/{POINTER}"), True)
    out.write(bytearray(json.dumps({"lsn": lsn}).encode()))
    out.close()
    if keep:
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        for old in sorted((int(n[4:]) for n in names if n.startswith("lsn=")), reverse=True)[keep:]:
            fs.delete(of(f"{path}/lsn={old}"), True)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """lsn of each checkpoint that is there."""
    fs, at = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return spark.createDataFrame([(int(n[4:]),) for n in names if n.startswith("lsn=")], "lsn long")


def _pointed(spark: SparkSession, path: str) -> int:
    """What the pointer names. Spark's readers skip its file, so it is opened by Hadoop's."""
    fs, _ = _hadoop(spark, path)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["lsn"]
    finally:
        stream.close()


def read_checkpoint(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """The checkpoint that the pointer names, or the newest at or before ``target``; only its partition is read."""
    if target is None:
        at = _pointed(spark, path)
    else:
        at = checkpoints(spark, path).filter(F.col("lsn") <= target).agg(F.max("lsn")).first()[0]
        if at is None:
            raise ValueError(f"there is no checkpoint at or before {target}")
    return spark.read.parquet(f"{path}/lsn={at}").withColumn("lsn", F.lit(at).cast("long"))


def seed_nodes(spark: SparkSession, text: str) -> DataFrame:
    """id, address, port of the ``- id: host:port`` entries of a seed list (a configuration of a few lines)."""
    rows = []
    for line in text.splitlines():
        entry = line.split("#")[0].strip()
        if entry.startswith("- ") and entry.count(":") >= 1:
            parts = [p.strip().strip("'\"") for p in entry[2:].rsplit(":", 2)]
            name, host = (parts[0], parts[-2]) if len(parts) == 3 else (parts[0], parts[0])
            if parts[-1].isdigit():
                rows.append((name, host, int(parts[-1])))
    return spark.createDataFrame(rows, "id string, address string, port int")
