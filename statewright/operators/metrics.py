"""Metrics: counters, gauges, bounded histograms, percentiles, buckets, trends and text exports."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.operators.ordered import folded

# Fixed value: upper bounds of the default buckets; the last, unbounded one holds everything.
BUCKETS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0)


def label_suffix(labels: Column) -> Column:
    """{k="v",...} with the keys sorted; nothing for no labels."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise("")


def with_labels(labels: Column, defaults: dict[str, str]) -> Column:
    """``labels`` over the registry's default labels."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map()
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(labels, k)) if defaults else base
    return F.map_concat(kept, labels) if defaults else labels


def counters(observed: DataFrame, prefix: str = "", defaults: dict[str, str] | None = None) -> DataFrame:
    """series, value: the sum of the increments of each name and label set."""
    name = F.concat(F.lit(f"{prefix}_" if prefix else ""), F.col("name"), label_suffix(with_labels(F.col("labels"), defaults or {})))
    return observed.groupBy(name.alias("series")).agg(F.sum("value").alias("value"))


def gauges(observed: DataFrame, key: str, seq: str = "seq", kind: str = "kind", value: str = "value") -> DataFrame:
    """key, value: the last ``set`` and the ``inc`` and ``dec`` that follow it (all of them without a set)."""
    last = observed.groupBy(key).agg(F.max_by(F.when(F.col(kind) == "set", F.struct(seq, value)), F.when(F.col(kind) == "set", F.col(seq))).alias("_s"))
    signed = F.when(F.col(kind) == "inc", F.col(value)).when(F.col(kind) == "dec", -F.col(value)).otherwise(0.0)
    after = observed.join(last, key).filter(F.col("_s").isNull() | (F.col(seq) > F.col(f"_s.{seq}")))
    moved = after.groupBy(key).agg(F.sum(signed).alias("_moved"))
    return last.join(moved, key, "left").select(key, (F.coalesce(f"_s.{value}", F.lit(0.0)) + F.coalesce("_moved", F.lit(0.0))).alias("value"))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least a share ``p`` of all values at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def linear(value: str, p: float) -> Column:
    """The percentile at rank p * (n - 1), interpolated."""
    return F.percentile(value, p)


def histograms(observed: DataFrame, keys: Sequence[str], seq: str, value: str, capacity: int = 1000) -> DataFrame:
    """count, sum, min, max, mean and p50, p90, p99 (nearest rank) of each key's last ``capacity`` observations."""
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    kept = observed.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= capacity)
    return kept.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        nearest_rank(value, 0.5).alias("p50"),
        nearest_rank(value, 0.9).alias("p90"),
        nearest_rank(value, 0.99).alias("p99"),
    )


def rolling_histogram(observed: DataFrame, keys: Sequence[str], seq: str, value: str, capacity: int, p: float) -> DataFrame:
    """``observed`` with rolling_count, rolling_sum and rolling_p over the last ``capacity`` rows; Spark frames no
    ordered-set aggregate, so the frame's values are sorted in an array of at most ``capacity``."""
    frame = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-(capacity - 1), 0)
    values = F.array_sort(F.collect_list(value).over(frame))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(values))).cast("int")
    return observed.select(
        "*", F.count("*").over(frame).alias("rolling_count"), F.sum(value).over(frame).alias("rolling_sum"), F.element_at(values, rank).alias("rolling_p")
    )


def rolling_linear(observed: DataFrame, keys: Sequence[str], micros: str, value: str, span: int, p: float) -> DataFrame:
    """``observed`` with rolling_p over the rows of the last ``span`` microseconds, interpolated.

    A key's time is cut in slices of ``span``, which are folded apart; a slice also gets the rows of the one before it, which
    its first frames reach into. A fold holds one frame's values in order, so a row does not sort its frame again.
    """
    rest = [c for c in observed.columns if c not in keys]
    of = F.floor(F.col(micros) / span)
    own = observed.withColumn("_slice", of).withColumn("_own", F.lit(True))
    before = observed.filter(F.col(micros).isNotNull()).withColumn("_slice", of + 1).withColumn("_own", F.lit(False))

    def at_p(ordered: list, nans: int) -> float | None:
        n = len(ordered) + nans
        if not n:
            return None
        place = (n - 1) * p
        low, high = math.floor(place), math.ceil(place)
        a, b = (ordered[k] if k < len(ordered) else math.nan for k in (low, high))
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    def flushed(state):
        waiting, state["waiting"] = state["waiting"], []
        if not waiting:
            return ()
        found = at_p(state["ordered"], state["nans"])
        return [(*row, found) for row in waiting]

    def step(state, t, v, mine, *row):
        given = ()
        if t != state["at"]:  # rows of the same time share a frame
            given, state["at"] = flushed(state), t
            frame, ordered = state["frame"], state["ordered"]
            while frame and frame[0][0] < t - span:
                gone = frame.popleft()[1]
                if gone != gone:
                    state["nans"] -= 1
                else:
                    del ordered[bisect_left(ordered, gone)]
        if v is not None:
            state["frame"].append((t, v))
            if v != v:
                state["nans"] += 1
            else:
                insort(state["ordered"], v)
        if mine:
            state["waiting"].append(row)
        return state, given

    start = lambda: {"at": None, "frame": deque(), "ordered": [], "nans": 0, "waiting": []}
    gives = ", ".join(f"`{c}` {observed.schema[c].dataType.simpleString()}" for c in rest)
    values = [micros, F.col(value).cast("double"), "_own", *rest]
    return folded(own.unionByName(before), keys, [micros], values, start, step, f"{gives}, rolling_p double", flushed, ["_slice"]).select(*observed.columns, "rolling_p")


def cumulative_counts(snapshots: DataFrame, keys: Sequence[str], bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """keys, le, cumulative: bucket counts estimated from a snapshot by lines through its min, p50, p90, p99 and max."""
    anchors = F.array(*[F.struct(F.col(c).cast("double").alias("x"), F.lit(f).alias("f")) for c, f in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))])
    rows = snapshots.select(*keys, "count", anchors.alias("a")).withColumn("le", F.explode(F.array(*[F.lit(float(b)) for b in (*bounds, float("inf"))])))
    below = F.filter("a", lambda p: p.x <= F.col("le"))
    above = F.filter("a", lambda p: p.x > F.col("le"))
    low, high = F.array_max(below), F.array_min(above)
    share = low.f + (F.col("le") - low.x) / (high.x - low.x) * (high.f - low.f)
    fraction = F.when(F.size(below) == 0, 0.0).when(F.size(above) == 0, 1.0).otherwise(share)
    return rows.select(*keys, "le", F.when(F.col("le") == float("inf"), F.col("count")).otherwise(F.floor(fraction * F.col("count") + 0.5)).cast("long").alias("cumulative"))


def exact_cumulative_counts(observed: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """keys, le, cumulative: how many values are at or below each bound; one pass, one aggregate."""
    counts = observed.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)], F.count("*").alias(f"_{len(bounds)}"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{k}").alias("cumulative")) for k, b in enumerate((*bounds, float("inf")))])
    return counts.select(*keys, F.explode(pairs).alias("b")).select(*keys, "b.le", "b.cumulative")


def trend(samples: DataFrame, keys: Sequence[str], seq: str, value: str, n: int = 5, band: float = 0.1) -> DataFrame:
    """``samples`` with change and trend over the last ``n``: change is of the first of them; no change from zero to zero."""
    frame = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-(n - 1), 0)
    first, last = F.first(value).over(frame), F.last(value).over(frame)
    change = F.when((first == 0) & (last == 0), 0.0).otherwise(F.try_divide(last - first, first))
    kind = F.when(F.col("change") > band, "increasing").when(F.col("change") < -band, "decreasing").when(F.col("change").isNotNull(), "stable")
    return samples.withColumn("change", change).withColumn("trend", kind)


def step_change(samples: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    """``samples`` with rate (since the sample before), direction, and the value after 1, 6 and 24 such steps."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(seq))
    rated = samples.withColumn("rate", F.col(value) - before)
    direction = F.when(F.col("rate") > 0, "up").when(F.col("rate") < 0, "down").when(F.col("rate").isNotNull(), "stable")
    return rated.withColumn("direction", direction).select("*", *[(F.col(value) + F.col("rate") * k).alias(f"after_{k}") for k in (1, 6, 24)])


def growth(samples: DataFrame, keys: Sequence[str], micros: str, value: str, n: int = 5) -> DataFrame:
    """``samples`` with the value in 1, 6 and 24 hours on the line through the first and last of the last ``n``, floored at 0."""
    frame = Window.partitionBy(*keys).orderBy(micros).rowsBetween(-(n - 1), 0)
    slope = F.coalesce(F.try_divide(F.col(value) - F.first(value).over(frame), F.col(micros) - F.first(micros).over(frame)), F.lit(0.0))
    lined = samples.withColumn("_slope", slope)
    return lined.select(*samples.columns, *[F.greatest(F.lit(0.0), F.col(value) + F.col("_slope") * (h * 3_600_000_000)).alias(f"in_{h}h") for h in (1, 6, 24)])


def failure_islands(samples: DataFrame, keys: Sequence[str], seq: str, failed: Column) -> DataFrame:
    """keys, islands: runs of consecutive failed samples."""
    before = F.lag(F.col("_f")).over(Window.partitionBy(*keys).orderBy(seq))
    flagged = samples.withColumn("_f", failed.cast("int")).withColumn("_start", ((F.col("_f") == 1) & (F.coalesce(before, F.lit(0)) == 0)).cast("int"))
    return flagged.groupBy(*keys).agg(F.sum("_start").alias("islands"))


def snapshot(counters_: DataFrame, gauges_: DataFrame, histograms_: DataFrame) -> DataFrame:
    """One table of all series (tables of series and value; histograms give their means): type, series, value."""
    typed = lambda df, t: df.select(F.lit(t).alias("type"), "series", F.col("value").cast("double").alias("value"))
    return typed(counters_, "counter").unionByName(typed(gauges_, "gauge")).unionByName(typed(histograms_.withColumn("value", F.col("mean")), "histogram"))


def prometheus_lines(buckets: DataFrame, snapshots: DataFrame, name: str, label: str, about: str | None = None) -> DataFrame:
    """line: text exposition of a histogram family, with bucket, sum and count samples of each label value; with ``about`` also
    its HELP and TYPE lines, which go first."""
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.regexp_replace(F.col("le").cast("string"), r"\.0$", ""))
    value = prometheus_label(F.col(label).cast("string"))
    lines = buckets.select(F.format_string(f'{name}_bucket{{{label}="%s",le="%s"}} %d', value, bound, F.col("cumulative")).alias("line"))
    sums = snapshots.select(F.concat(F.lit(f'{name}_sum{{{label}="'), value, F.lit('"} '), number_text(F.col("sum"))).alias("line"))
    counts = snapshots.select(F.format_string(f'{name}_count{{{label}="%s"}} %d', value, F.col("count")).alias("line"))
    found = lines.unionByName(sums).unionByName(counts)
    if about is None:
        return found
    return buckets.sparkSession.createDataFrame([(f"# HELP {name} {about}",), (f"# TYPE {name} histogram",)], "line string").unionByName(found)


def number_text(value: Column) -> Column:
    """A number without a trailing .0, in full where it has up to 15 digits."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def prometheus_label(value: Column) -> Column:
    """A label value with backslashes, quotes and newlines escaped."""
    slashed = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slashed, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def family_text(samples: DataFrame, families: dict[str, tuple[str, str]], labels: str, millis: str) -> DataFrame:
    """family, part, at, line: text exposition of ``samples`` (a column for each family, a labels map, a time): for each family
    its HELP (part 0) and TYPE (1) line, and a sample line (2) for each row, with its time. In that order they are the file.

    ``families`` maps a column to its type and help text. Dots in names become underscores; nulls give no line.
    """
    heads = [(underscored_name(k), part, None, text) for k, (kind, about) in families.items() for part, text in ((0, f"# HELP {underscored_name(k)} {about}"), (1, f"# TYPE {underscored_name(k)} {kind}"))]
    head = samples.sparkSession.createDataFrame(heads, "family string, part int, at long, line string")
    escaped = F.transform_values(labels, lambda _, v: prometheus_label(v))
    values = F.array(*[F.struct(F.lit(underscored_name(k)).alias("family"), F.col(k).cast("double").alias("v")) for k in families])
    rows = samples.select(F.explode(values).alias("x"), label_suffix(escaped).alias("l"), F.col(millis).cast("long").alias("at")).filter("x.v IS NOT NULL")
    line = F.concat(F.col("x.family"), F.col("l"), F.lit(" "), number_text(F.col("x.v")), F.lit(" "), F.col("at").cast("string"))
    return head.unionByName(rows.select("x.family", F.lit(2).alias("part"), "at", line.alias("line")))


def underscored_name(name: str) -> str:
    return name.replace(".", "_")


def cloud_metrics(samples: DataFrame, metrics_: dict[str, tuple[str, str, str]], dimensions: dict[str, str], millis: str) -> DataFrame:
    """line: a JSON object for each metric of each row: MetricName, Namespace, Value, Unit, Dimensions, Timestamp (ISO).

    ``metrics_`` maps a column to its metric name, namespace and unit.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("Name"), F.lit(v).alias("Value")) for k, v in dimensions.items()]) if dimensions else F.array().cast("array<struct<Name:string,Value:string>>")
    at = F.date_format(F.timestamp_millis(F.col(millis)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    each = [
        F.struct(F.lit(name).alias("MetricName"), F.lit(space).alias("Namespace"), F.col(c).cast("double").alias("Value"), F.lit(unit).alias("Unit"), listed.alias("Dimensions"), at.alias("Timestamp"))
        for c, (name, space, unit) in metrics_.items()
    ]
    return samples.select(F.explode(F.array(*each)).alias("m")).select(F.to_json("m").alias("line"))


def series_points(samples: DataFrame, metrics_: dict[str, str], tags: dict[str, str], millis: str) -> DataFrame:
    """line: a JSON object for each metric of each row: metric, points [[seconds, value]], tags (key:value), type gauge."""
    listed = F.array(*[F.lit(f"{k}:{v}") for k, v in tags.items()]) if tags else F.array().cast("array<string>")
    point = lambda c: F.array(F.array(F.floor(F.col(millis) / 1000).cast("double"), F.col(c).cast("double")))
    each = [F.struct(F.lit(name).alias("metric"), point(c).alias("points"), listed.alias("tags"), F.lit("gauge").alias("type")) for c, name in metrics_.items()]
    return samples.select(F.explode(F.array(*each)).alias("m")).select(F.to_json("m").alias("line"))


# Fixed value: the columns of the tracker's CSV file.
CSV_COLUMNS = ("timestamp", "cpu_percentage", "memory_percentage", "disk_percentage", "cluster_size", "gossip_rate", "message_latency", "network_latency", "active_connections", "pool_utilization", "overall_health")


def csv_lines(samples: DataFrame, at: Column | None = None) -> DataFrame:
    """at, line: a CSV line for each row of ``samples`` (CSV_COLUMNS, with the time in milliseconds as timestamp), ISO time first;
    in order of ``at`` (by default the timestamp), below the joined CSV_COLUMNS, they are the file. A null is an empty field."""
    iso = F.date_format(F.timestamp_millis(F.col("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kinds = {f.name: f.dataType.typeName() for f in samples.schema}
    text = lambda c: number_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    fields = [F.coalesce(text(c), F.lit("")) for c in CSV_COLUMNS[1:]]
    return samples.select((F.col("timestamp") if at is None else at).alias("at"), F.concat_ws(",", iso, *fields).alias("line"))


def report(summary: DataFrame, kind: str) -> DataFrame:
    """content: a report of one row (timestamp, status, cpu, memory) as json, csv or html."""
    if kind == "json":
        text = F.to_json(F.struct(F.lit("1.0").alias("version"), F.struct(*summary.columns).alias("data")))
    elif kind == "csv":
        text = F.concat(F.lit("timestamp,status,cpu,memory\n"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("timestamp", "status", "cpu", "memory")]))
    elif kind == "html":
        safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        text = F.concat(F.lit("<!DOCTYPE html>\n<title>Report</title>\n<p>Generated: "), safe("timestamp"), F.lit("</p>\n<p>Status: "), safe("status"), F.lit("</p>\n"))
    else:
        raise ValueError(f"unknown report format: {kind}")
    return summary.select(text.alias("content"))


def influx_lines(points: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], millis: str) -> DataFrame:
    """line: line protocol with the time in nanoseconds; blanks, commas and equals signs of tags are escaped, text fields quoted."""
    escape = lambda v: F.regexp_replace(v, r"([ ,=])", r"\\$1")
    tag = F.concat(*[F.concat(F.lit(f",{t}="), escape(F.col(t).cast("string"))) for t in tags]) if tags else F.lit("")
    kinds = {f.name: f.dataType.typeName() for f in points.schema}
    quoted = lambda f: F.concat(F.lit('"'), F.regexp_replace(F.col(f), r'(["\\])', r"\\$1"), F.lit('"')) if kinds[f] == "string" else F.col(f).cast("string")
    field = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), quoted(f)) for f in fields])
    return points.select(F.concat(F.lit(measurement), tag, F.lit(" "), field, F.lit(" "), F.col(millis).cast("string"), F.lit("000000")).alias("line"))


def envelope(points: DataFrame, order: str, at: Column, version: str = "1.0", size: int = 1000) -> DataFrame:
    """chunk, content: JSON documents with timestamp, version and the metrics of up to ``size`` consecutive values of ``order`` (an
    integer), in order."""
    chunk = F.expr(f"{order} div {size}").alias("chunk")
    listed = points.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*points.columns).alias("m")))).alias("_m"))
    return listed.select("chunk", F.to_json(F.struct(at.alias("timestamp"), F.lit(version).alias("version"), F.transform("_m", lambda x: x.m).alias("metrics"))).alias("content"))


def json_envelope(points: DataFrame, source: str) -> DataFrame:
    """line: one JSON object a row, with where it comes from."""
    return points.select(F.to_json(F.struct(F.lit(source).alias("source"), F.struct(*points.columns).alias("metrics"))).alias("line"))
