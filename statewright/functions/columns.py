"""Scalar functions as Column builders."""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_hash(text: Column) -> Column:
    """The first eight hex digits of the MD5 of a string as an unsigned 32-bit number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def string_hash(text: Column) -> Column:
    """The signed 32-bit hash h = 31 h + code over the characters; exact for characters of the basic plane."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def bucket_of(text: Column, n: int) -> Column:
    """The bucket of a key: the absolute value of its string hash, modulo ``n``."""
    return F.pmod(F.abs(string_hash(text)), F.lit(n))


def padded(lsn: Column, width: int = 8) -> Column:
    return F.lpad(lsn.cast("string"), width, "0")


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def exponential_backoff(attempt: Column, base: float, factor: float, cap: float) -> Column:
    """base * factor ** (attempt - 1), at most ``cap``."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(factor), attempt - 1))


def linear_backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) * attempt)


def fibonacci_backoff(attempt: Column, base: float, cap: float) -> Column:
    """base * the attempt-th Fibonacci number (1, 1, 2, 3, ...), at most ``cap``."""
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    step = lambda s, _: F.struct(s.b.alias("a"), (s.a + s.b).alias("b"))
    number = F.aggregate(F.sequence(F.lit(1), attempt.cast("int")), start, step, lambda s: s.a)
    return F.least(F.lit(cap), F.lit(base) * number)


def nearest_millis(micros: Column) -> Column:
    """Whole microseconds as milliseconds, rounded; halves go away from zero."""
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def usable_load(load: Column) -> Column:
    """A load that is missing, not a number, infinite or negative counts as none."""
    return F.when(load.isNull() | F.isnan(load) | (F.abs(load) == float("inf")) | (load < 0), 0.0).otherwise(load)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(half))


def nearest(lat: Column, lon: Column, places: list[tuple[str, float, float]]) -> Column:
    """The name of the nearest of ``places`` (name, latitude, longitude), of equally near ones the least name."""
    spots = F.array(*[F.struct(haversine_km(lat, lon, F.lit(a), F.lit(b)).alias("km"), F.lit(name).alias("name")) for name, a, b in places])
    return F.array_min(spots).getField("name")


def fixed_backoff(attempt: Column, base: float) -> Column:
    """The same wait before each attempt."""
    return F.lit(base) + attempt * 0


def jittered(wait: Column, share: float, *parts: Column) -> Column:
    """``wait`` moved up or down by up to ``share`` of it, as a hash of ``parts`` says."""
    unit = F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 20)
    return F.greatest(F.lit(0.0), wait * (1 + share * (2 * unit - 1)))


def deep_merged(left: Column, right: Column) -> Column:
    """JSON objects merged key by key, ``right`` first; what is no object on both sides is replaced. For whole columns of small objects."""

    @F.pandas_udf("string")
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        def both(x: dict, y: dict) -> dict:
            return x | {k: both(x[k], v) if isinstance(v, dict) and isinstance(x.get(k), dict) else v for k, v in y.items()}

        return pd.Series([json.dumps(both(json.loads(x or "{}"), json.loads(y or "{}")), separators=(",", ":"), ensure_ascii=False) for x, y in zip(a, b, strict=True)], dtype=object)

    return merged(left, right)


def compressed(data: Column, least: float = 0.9) -> Column:
    """(data, compressed): zlib-compressed bytes where that leaves ``least`` of the size at most, else the bytes as they are."""

    @F.pandas_udf("struct<data:binary,compressed:boolean>")
    def packed(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            small = zlib.compress(x) if x is not None else None
            smaller = x is not None and len(x) > 0 and len(small) <= least * len(x)
            rows.append((small if smaller else x, None if x is None else smaller))
        return pd.DataFrame(rows, columns=["data", "compressed"])

    return packed(data)


def decompressed(packed: Column) -> Column:
    """The bytes of a (data, compressed) column."""

    @F.pandas_udf("binary")
    def opened(column: pd.DataFrame) -> pd.Series:
        return pd.Series([zlib.decompress(d) if c else d for d, c in zip(column["data"], column["compressed"], strict=True)], dtype=object)

    return opened(packed)


_CONDITION = re.compile(r"""\s*context\.([A-Za-z_]\w*(?:\.\w+)*)\s*===\s*(?:'([^']*)'|"([^"]*)"|(-?\d+(?:\.\d+)?)|(true|false))\s*""")


def condition(expression: str, context: Column) -> Column:
    """``context.a.b === literal`` over a JSON column; null for expressions of another form (nothing is guessed)."""
    match = _CONDITION.fullmatch(expression)
    if not match:
        return F.lit(None).cast("boolean")
    path, single, double, number, boolean = match.groups()
    value = F.get_json_object(context, f"$.{path}")
    if number is not None:
        return F.coalesce(value.try_cast("double") == float(number), F.lit(False))
    return F.coalesce(value == (boolean or (single if single is not None else double)), F.lit(False))


def template(text: str, context: Column) -> Column:
    """``text`` with each {{context.path}} replaced by the value in a JSON column; missing values are empty."""
    parts = re.split(r"\{\{\s*context\.([\w.]+)\s*\}\}", text)
    return F.concat(*[F.coalesce(F.get_json_object(context, f"$.{p}"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
