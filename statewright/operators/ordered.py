"""Folds over the rows of a key in order, for results that depend on order and have no closed form.

Spark partitions and sorts; a task then reads its rows once and holds one state, so memory does not grow with a key's
rows and time is linear in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[..., tuple[object, Iterable[tuple]]]
#: Rows of an output batch.
BATCH = 10_000


def cut_at_gaps(rows: DataFrame, keys: Sequence[str], ts: str, gap: int, piece: str = "_piece") -> DataFrame:
    """``rows`` with ``piece``: the number of pauses of ``gap`` or more before each row of its key.

    Where a state surely starts anew after such a pause, pieces can be folded apart, so that a hot key is spread.
    """
    order = Window.partitionBy(*keys).orderBy(ts)
    starts = (F.col(ts) - F.lag(ts).over(order) >= gap).cast("long")
    return rows.withColumn(piece, F.coalesce(starts, F.lit(0))).withColumn(piece, F.sum(piece).over(order.rangeBetween(Window.unboundedPreceding, 0)))


def folded(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str | Column],
    start: Callable[[], object],
    step: Step,
    gives: str,
    finish: Callable[[object], Iterable[tuple]] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """keys and the columns ``gives`` (DDL): what a fold emits over each key's rows in ``order``.

    ``step(state, *values)`` returns the next state and the rows to emit, ``finish(state)`` the rows after a key's last.
    The state begins as ``start()`` for each key, and within it for each value of ``within``. Rows of equal order come in
    any order; name a column that tells them apart where that matters.
    """
    groups = [*keys, *within]
    named = [F.col(v).alias(f"_v{k}") if isinstance(v, str) else v.alias(f"_v{k}") for k, v in enumerate(values)]
    ordered = rows.select(*groups, *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *named)
    ordered = ordered.repartition(*groups).sortWithinPartitions(*groups, *[f"_o{k}" for k in range(len(order))])
    out = StructType([ordered.schema[k] for k in keys] + StructType.fromDDL(gives).fields)
    types = to_arrow_schema(out)
    n_keys, n_groups, first = len(keys), len(groups), len(groups) + len(order)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, found = None, None, []
        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[:n_groups] != group:
                    if group is not None and finish:
                        found += [group[:n_keys] + tuple(r) for r in finish(state)]
                    group, state = row[:n_groups], start()
                state, given = step(state, *row[first:])
                for r in given:
                    found.append(group[:n_keys] + tuple(r))
                if len(found) >= BATCH:
                    yield batch(found)
                    found = []
        if group is not None and finish:
            found += [group[:n_keys] + tuple(r) for r in finish(state)]
        if found:
            yield batch(found)

    return ordered.mapInArrow(task, out)
