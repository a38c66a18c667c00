"""Walks along many series at once: a state that each row of a series changes, in order.

For what running sums and frames can't say: a state machine whose next step depends on the last. Rows are dealt by series and sorted;
a task reads its partition as a stream of Arrow batches and carries the state of the series it is in, and no more, from
batch to batch. So a task holds one batch, however long or many its series are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def walk(df: DataFrame, keys: Sequence[str], order: str, takes: Sequence[str], start: Callable[[], Any], step: Callable[..., tuple | None], gives: str) -> DataFrame:
    """keys, order and the columns ``gives``, for every row for which ``step(state, *values of takes)`` returns them.

    ``start`` makes the state at the begin of a series. A series is one task's, so this is for rows that are already sums of intervals.
    """
    rows = df.select(*keys, order, *takes).repartition(*keys).sortWithinPartitions(*keys, order)
    new = df.sparkSession.createDataFrame([], gives).schema
    schema = T.StructType([*rows.schema.fields[: len(keys) + 1], *new.fields])
    n, types = len(keys), [f.dataType for f in new.fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        at, state = None, None
        for b in parts:
            series = zip(*[b.column(i).to_pylist() for i in range(n)])
            kept, out = [], []
            for i, (key, values) in enumerate(zip(series, zip(*[b.column(i).to_pylist() for i in range(n + 1, b.num_columns)]))):
                if key != at:
                    at, state = key, start()
                got = step(state, *values)
                if got is not None:
                    kept.append(i)
                    out.append(got)
            if kept:
                own = b.select(schema.names[: n + 1]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, t) for c, t in zip(zip(*out), arrow)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """The frame with these columns as whole numbers."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
