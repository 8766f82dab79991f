"""Folds over the ordered rows of a key, as streams.

Rows are dealt by key, sorted within their partitions (Spark spills what doesn't
fit) and go through the task once, batch by batch: what a task holds is one batch
and the state of one key, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: rows that a task gathers before it hands them on
ROWS = 10_000


def fold(rows: DataFrame, keys: list[str], order: list[Column | str], values: list[str], begin: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], schema: str, end: Callable[[object], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """``keys`` and what ``step(state, values)`` yields for each row, and
    ``end(state)`` after a key's last. ``begin`` makes a key's state, which ``step``
    changes in place; ``schema`` is that of the yielded tuples. Null keys are one key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    whole = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    wanted = rows.sparkSession.createDataFrame([], whole).schema
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        key: tuple | None = None
        state: object = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:n] != key:
                    if key is not None:
                        out += [(*key, *x) for x in end(state)]
                    key, state = row[:n], begin()
                out += [(*row[:n], *x) for x in step(state, row[n:])]
            if len(out) >= ROWS:
                yield batch()
        if key is not None:
            out += [(*key, *x) for x in end(state)]
        yield batch()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *values).mapInArrow(run, whole)
