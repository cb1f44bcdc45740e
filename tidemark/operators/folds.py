"""Ordered folds: what earlier rows of a group decide about later ones, where no window function can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import prepare

#: A machine that closes may emit many rows; they leave in batches of so many.
ROWS = 20_000


class Machine(Protocol):
    """State of one group. Both methods give rows to emit."""

    def step(self, *values) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def fold(rows: DataFrame, group: list[str], order: list[str | Column], make: Callable[[], Machine], kind: str) -> DataFrame:
    """The rows that machines emit, one machine a group, after the columns of the group; ``kind`` names what they emit.

    Groups are dealt over all tasks and sorted there by ``order``; a task streams through them with the state of one group. A machine
    gets the columns outside ``group`` in their order. How much memory a group takes is up to its machine, never its number of rows.
    """
    prepare(rows.sparkSession)
    narrow = rows.select(*group, *[c for c in rows.columns if c not in group])
    schema = T.StructType([*narrow.schema.fields[: len(group)], *T.StructType.fromDDL(kind).fields])
    arrow, n = to_arrow_schema(schema), len(group)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if machine is None or row[:n] != now:
                    if machine:
                        for r in machine.close():
                            out.append((*now, *r))
                            if len(out) == ROWS:
                                yield batch_of(out)
                                out = []
                    now, machine = row[:n], make()
                out += [(*now, *r) for r in machine.step(*row[n:])]
            yield batch_of(out)
        if machine:
            rest = iter(machine.close())
            while out := [(*now, *r) for r in islice(rest, ROWS)]:
                yield batch_of(out)

    ordered = narrow.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order)
    return ordered.mapInArrow(run, schema)
