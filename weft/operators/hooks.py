"""Packing by the caller's own functions over bounded buffers of samples.

Samples are numbered in their order and cut in buffers of a given number, one group each.  In a buffer, ``select``
names the samples that go together, ``pack`` makes one row of each such group, and ``batch``, if there is one, turns the
packed rows of the buffer into others, such as padded batches.  The functions see Arrow tables of one buffer only, so memory
is bounded by the buffer whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from weft.functions.ordering import ranged_running

Select = Callable[[pa.Table], Sequence[Sequence[int]]]
Pack = Callable[[pa.Table], dict]
Batch = Callable[[pa.Table], pa.Table]


def pack_with(df: DataFrame, key: str, buffer: int, select: Select, pack: Pack, schema: str, batch: Batch | None = None, batch_schema: str | None = None) -> DataFrame:
    """``buffer, pack`` and the columns of ``schema`` (``batch_schema`` after ``batch``), from the samples in order of the unique ``key``.

    ``select`` gets the samples of a buffer and returns groups of row numbers, each row in one group at most; those
    in none are left out.  ``pack`` gets the rows of a group in that order and returns a row as a dict.  ``batch`` gets the packed rows.
    """
    numbered = ranged_running(df.select(key), [key], out="__i")
    rows = df.join(numbered, key).withColumn("__buffer", F.expr(f"__i div {int(buffer)}"))
    names = df.columns
    packed = to_arrow_schema(_parse_datatype_string(schema))
    out = StructType([StructField("buffer", LongType()), StructField("pack", LongType()), *_parse_datatype_string(batch_schema or schema).fields])

    def run(number: tuple, table: pa.Table) -> pa.Table:
        samples = table.sort_by("__i").select(names)
        groups = [np.asarray(g, dtype=np.int64) for g in select(samples)]
        every = np.concatenate(groups) if groups else np.zeros(0, dtype=np.int64)
        if len(np.unique(every)) != len(every):
            raise ValueError("a sample was selected twice")
        made = pa.Table.from_pylist([pack(samples.take(pa.array(g))) for g in groups if len(g)], packed)
        made = made if batch is None else batch(made)
        ids = [pa.array(np.full(made.num_rows, number[0].as_py()), pa.int64()), pa.array(np.arange(made.num_rows), pa.int64())]
        return pa.Table.from_arrays([*ids, *made.columns], ["buffer", "pack", *made.schema.names])

    return rows.groupBy("__buffer").applyInArrow(run, out)


def largest_that_fits(capacity: int, key: str = "seq_id", length: str = "length") -> Select:
    """A ``select`` that opens a bin with the longest sample and adds the longest that fits, the greatest key first."""

    def select(samples: pa.Table) -> list[list[int]]:
        from bisect import bisect_right

        sizes = samples.column(length).to_numpy()
        order = np.lexsort((samples.column(key).to_numpy(), sizes)).tolist()
        lengths = sizes[order].tolist()
        if lengths and lengths[-1] > capacity:
            raise ValueError(f"a sample of {lengths[-1]} exceeds the capacity {capacity}")
        groups = []
        while order:
            room, group = capacity, []
            while (at := bisect_right(lengths, room) - 1) >= 0:
                group.append(order.pop(at))
                room -= lengths.pop(at)
            groups.append(group)
        return groups

    return select
