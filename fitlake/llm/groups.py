"""Groups of rows handed to Python one after the other, several to a task.

Rows are dealt by their group and sorted inside each task, so a task holds one group at a time.
Unlike ``applyInPandas`` this costs little for groups of two or three rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(
    df: DataFrame, key: str, body: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``body`` of every group of equal ``key``; the key must not be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch[key].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]
            for a, b in zip(starts, ends, strict=True):
                if held and keys[a] != last:
                    yield from body(pa.Table.from_batches(held))
                    held = []
                last = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from body(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def binaries(column: pa.ChunkedArray) -> list[memoryview]:
    """The values of a binary column without a copy of each."""
    return [memoryview(x.as_buffer()) for x in column]
