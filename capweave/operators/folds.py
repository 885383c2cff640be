"""Folds over sorted groups: a task streams its keys one after another, so a key costs a few list operations and no frame or call of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Fold = Callable[[object, list[list]], list[tuple]]
#: Rows that are given at a time.
BATCH = 10_000


def by_key(df: DataFrame, order: Sequence[str], fold: Fold, schema: StructType) -> DataFrame:
    """fold(key, columns) for every value of df's first column: the other columns of its rows, as lists, sorted by `order`; it gives rows of schema.

    The rows of one key are held at once, so keys are documents or pages, never a source or a type. Sorting can spill.
    """
    key, kinds = df.columns[0], to_arrow_schema(schema)

    def run(batches):
        out: list[tuple] = []
        now, held = None, None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for b in batches:
            keys, *columns = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = [c[at:end] for c in columns]
                if held is not None and keys[at] == now:
                    held = [h + p for h, p in zip(held, part)]
                else:
                    if held is not None:
                        out += fold(now, held)
                    now, held = keys[at], part
                at = end
            while len(out) >= BATCH:
                yield made(out[:BATCH])
                out = out[BATCH:]
        if held is not None:
            out += fold(now, held)
        for i in range(0, len(out), BATCH):
            yield made(out[i : i + BATCH])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
