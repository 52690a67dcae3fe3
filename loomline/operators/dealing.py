"""How rows are dealt to Python work on groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: What one Arrow batch holds at most, and batches after which a worker gives back what is free.
BATCH_BYTES, BATCH_ROWS, RELEASE_BATCHES = 2 << 20, 4000, 8


def bounded(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that a worker's memory depends neither on the lengths of texts nor on the size of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Gives memory that is free in this process back to the system (glibc only)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """rows as batches of so many bytes and rows at most, one row more than that if it is large; what is free is given back as they go."""
    held, own, n = 0, [], 0
    try:
        for row in rows:
            own.append(row)
            held += size(row)
            if held >= BATCH_BYTES or len(own) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own), schema)], schema=schema)
                held, own, n = 0, [], n + 1
                if n % RELEASE_BATCHES == 0:
                    release()
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own), schema)], schema=schema)
    finally:
        del own
        release()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in a fixed number of partitions. What a group costs in Python has little to do with its bytes, by which adaptive execution would put all small groups in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def in_sequence(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, dict], tuple[Any, tuple]], decision: str) -> DataFrame:
    """df with the columns of decision, a schema: step(state, row) gives the next state and a row's decision, and is called for a key's rows in order, at first with None.

    What a row is decided to be depends on all before it, so a key is one task's work; but rows pass through the task in batches, and it holds one state and no group.
    """
    extra = T.StructType.fromDDL(decision)
    schema = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := tuple(row[k] for k in keys)) != now:
                    now, state = key, None
                state, decided = step(state, row)
                out.append(decided)
            for field, values in zip(schema, zip(*out) if out else [()] * len(schema)):
                batch = batch.append_column(field.name, pa.array(values, field.type))
            yield batch

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*df.schema, *extra]))
