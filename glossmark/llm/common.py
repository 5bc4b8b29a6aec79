"""Shared helpers of the training-data operators: table reading, shared-folder tables, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.sources.shared import materialize, shared_dir  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no start of a column of ``df``; Spark's names ignore case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files whose plans are done: Spark deletes them when the driver's objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send so many rows to Python at once: long texts need less memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back_memory() -> None:
    """At the end of a task: free memory goes back to the system, as the worker outlives the stage and others need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs with about ``size`` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), side="right")))
        yield at, stop - at
        at = stop


def map_rows(df: DataFrame, schema: str, batch: Callable[[list], Iterator[pa.RecordBatch]] | Callable) -> DataFrame:
    """``mapInArrow`` for ``batch(columns as lists) -> dict of lists``; the output columns follow ``schema``."""
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    want = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = batch(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; other columns, whatever their names, never reach an operator's plan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def spans_text(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))
