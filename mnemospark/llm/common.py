"""What the operators share: reading tables, Arrow settings, per-worker objects."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Texts may be very long: few rows a batch, so that a batch stays small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


_STATE: dict[object, object] = {}


def forget() -> None:
    """Drop what an earlier job left in this worker, and hand its memory back to the system.

    Freed words and ids lie scattered; without the trim most of their memory stays with the worker.
    """
    if _STATE:
        _STATE.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def worker_state(key: object, make: Callable[[], object]):
    """What a Python worker keeps from batch to batch: the state of one job at a time.

    Workers outlive jobs; what an earlier operator kept there goes first.
    """
    if key not in _STATE:
        forget()
        _STATE[key] = make()
    return _STATE[key]


def ready(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes and named columns; other columns go no further."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def crc_is(divisor: int, remainder: int):
    """crc32 of doc_id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor == remainder
