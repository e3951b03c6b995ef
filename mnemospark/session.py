"""Session settings and the few helpers that look at sizes before planning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # One user may own a large share of the table: let AQE split such join
    # partitions even where that costs one more exchange above the join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join on (qid, id) may run on data already partitioned by qid.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Cut groups map-side also for the largest first-k in use (the sweep cap).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # A repeated key in a JSON object takes its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Rows of a narrow table (ids, counters, short keys) that may be broadcast.
#: 200,000 rows of about 100 bytes are some 20 MB per executor.
BROADCAST_ROWS = 200_000
#: Bytes of such a table; ids and other text may be long.
BROADCAST_BYTES = 64 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings this package relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; only local runs get a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="mnemospark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage like a checkpoint, so a lost executor costs nothing that
    was already computed; unlike one it keeps column pruning and lets Spark see
    the true size.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_discarded(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files as they end, for results that are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unlinked(df: DataFrame) -> None:
    """Drop the files of a materialised DataFrame that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: 8 bytes a field, and what text and arrays hold."""
    total = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            total = total + 16 * F.coalesce(F.size(field.name), F.lit(0))
    return total


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark a narrow DataFrame for broadcast only after counting its rows and bytes.

    A wide table joined with the result is then not shuffled. Beyond either
    limit the DataFrame comes back unmarked and the join shuffles, with
    AQE splitting skewed partitions. The rows are materialised, and counted as
    they are written.
    """
    size = Observation()
    stored = materialised(df.observe(size, F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")))
    found = size.get
    small = found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes
    return F.broadcast(stored) if small else stored
