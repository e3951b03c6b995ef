"""First-k-per-group and running sums, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, materialised

SPLITS = 16


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    split_on: str | None,
    rank: str = "rank",
    splits: int = SPLITS,
) -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order`` and number them.

    Spark already cuts every map partition to ``k`` rows per group before it
    shuffles. A group spread over very many partitions would still meet in one
    task, so it is first ranked in ``splits`` parts; the last step then sees at
    most ``splits * k`` rows of a group. ``split_on=None`` skips the first step
    for groups already known to be small. ``order`` must end in a unique key.
    """
    if split_on is not None and splits > 1:
        part = F.pmod(F.xxhash64(F.col(split_on)), F.lit(splits)).cast("int")
        df = df.withColumn("_part", part)
        partial = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn(rank, F.row_number().over(partial))
            .filter(F.col(rank) <= k)
            .drop("_part", rank)
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def running(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """``rows`` with each of ``sums`` over the rows of the group that come earlier in ``order``.

    Rows are dealt out by ranges of keys and order. A range sums its own rows, and a table
    of one row per range and group carries what lies before, so no task holds a whole
    group. Keys may not be null; ``rows`` is read twice (ranges are sampled), so it
    should be a stored table. Rows equal in ``order`` come in any order.
    """
    weights = {f"_w{n}": column for n, column in enumerate(sums.values())}
    dealt = materialised(
        rows.repartitionByRange(*map(F.col, keys), *order).withColumns(
            {"_range": F.spark_partition_id()} | weights
        )
    )
    group = ["_range", *keys]
    own = dealt.groupBy(*group).agg(*[F.sum(w).alias(w) for w in weights])
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(*group, *[F.sum(w).over(ranges).alias(f"_b{w}") for w in weights])
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_i{w}": F.sum(w).over(inside) for w in weights})
    return summed.join(broadcast_if_small(before), group).select(
        *rows.columns,
        *[
            (F.coalesce(f"_b{w}", F.lit(0)) + F.coalesce(f"_i{w}", F.lit(0))).alias(name)
            for w, name in zip(weights, sums)
        ],
    )
