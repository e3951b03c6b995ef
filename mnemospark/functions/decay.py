"""The forgetting curve as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.schema import (
    DECAY_RATES,
    DEFAULT_TYPE,
    FORGET_THRESHOLD,
    RECALL_BOOST,
    RETENTION_WEIGHT,
    WRITE_BACK_EPSILON,
)

MICROS_PER_DAY = 86_400_000_000.0


def decay_rate_for_type(memory_type: Column) -> Column:
    """Daily rate of a memory type; unknown or missing types fade like general."""
    rate = F.lit(DECAY_RATES[DEFAULT_TYPE])
    for name, value in DECAY_RATES.items():
        rate = F.when(memory_type == name, F.lit(value)).otherwise(rate)
    return rate


def days_since(as_of: Column, moment: Column) -> Column:
    """Fractional days from ``moment`` to ``as_of``; negative for the future."""
    elapsed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    return elapsed / F.lit(MICROS_PER_DAY)


def effective_rate(rate: Column, access_count: Column) -> Column:
    """Rate left after the logarithmic retention bonus of repeated use."""
    return F.greatest(F.lit(0.0), rate - F.log1p(access_count) * RETENTION_WEIGHT)


def decayed_importance(base: Column, rate: Column, access_count: Column, days: Column) -> Column:
    curve = base * F.exp(-effective_rate(rate, access_count) * days)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), curve))


def current_importance(as_of: Column) -> Column:
    """Decayed importance of a row with the memory table's column names."""
    return decayed_importance(
        F.col("importance_score"),
        F.col("decay_rate"),
        F.col("access_count"),
        days_since(as_of, F.col("last_accessed")),
    )


def should_forget(current: Column, threshold: float = FORGET_THRESHOLD) -> Column:
    return current < F.lit(threshold)


def boosted(stored: Column, times: Column | int = 1, boost: float = RECALL_BOOST) -> Column:
    """Stored importance after ``times`` recalls, never above one."""
    times = F.lit(times) if isinstance(times, int) else times
    return F.least(F.lit(1.0), stored + F.lit(boost) * times)


def sweep_action(
    stored: Column,
    current: Column,
    threshold: float = FORGET_THRESHOLD,
    epsilon: float = WRITE_BACK_EPSILON,
) -> Column:
    """``forget``, ``update`` (moved more than epsilon) or ``keep``."""
    return (
        F.when(should_forget(current, threshold), F.lit("forget"))
        .when(F.abs(current - stored) > epsilon, F.lit("update"))
        .otherwise(F.lit("keep"))
    )


def forget_time(threshold: float = FORGET_THRESHOLD) -> Column:
    """When a row falls below the threshold; NULL if it never does.

    A row already stored below it counts as faded from its last access on.
    """
    rate = effective_rate(F.col("decay_rate"), F.col("access_count"))
    days = F.ln(F.col("importance_score") / threshold) / F.nullif(rate, F.lit(0.0))
    accessed = F.col("last_accessed").cast("timestamp")
    micros = F.unix_micros(accessed) + F.ceil(days * MICROS_PER_DAY).cast("bigint")
    return (
        F.when(F.col("importance_score") < threshold, accessed)
        # A million days ahead counts as never, and keeps the long in range.
        .when(days < 1.0e6, F.timestamp_micros(micros))
    )
