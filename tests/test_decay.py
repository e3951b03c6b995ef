import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import decay

CASES = [
    # base, rate, days, accesses, expected
    (0.8, 0.1, 10, 0, 0.8 * math.exp(-1)),
    (0.8, 0.1, 10, 50, 0.8),
    (1.0, 0.1, 0, 0, 1.0),
    (1.0, 0.1, 10, 0, math.exp(-1)),
    (1.0, 0.1, 10, 10, 1.0),
    (0.5, 1.0, 365, 0, 0.0),
    (0.05, 0.5, 365, 0, 0.0),
    (0.7, 0.1, 0, 0, 0.7),
    (0.5, 0.1, -10, 0, 1.0),
    (0.9, 0.1, 10, 1, 0.9 * math.exp(-10 * (0.1 - math.log(2) * 0.1))),
]


def test_decayed_importance(spark):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)],
        "i int, base double, rate double, days int, n int, expected double",
    )
    got = df.select(
        "i",
        "expected",
        decay.decayed_importance(
            F.col("base"), F.col("rate"), F.col("n"), F.col("days").cast("double")
        ).alias("got"),
    ).collect()
    for row in got:
        assert row.got == pytest.approx(row.expected, abs=1e-12)


def test_days_use_microseconds_and_utc(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-02 12:00:00.5' a, timestamp_ntz'2024-01-01 00:00:00' b"
    )
    days = df.select(decay.days_since(F.col("a"), F.col("b"))).first()[0]
    assert days == pytest.approx(1.5 + 0.5 / 86400, abs=1e-12)


def test_rates_thresholds_and_boost(spark):
    kinds = ["preference", "pattern", "decision", "bug_fix", "general", "unheard", None]
    df = spark.createDataFrame([(k,) for k in kinds], "kind string")
    rates = [r[0] for r in df.select(decay.decay_rate_for_type(F.col("kind"))).collect()]
    assert rates == [0.02, 0.03, 0.05, 0.08, 0.10, 0.10, 0.10]
    df = spark.createDataFrame([(0.04,), (0.05,), (0.06,)], "x double")
    assert [r[0] for r in df.select(decay.should_forget(F.col("x"))).collect()] == [True, False, False]
    df = spark.createDataFrame([(0.95,), (0.5,)], "x double")
    boosted = [r[0] for r in df.select(decay.boosted(F.col("x"))).collect()]
    assert boosted == pytest.approx([1.0, 0.7])


def test_forget_time_is_where_the_sweep_forgets(spark):
    rows = [
        (1, 0.8, 0.1, 0), (2, 0.8, 0.1, 1), (3, 0.8, 0.02, 2), (4, 0.03, 0.1, 0), (5, 0.0, 0.1, 5),
    ]
    last = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(*r, last) for r in rows],
        "id int, importance_score double, decay_rate double, access_count int, last_accessed timestamp",
    ).withColumn("at", decay.forget_time())
    got = {r.id: r for r in df.collect()}
    assert got[3].at is None  # two accesses stop the fading
    assert got[4].at == last and got[5].at == last
    for offset, forgotten in ((-1, False), (1, True)):
        shifted = df.filter("id <= 2").withColumn(
            "now", F.timestamp_micros(F.unix_micros("at") + offset * 1_000_000)
        )
        current = decay.current_importance(F.col("now"))
        assert {r[0] for r in shifted.select(decay.should_forget(current)).collect()} == {forgotten}
