"""The daily sweep with its reports, and the panel of one user."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from mnemospark.operators.lifecycle import apply_sweep, plan_sweep
from mnemospark.operators.reports import (
    decay_chart,
    in_scope,
    list_by_user,
    memory_stats,
    sweep_report,
)


class Maintenance(NamedTuple):
    memories: DataFrame
    report: DataFrame


def daily_maintenance(memories: DataFrame, as_of: Column) -> Maintenance:
    """Sweep all users: the next table, and one report row per user.

    The report reads the narrow columns once and gives the forgotten count
    together with the statistics of what is left.
    """
    planned = plan_sweep(memories, as_of)
    return Maintenance(apply_sweep(planned, as_of), sweep_report(planned))


class Panel(NamedTuple):
    listing: DataFrame
    stats: DataFrame
    chart: DataFrame


def user_panel(
    memories: DataFrame, as_of: Column, user_id=None, project_id: str | None = None
) -> Panel:
    """List, statistics and chart of one user, or of every user.

    The filter reaches the scan. The chart shows the listed memories, as the
    panel does.
    """
    scoped = in_scope(memories, user_id, project_id)
    listing = list_by_user(scoped)
    return Panel(listing, memory_stats(scoped), decay_chart(listing.drop("rank"), as_of))
