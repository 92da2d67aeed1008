"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.session import written_once

# Rows below which a derived lookup table is broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Write a derived (small-by-design) table once, count it, and mark it for
    broadcast only when the count is within ``max_rows``; otherwise the
    planner shuffles both sides. The written table is what the join reads, so
    the count costs no extra pass over the input and nothing stays in memory."""
    table = written_once(df, "lookup")
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table
