"""Join helper: broadcast only behind a check of rows and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast when it has at most so many rows and so many bytes of values.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                         max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its rows and bytes are proven to be within the bounds, else ``df``.

    The check reads at most ``max_rows + 1`` rows and returns two numbers.
    Nothing is persisted: a side that small is cheap to compute again, and a
    larger one goes through a shuffle join, where AQE splits hot keys. The
    result carries ``_bounded`` and, if so, ``_rows`` for callers.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    # widths are taken before the limit, which moves its rows to one task
    seen = df.select(width.cast("bigint").alias("width")).limit(max(max_rows, 0) + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum("width").alias("bytes")).first()
    bounded = seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes
    out = F.broadcast(df) if bounded else df.alias("side")
    out._bounded = bounded
    out._rows = seen["n"] if bounded else None
    return out
