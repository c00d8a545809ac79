"""Pattern functions on streams: they keep no state, so any of them works as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as rx


def windowed_hits(events: DataFrame, text: str, ts: str, pattern: str, window: str = "1 hour", late: str = "10 minutes", flags: str = "", slide: str | None = None, session: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows, matching rows and matches per time window (and keys), with a watermark; for batch and stream.

    Windows tumble, overlap if they ``slide``, or, with ``session``, end after a
    gap of that length without rows. Null texts count as rows without matches;
    rows without a time are in no window.
    """
    hits = events.withWatermark(ts, late).select(*keys, F.col(ts).alias("at"), rx.count(text, pattern, flags).alias("n"))
    when = F.session_window("at", session) if session else F.window("at", window, slide)
    out = hits.groupBy(when.alias("window"), *keys).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce((F.col("n") > 0).cast("long"), F.lit(0))).alias("n_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"))
    return out.select(*keys, F.col("window.start").alias("start"), "n_rows", "n_hit", "n_matches")
