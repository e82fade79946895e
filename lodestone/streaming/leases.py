"""Streams: gap sessions and expiry of leases. Neither is needed by the batch operators; both use built-in state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, *, key="user_id", ts="ts", gap="30 minutes", late="1 hour") -> DataFrame:
    """Sessions of events of a key less than ``gap`` apart: (key, start, end, n). Works on streams and tables alike."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    g = d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expirations(locks: DataFrame, *, ts="locked_at", lease="30 seconds", late="1 minute") -> DataFrame:
    """(lock_token, expires_at) of each lease once event time has passed its end."""
    d = locks.withWatermark(ts, late) if locks.isStreaming else locks
    return d.groupBy(F.session_window(ts, lease).alias("w"), "lock_token").agg(F.count("*").alias("renewals")).select("lock_token", F.col("w.end").alias("expires_at"), "renewals")
