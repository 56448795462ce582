"""Sessions over a stream of trace points (an extension; trips arrive as finite files elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trip_sessions(points: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each trip in ``points(trip, ts, y, x)``, batch or stream: a gap ends one, points over ``late`` are left out of streams."""
    out = points.withWatermark("ts", late) if points.isStreaming else points
    w = F.session_window("ts", gap)
    return out.groupBy("trip", w).agg(F.count("*").alias("samples"), F.min("y").alias("miny"), F.max("y").alias("maxy"), F.min("x").alias("minx"), F.max("x").alias("maxx")).select("trip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples", "miny", "maxy", "minx", "maxx")
