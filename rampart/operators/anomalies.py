"""Reading the anomaly table: latest scoring per event, lists and timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rampart.functions.times import NS, floor_div


def latest_scores(df: DataFrame) -> DataFrame:
    """One row per event: its newest scoring (of equal times the higher score). Aggregated before the
    shuffle, so an event scored many times costs one row."""
    rest = [c for c in df.columns if c != "event_uid"]
    latest = df.groupBy("event_uid").agg(F.max_by(F.struct(*rest), F.struct("scored_at_ns", "anomaly_score")).alias("_r"))
    return latest.select("event_uid", *[F.col(f"_r.{c}").alias(c) for c in rest])


def recent_anomalies(df: DataFrame, limit: int = 100, min_score: float | None = None, only_anomalies: bool = True, since_ns: int | None = None) -> DataFrame:
    """Newest scorings first, then the highest scores."""
    out = latest_scores(df)
    out = out.filter("is_anomaly") if only_anomalies else out
    out = out.filter(F.col("anomaly_score") >= min_score) if min_score is not None else out
    out = out.filter(F.col("scored_at_ns") >= since_ns) if since_ns is not None else out
    return out.orderBy(F.desc("scored_at_ns"), F.desc("anomaly_score"), "event_uid").limit(max(1, int(limit)))


def anomaly_timeline(df: DataFrame, window_seconds: int, bucket_seconds: int) -> DataFrame:
    """Scored and flagged events with the highest and mean score per bucket of the last window,
    counted back from the newest event."""
    width, span = max(1, int(bucket_seconds)) * NS, max(1, int(window_seconds)) * NS
    latest = latest_scores(df)
    newest = df.agg(F.max("event_time_ns").alias("_newest"))  # one row; every event is in latest too
    kept = latest.crossJoin(F.broadcast(newest)).filter(F.col("event_time_ns") >= F.col("_newest") - span)
    bucket = floor_div(F.col("event_time_ns"), width) * width
    return kept.groupBy(bucket.alias("bucket_ns")).agg(
        F.count("*").alias("scored"), F.count_if("is_anomaly").alias("anomalies"), F.max("anomaly_score").alias("max_score"), F.avg("anomaly_score").alias("mean_score"),
    ).orderBy("bucket_ns")
