"""Questions asked of the silver table: search, lists, counts, series, pages."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rampart.functions.times import NS, event_date, floor_ns, seconds, to_timestamp
from rampart.schemas import SILVER

MAX_LIMIT = 10_000
MAX_PAGE = 500
# Week buckets start on Monday 2000-01-03, other widths count from there too.
SERIES_ORIGIN_S = 946_857_600
MAX_RANGE_DAYS = 366


def checked_limit(limit: int, most: int = MAX_LIMIT) -> int:
    """``limit``; one beyond ``most`` is refused rather than cut."""
    if not 1 <= int(limit) <= most:
        raise ValueError(f"limit must be 1..{most}, not {limit}")
    return int(limit)


def search(df: DataFrame, filters: dict, limit: int | None = None, most: int = MAX_LIMIT) -> DataFrame:
    """Equality on core columns plus ``since_ns``/``until_ns``; an unknown column is an error."""
    for key, value in filters.items():
        if key == "since_ns":
            df = df.filter(F.col("time") >= int(value))
        elif key == "until_ns":
            df = df.filter(F.col("time") <= int(value))
        elif key in SILVER:
            df = df.filter(F.col(key) == F.lit(value))
        else:
            raise ValueError(f"events cannot be filtered by {key!r}")
    return df if limit is None else recent_events(df, limit, most)


def filter_events(
    df: DataFrame, *, source_type=None, class_uid=None, action_id=None, src_ip=None, dst_ip=None, port=None,
    severity_id=None, time_from=None, time_to=None, q=None,
) -> DataFrame:
    """Event-list filters; ``port`` matches either side and ``q`` is free text (``%``/``_`` are wildcards)."""
    same = {"source_type": source_type, "class_uid": class_uid, "action_id": action_id, "src_ip": src_ip,
            "dst_ip": dst_ip, "severity_id": severity_id}
    for name, value in same.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if port is not None:
        df = df.filter((F.col("src_port") == port) | (F.col("dst_port") == port))
    if time_from is not None:
        df = df.filter(F.col("time") >= time_from)
    if time_to is not None:
        df = df.filter(F.col("time") <= time_to)
    if q:
        hit = F.lit(False)
        for name in ("unmapped_json", "enrichments_json", "src_ip", "dst_ip"):
            hit = hit | F.coalesce(F.col(name).ilike(f"%{q}%"), F.lit(False))
        df = df.filter(hit)
    return df


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.col("time").desc_nulls_last(), F.col("event_uid")]


def recent_events(df: DataFrame, limit: int = 100, most: int = MAX_LIMIT) -> DataFrame:
    """Newest events first; a top-k, not a full sort."""
    return df.orderBy(*_newest_first(df)).limit(checked_limit(limit, most))


def by_source(df: DataFrame, source_type: str, limit: int = 100, most: int = MAX_LIMIT) -> DataFrame:
    return recent_events(df.filter(F.col("source_type") == source_type), limit, most)


def page(df: DataFrame, number: int, size: int = 50) -> tuple[DataFrame, int]:
    """One page, newest first, and the total number of rows."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be >= 1 and size 1..{MAX_PAGE}")
    return df.orderBy(*_newest_first(df)).offset((number - 1) * size).limit(size), df.count()


def page_after(df: DataFrame, cursor: tuple[int | None, str] | None = None, size: int = 50) -> DataFrame:
    """The page that follows ``cursor``, newest first; the first one without a cursor.

    A cursor is the time and the id of the last row seen (``cursor_of``). Rows up to it are filtered, not sorted, so any
    page is a top-k of what is left, and rows that arrive in between shift nothing.
    """
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows, not {size}")
    order = [F.col("time").desc_nulls_last(), F.col("event_uid").asc()]
    if cursor is not None:
        at, uid = cursor
        later_id = F.col("event_uid") > F.lit(uid)
        untimed = F.col("time").isNull()
        df = df.filter(untimed & later_id) if at is None else df.filter(untimed | (F.col("time") < F.lit(at)) | ((F.col("time") == F.lit(at)) & later_id))
    return df.orderBy(*order).limit(size)


def cursor_of(rows: DataFrame) -> tuple[int | None, str] | None:
    """The cursor after a page; none after an empty one. A page is at most ``MAX_PAGE`` rows."""
    last = rows.select("time", "event_uid").collect()[-1:]
    return (last[0]["time"], last[0]["event_uid"]) if last else None


def recent_per_source(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows of every source; Spark prunes to ``n`` per partition before the shuffle."""
    w = Window.partitionBy("source_type").orderBy(*_newest_first(df))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def silver_between(df: DataFrame, date_from: str, date_to: str, sources: list[str] | None = None) -> DataFrame:
    """Rows of an inclusive event-date range of at most 366 days (partition pruning on ``date``)."""
    start, end = date.fromisoformat(date_from), date.fromisoformat(date_to)
    if end < start:
        raise ValueError(f"{date_to} is before {date_from}")
    if (end - start).days >= MAX_RANGE_DAYS:
        raise ValueError(f"{(end - start).days + 1} days asked for, {MAX_RANGE_DAYS} is the most")
    df = df.filter(F.col("date").between(date_from, date_to))
    return df if sources is None else df.filter(F.col("source_type").isin(sources))


def recent_window(df: DataFrame, minutes: float, now_ns: int) -> DataFrame:
    """Rows of the last ``minutes`` before ``now_ns``; the date partitions are pruned first."""
    start = now_ns - int(minutes * 60 * NS)
    day = lambda ns: datetime.fromtimestamp(ns // NS, UTC).date()
    days = [(day(start) + timedelta(d)).isoformat() for d in range((day(now_ns) - day(start)).days + 1)]
    df = df.filter(F.col("date").isin(days)) if "date" in df.columns else df
    return df.filter(F.col("time").between(start, now_ns))


def with_event_date(df: DataFrame) -> DataFrame:
    ingest = F.col("ingest_time_ns") if "ingest_time_ns" in df.columns else None
    return df.withColumn("date", event_date(F.col("time"), ingest))


# -- counts --------------------------------------------------------------------------


def stats_by_source(df: DataFrame, exact: bool = True) -> DataFrame:
    """Events, time span, bytes and distinct source addresses of every source."""
    distinct = F.countDistinct("src_ip") if exact else F.approx_count_distinct("src_ip")
    volume = F.coalesce(F.col("bytes_in"), F.lit(0)) + F.coalesce(F.col("bytes_out"), F.lit(0))
    return df.groupBy("source_type").agg(
        F.count("*").alias("events"), F.min("time").alias("first_time_ns"), F.max("time").alias("last_time_ns"),
        F.sum(volume).alias("total_bytes"), distinct.alias("distinct_src_ip"),
    ).orderBy(F.desc("events"), "source_type")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("events")).orderBy(F.desc("events"), column)


def counts_by_class(df: DataFrame) -> DataFrame:
    return counts_by(df, "class_uid")


def counts_by_action(df: DataFrame) -> DataFrame:
    return counts_by(df, "action_id")


def summary(silver: DataFrame, dead: DataFrame) -> DataFrame:
    """Total events, total dead letters and their share (0 when there is nothing)."""
    total, dlq = silver.agg(F.count("*").alias("total_events")), dead.agg(F.count("*").alias("dlq_total"))
    both = F.col("total_events") + F.col("dlq_total")
    rate = F.when(both > 0, F.round(F.col("dlq_total") / both, 4)).otherwise(F.lit(0.0))
    return total.crossJoin(F.broadcast(dlq)).withColumn("dlq_rate", rate)  # one row each


def timeseries(df: DataFrame, interval: str, window: str) -> DataFrame:
    """Events per bucket and source over the last ``window``, counted back from the newest bucket."""
    width, span = seconds(interval), seconds(window)
    counted = (
        df.filter(F.col("time").isNotNull())
        .groupBy(floor_ns(F.col("time"), width, SERIES_ORIGIN_S).alias("bucket_ns"), "source_type")
        .agg(F.count("*").alias("events"))
    )
    # the newest bucket comes from the small counted table, so the events are read once
    newest = counted.agg(F.max("bucket_ns").alias("_newest"))
    kept = counted.crossJoin(F.broadcast(newest)).filter(F.col("bucket_ns") >= F.col("_newest") - span * NS)
    text = F.date_format(to_timestamp(F.col("bucket_ns")), "yyyy-MM-dd'T'HH:mm:ss")
    return kept.select(text.alias("bucket"), "source_type", "events").orderBy("bucket", "source_type")


def timeseries_pivot(points: DataFrame, sources: list[str], bucket_seconds: int = 60) -> DataFrame:
    """One column per source with its events per second, 0 where a bucket has none."""
    wide = points.groupBy("bucket").pivot("source_type", sources).agg(F.sum("events"))
    rate = [(F.coalesce(F.col(f"`{s}`"), F.lit(0)) / bucket_seconds).alias(s) for s in sources]
    return wide.select("bucket", F.substring("bucket", 12, 5).alias("label"), *rate).orderBy("bucket")


def lake_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """Ad-hoc SQL over named views (``events``, ``dead_letters``, ``anomalies``) with bound parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})
