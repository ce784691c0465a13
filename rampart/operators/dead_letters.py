"""Dead letters, their resolutions and the health of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rampart.functions.ocsf import completeness
from rampart.operators.lake import recent_per_source, stats_by_source

PREVIEW_CHARS = 300
COMPLETENESS_ROWS = 200


def resolved_uids(resolutions: DataFrame) -> DataFrame:
    return resolutions.select("event_uid").distinct()


def unresolved(dead: DataFrame, resolutions: DataFrame) -> DataFrame:
    return dead.join(resolved_uids(resolutions), "event_uid", "left_anti")


def with_resolved(dead: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Add the ``resolved`` flag."""
    done = resolved_uids(resolutions).withColumn("_done", F.lit(True))
    return dead.join(done, "event_uid", "left").withColumn("resolved", F.coalesce("_done", F.lit(False))).drop("_done")


def filter_dead_letters(dead: DataFrame, resolutions: DataFrame | None = None, reason=None, stage=None, since_ns=None, unresolved_only=False) -> DataFrame:
    for name, value in (("reason", reason), ("stage", stage)):
        dead = dead.filter(F.col(name) == value) if value is not None else dead
    dead = dead.filter(F.col("ts_ns") >= since_ns) if since_ns is not None else dead
    return unresolved(dead, resolutions) if unresolved_only and resolutions is not None else dead


def recent_dead_letters(dead: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    out = dead.orderBy(F.desc("ts_ns"), "event_uid")
    return (out.offset(offset) if offset else out).limit(limit)


def sample_dead_letters(dead: DataFrame, reason: str, limit: int) -> DataFrame:
    """Oldest letters of one reason."""
    return dead.filter(F.col("reason") == reason).orderBy("ts_ns", "event_uid").limit(limit)


def preview_dead_letters(dead: DataFrame, resolutions: DataFrame) -> DataFrame:
    """First 300 characters of the raw text, whether it was cut, and the resolved flag."""
    text = F.make_valid_utf8(F.col("raw").cast("string"))
    cut = with_resolved(dead, resolutions).withColumns({"preview": F.substring(text, 1, PREVIEW_CHARS), "truncated": F.length(text) > PREVIEW_CHARS})
    return cut.drop("raw")


def dead_letter_stats(dead: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``kind, name, total, resolved, unresolved`` overall (kind ``all``), by reason and by stage."""
    flagged = with_resolved(dead, resolutions).withColumn("_r", F.col("resolved").cast("bigint"))
    out = flagged.groupingSets([["reason"], ["stage"], []], "reason", "stage").agg(
        F.grouping("reason").alias("_gr"), F.grouping("stage").alias("_gs"), F.count("*").alias("total"), F.coalesce(F.sum("_r"), F.lit(0)).alias("resolved"),
    )
    kind = F.when(F.col("_gr") == 0, "reason").when(F.col("_gs") == 0, "stage").otherwise("all")
    name = F.when(F.col("_gr") == 0, F.col("reason")).when(F.col("_gs") == 0, F.col("stage"))
    return out.select(kind.alias("kind"), name.alias("name"), "total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"))


def dead_letters_by_source(dead: DataFrame) -> DataFrame:
    source = F.get_json_object("detail", "$.source_type")
    return dead.withColumn("source_type", source).filter(F.coalesce("source_type", F.lit("")) != "").groupBy("source_type").agg(F.count("*").alias("dead_letters"))


def avg_completeness(silver: DataFrame, n: int = COMPLETENESS_ROWS) -> DataFrame:
    """Mean completeness over the ``n`` newest rows of each source, rounded to 4 digits."""
    rows = recent_per_source(silver, n)
    return rows.withColumn("_c", completeness(rows)).groupBy("source_type").agg(F.round(F.avg("_c"), 4).alias("avg_completeness"))


def source_health(definitions: DataFrame, silver: DataFrame, dead: DataFrame, n: int = COMPLETENESS_ROWS) -> DataFrame:
    """Each definition (``name, vendor, product, version, enabled``) with events seen, parse rate,
    average completeness and last event time."""
    stats = stats_by_source(silver).select(F.col("source_type").alias("name"), F.col("events"), F.col("last_time_ns"))
    letters = dead_letters_by_source(dead).withColumnRenamed("source_type", "name")
    quality = avg_completeness(silver, n).withColumnRenamed("source_type", "name")
    out = definitions.join(stats, "name", "left").join(letters, "name", "left").join(quality, "name", "left")
    seen, lost = F.coalesce("events", F.lit(0)), F.coalesce("dead_letters", F.lit(0))
    return out.select("name", "vendor", "product", "version", "enabled", seen.alias("events_seen"),
                      F.when(seen + lost > 0, F.round(seen / (seen + lost), 4)).alias("parse_rate"), "avg_completeness", F.col("last_time_ns").alias("last_event_ns"))


def replay_source(dead: DataFrame, bronze: DataFrame) -> DataFrame:
    """Raw events to replay: the bronze copy where there is one, else the letter's own bytes."""
    kept = bronze.select("event_uid", *[F.col(c).alias(f"_b_{c}") for c in ("raw", "raw_hash", "raw_len", "ingest_time_ns", "source_id", "transport", "peer")])
    out = dead.join(kept, "event_uid", "left")
    pick = lambda c, own: F.when(F.col("_b_raw").isNotNull(), F.col(f"_b_{c}")).otherwise(own).alias(c)
    return out.select(
        "event_uid", pick("raw", F.col("raw")), pick("raw_hash", F.col("raw_hash")), pick("raw_len", F.octet_length("raw")),
        pick("ingest_time_ns", F.col("ts_ns")), pick("source_id", F.lit("dlq-replay")), pick("transport", F.lit("file")), pick("peer", F.lit(None).cast("string")),
        F.col("reason").alias("original_reason"), F.col("stage").alias("original_stage"),
    )
