"""Model features of flow events: per event, and per source address and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rampart.functions.ip import is_private
from rampart.functions.ocsf import lookup, optional
from rampart.functions.times import day_of_week, floor_ns, hour_of_day, seconds

# Columns the features read; nothing else of the silver schema is scanned.
SOURCE_COLUMNS = {
    "event_uid": "string", "time": "bigint", "src_ip": "string", "dst_ip": "string", "dst_port": "bigint",
    "protocol": "string", "action_id": "bigint", "severity_id": "bigint", "bytes_in": "bigint", "bytes_out": "bigint",
    "duration": "double", "connection_info.protocol_num": "bigint", "connection_info.direction_id": "bigint",
    "traffic.packets": "bigint", "traffic.packets_in": "bigint", "traffic.packets_out": "bigint",
}
PER_EVENT = ["bytes_in", "bytes_out", "bytes_ratio", "packets", "duration", "dst_port", "is_well_known_port",
             "is_ephemeral_port", "protocol_num", "action_id", "severity_id", "hour_of_day", "day_of_week",
             "is_private_src", "is_private_dst", "direction_id"]
WINDOWED = ["connection_count", "distinct_dst_ips", "distinct_dst_ports", "deny_ratio", "total_bytes_out",
            "mean_bytes_per_conn", "distinct_protocols"]
MODEL_COLUMNS = PER_EVENT + [f"win_{w}" for w in WINDOWED]
# Protocol numbers by name.
PROTOCOL_NUMBERS = {"icmp": 1, "igmp": 2, "ipv4": 4, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "icmpv6": 58,
                    "ipv6-icmp": 58, "eigrp": 88, "ospf": 89, "sctp": 132}
WELL_KNOWN_MAX, EPHEMERAL_MIN = 1023, 49152
INBOUND, OUTBOUND, LATERAL, UNKNOWN = 1, 2, 3, 0
# Windows are counted by hash bucket; those of a bucket of more rows are counted by all tasks. Heavy buckets are broadcast, so there are few.
BUCKETS, HOT_ROWS = 1 << 17, 1_000_000


def load_feature_columns(df: DataFrame, date: str | None = None, source_type: str | None = None) -> DataFrame:
    """The 16 feature inputs (typed nulls where a column is missing) of one partition, plus ``source_type`` and ``date``."""
    df = df.filter(F.col("date") == date) if date is not None else df
    df = df.filter(F.col("source_type") == source_type) if source_type is not None else df
    keys = [F.col(c) for c in ("source_type", "date") if c in df.columns]
    return df.select(*[optional(df, n, k).cast(k).alias(n) for n, k in SOURCE_COLUMNS.items()], *keys)


def _amount(df: DataFrame, name: str, kind: str = "bigint") -> Column:
    """A non-negative number, 0 when missing."""
    return F.greatest(F.coalesce(optional(df, name, kind).cast(kind), F.lit(0).cast(kind)), F.lit(0).cast(kind))


def protocol_number(df: DataFrame) -> Column:
    named = lookup(PROTOCOL_NUMBERS, F.lower(optional(df, "protocol")))
    return F.coalesce(optional(df, "connection_info.protocol_num", "bigint"), named, F.lit(0)).cast("bigint")


def _event_columns(df: DataFrame) -> dict[str, Column]:
    port = _amount(df, "dst_port")
    halves = F.coalesce(optional(df, "traffic.packets_in", "bigint"), F.lit(0)) + F.coalesce(optional(df, "traffic.packets_out", "bigint"), F.lit(0))
    flag = lambda c: c.cast("int")
    private = lambda name: F.coalesce(is_private(optional(df, name)), F.lit(False))
    inferred = (
        F.when(F.col("_ps") & ~F.col("_pd"), OUTBOUND).when(~F.col("_ps") & F.col("_pd"), INBOUND)
        .when(F.col("_ps") & F.col("_pd"), LATERAL).otherwise(UNKNOWN)
    )
    time = optional(df, "time", "bigint")
    return {
        "_ps": private("src_ip"), "_pd": private("dst_ip"), "_inferred": inferred,
        "bytes_in": _amount(df, "bytes_in"), "bytes_out": _amount(df, "bytes_out"),
        "bytes_ratio": _amount(df, "bytes_out") / (_amount(df, "bytes_in") + F.lit(1.0)),
        "packets": F.greatest(F.coalesce(optional(df, "traffic.packets", "bigint"), halves), F.lit(0)).cast("bigint"),
        "duration": _amount(df, "duration", "double"), "dst_port": port,
        "is_well_known_port": flag(port.between(1, WELL_KNOWN_MAX)), "is_ephemeral_port": flag(port >= EPHEMERAL_MIN),
        "protocol_num": protocol_number(df),
        "action_id": F.coalesce(optional(df, "action_id", "bigint"), F.lit(0)).cast("bigint"),
        "severity_id": F.coalesce(optional(df, "severity_id", "bigint"), F.lit(0)).cast("bigint"),
        "hour_of_day": F.coalesce(hour_of_day(time), F.lit(-1)), "day_of_week": F.coalesce(day_of_week(time), F.lit(-1)),
    }


def per_event_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``event_uid, src_ip, time`` and the 16 per-event features; ``keep`` carries further columns."""
    c = _event_columns(df)
    flagged = df.withColumns({"_ps": c["_ps"], "_pd": c["_pd"]})
    direction = F.coalesce(optional(df, "connection_info.direction_id", "bigint"), c["_inferred"].cast("bigint"))
    plain = [c[n].alias(n) for n in PER_EVENT if n in c]
    return flagged.select(
        "event_uid", "src_ip", "time", *[F.col(k) for k in keep or []], *plain,
        F.col("_ps").cast("int").alias("is_private_src"), F.col("_pd").cast("int").alias("is_private_dst"),
        direction.alias("direction_id"),
    )


def windowed_source_features(df: DataFrame, window: str = "5min", keys: list[str] | None = None) -> DataFrame:
    """Seven aggregates per (``keys``, src_ip, floored window); rows without address or time are left out.

    ``keys`` names the partition columns (event date, source type) that windows do not cross.
    Rows move once, by group, and the first row of each value in a sorted group counts as distinct. Groups in hash
    buckets of more than ``HOT_ROWS`` rows aggregate in two steps on (group, value), so a hot address spreads over tasks.
    """
    group = ["window_start", *(keys or []), "src_ip"]  # the number first: it decides most comparisons of a sort
    volume = _amount(df, "bytes_in") + _amount(df, "bytes_out")
    base = df.filter(F.col("src_ip").isNotNull() & F.col("time").isNotNull()).select(
        *(keys or []), "src_ip", floor_ns(F.col("time"), seconds(window)).alias("window_start"),
        optional(df, "dst_ip").alias("dst_ip"), optional(df, "dst_port", "bigint").alias("dst_port"),
        protocol_number(df).alias("protocol_num"),
        F.coalesce((optional(df, "action_id", "bigint") == 2).cast("int"), F.lit(0)).alias("is_deny"),
        _amount(df, "bytes_out").alias("bytes_out"), volume.alias("total_bytes"),
    ).withColumn("_bucket", F.pmod(F.xxhash64(*group), F.lit(BUCKETS)))
    heavy = F.broadcast(base.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select("_bucket"))
    sorted_once = base.join(heavy, "_bucket", "left_anti").drop("_bucket").repartition(*group)
    for value in ("dst_ip", "dst_port", "protocol_num"):
        before = F.lag(value).over(Window.partitionBy(*group).orderBy(value))
        sorted_once = sorted_once.withColumn(f"_{value}", (F.col(value).isNotNull() & ~before.eqNullSafe(F.col(value))).cast("int"))

    def aggregated(rows: DataFrame, distinct) -> DataFrame:
        return rows.groupBy(*(keys or []), "src_ip", "window_start").agg(
            F.count("*").alias("connection_count"),
            distinct("dst_ip").alias("distinct_dst_ips"), distinct("dst_port").alias("distinct_dst_ports"),
            F.avg("is_deny").alias("deny_ratio"), F.sum("bytes_out").alias("total_bytes_out"),
            F.avg("total_bytes").alias("mean_bytes_per_conn"), distinct("protocol_num").alias("distinct_protocols"),
        )

    hot = aggregated(base.join(heavy, "_bucket", "left_semi"), F.countDistinct)
    return aggregated(sorted_once, lambda value: F.sum(f"_{value}")).union(hot)


def add_window_features(features: DataFrame, windows: DataFrame, window: str = "5min", keys: list[str] | None = None) -> DataFrame:
    """Each event with its window's aggregates as ``win_*``; events without an address keep nulls.

    The window side has one row per key, so adaptive skew handling can split a hot key
    on the event side.
    """
    keys = keys or []
    joined = features.withColumn("_window", floor_ns(F.col("time"), seconds(window)))
    right = windows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("src_ip").alias("_src"),
                           F.col("window_start").alias("_start"), *[F.col(w).alias(f"win_{w}") for w in WINDOWED])
    on = (F.col("src_ip") == F.col("_src")) & (F.col("_window") == F.col("_start"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return joined.join(right, on, "left").drop("_window", "_src", "_start", *[f"_{k}" for k in keys])


def extract_features(df: DataFrame, window: str = "5min", keys: list[str] | None = None) -> DataFrame:
    """Ids, 16 per-event and 7 window features of every event."""
    keys = [k for k in (keys or []) if k in df.columns]
    per = per_event_features(df, keep=keys)
    return add_window_features(per, windowed_source_features(df, window, keys), window, keys)
