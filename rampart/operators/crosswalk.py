"""OCSF flat records to other event models: ECS documents, CIM events, warehouse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rampart.functions.ocsf import has, lookup, optional
from rampart.functions.times import NS, event_date, to_timestamp
from rampart.operators.enrich import ip_columns
from rampart.operators.flatten import core_columns

ECS_VERSION = "8.11.0"
# Class -> (categories, types, kind); CIM words.
ECS_CLASSES = {
    4001: (["network"], ["connection"], "event"), 4002: (["network", "web"], ["connection", "protocol"], "event"),
    4003: (["network"], ["connection", "protocol"], "event"), 2004: (["intrusion_detection"], ["info"], "alert"),
}
CIM_ACTIONS = {"Allowed": "allowed", "Denied": "blocked", "Blocked": "blocked", "Dropped": "blocked"}
CIM_SEVERITIES = {0: "unknown", 1: "informational", 2: "low", 3: "medium", 4: "high", 5: "critical", 6: "critical"}


def _text(df: DataFrame, path: str) -> Column:
    return F.nullif(optional(df, path).cast("string"), F.lit(""))


def _number(df: DataFrame, path: str) -> Column:
    return optional(df, path, "bigint").try_cast("bigint")


def _extra(df: DataFrame, key: str) -> Column:
    return F.nullif(F.element_at("unmapped", key), F.lit("")) if has(df, "unmapped") else F.lit(None).cast("string")


def _digits(c: Column) -> Column:
    return F.when(c.rlike(r"^-*\d+\z"), c.try_cast("bigint"))


def _pruned(**fields: Column) -> Column:
    """A struct, null when every field is null (so JSON leaves it out)."""
    return F.when(F.coalesce(*[c.cast("string") for c in fields.values()]).isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def _sum_or(df: DataFrame, total: str, a: str, b: str) -> Column:
    left, right = _number(df, a), _number(df, b)
    both = F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.when(left.isNotNull() | right.isNotNull(), both).otherwise(_number(df, total))


def to_ecs(df: DataFrame) -> DataFrame:
    """Add ``ecs``: one nested ECS document per record, empty branches null."""
    class_uid = optional(df, "class_uid", "bigint")
    words = lambda i: F.coalesce(*[F.when(class_uid == u, F.array(*[F.lit(w) for w in spec[i]])) for u, spec in ECS_CLASSES.items()])
    micros = to_timestamp(optional(df, "time", "bigint"))
    fraction = F.when(optional(df, "time", "bigint") % NS >= 1000, F.date_format(micros, "'.'SSSSSS")).otherwise(F.lit(""))
    stamp = F.concat(F.date_format(micros, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))

    def end(side: str, volume: str) -> Column:
        nat = _pruned(ip=_extra(df, f"nat_{side}_ip"), port=_digits(_extra(df, f"nat_{side}_port")))
        at = f"{side}_endpoint"
        return _pruned(ip=_text(df, f"{at}.ip"), port=_number(df, f"{at}.port"), mac=_text(df, f"{at}.mac"),
                       domain=_text(df, f"{at}.hostname"), bytes=_number(df, f"traffic.{volume}"), nat=nat)

    ips = [_text(df, c) for c in ip_columns(df)] + [_extra(df, k) for k in ("nat_src_ip", "nat_dst_ip")]
    related = F.array_sort(F.array_distinct(F.array_compact(F.array(*ips))))
    types = optional(df, "finding_info.types")
    zone = lambda side: _pruned(zone=_extra(df, f"{side}_zone"))
    doc = F.struct(
        stamp.alias("@timestamp"),
        F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        F.struct(
            F.coalesce(*[F.when(class_uid == u, spec[2]) for u, spec in ECS_CLASSES.items()], F.lit("event")).alias("kind"),
            words(0).alias("category"), words(1).alias("type"), _text(df, "action").alias("action"),
            _number(df, "severity_id").alias("severity"), _text(df, "metadata.uid").alias("id"),
        ).alias("event"),
        end("src", "bytes_out").alias("source"), end("dst", "bytes_in").alias("destination"),
        _pruned(transport=F.lower(_text(df, "connection_info.protocol_name")), iana_number=_number(df, "connection_info.protocol_num"),
                bytes=_sum_or(df, "traffic.bytes", "traffic.bytes_out", "traffic.bytes_in")).alias("network"),
        _pruned(name=F.coalesce(_text(df, "firewall_rule.name"), _text(df, "finding_info.title")),
                id=F.coalesce(_text(df, "firewall_rule.uid"), _text(df, "finding_info.uid")), category=types).alias("rule"),
        _pruned(vendor=_text(df, "metadata.product.vendor_name"), product=_text(df, "metadata.product.name"),
                ingress=zone("src"), egress=zone("dst")).alias("observer"),
        F.when(F.size(related) > 0, F.struct(related.alias("ip"))).alias("related"),
    )
    return df.withColumn("ecs", doc)


def _vendor_product(df: DataFrame) -> Column:
    return F.nullif(F.concat_ws(" ", _text(df, "metadata.product.vendor_name"), _text(df, "metadata.product.name")), F.lit(""))


def to_cim(df: DataFrame) -> DataFrame:
    """Add ``cim``: the CIM field set of the record's class with its tags."""
    class_uid = optional(df, "class_uid", "bigint")
    traffic, alert = F.coalesce(class_uid == 4001, F.lit(False)), F.coalesce(class_uid == 2004, F.lit(False))
    by_id = lookup({1: "allowed", 2: "blocked"}, optional(df, "action_id", "bigint"))
    action = F.coalesce(by_id, lookup(CIM_ACTIONS, optional(df, "action")), lookup(CIM_ACTIONS, optional(df, "disposition")))
    severity = F.coalesce(F.lower(_text(df, "severity")), lookup(CIM_SEVERITIES, optional(df, "severity_id", "bigint")))
    only = lambda test, c: F.when(test, c)
    event = F.struct(
        _text(df, "src_endpoint.ip").alias("src"), only(traffic, _number(df, "src_endpoint.port")).alias("src_port"),
        _text(df, "dst_endpoint.ip").alias("dest"), only(traffic, _number(df, "dst_endpoint.port")).alias("dest_port"),
        only(traffic, F.lower(_text(df, "connection_info.protocol_name"))).alias("transport"), only(traffic, action).alias("action"),
        only(traffic, _sum_or(df, "traffic.bytes", "traffic.bytes_out", "traffic.bytes_in")).alias("bytes"),
        only(traffic, _number(df, "traffic.bytes_in")).alias("bytes_in"), only(traffic, _number(df, "traffic.bytes_out")).alias("bytes_out"),
        only(traffic, _sum_or(df, "traffic.packets", "traffic.packets_out", "traffic.packets_in")).alias("packets"),
        only(traffic, F.coalesce(_text(df, "firewall_rule.name"), _text(df, "firewall_rule.uid"))).alias("rule"),
        only(alert, _text(df, "finding_info.title")).alias("signature"), only(alert, _text(df, "finding_info.uid")).alias("signature_id"),
        only(alert, severity).alias("severity"), only(alert, F.lit("network")).alias("ids_type"),
        _vendor_product(df).alias("vendor_product"),
        F.when(traffic, F.array(F.lit("network"), F.lit("communicate"))).when(alert, F.array(F.lit("ids"), F.lit("attack")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    return df.withColumn("cim", event)


def to_warehouse_rows(df: DataFrame) -> DataFrame:
    """The 17 core columns with ``unmapped``/``enrichments`` JSON text; a missing time is the ingest time."""
    core = core_columns(df)
    core["time"] = F.coalesce(core["time"], optional(df, "ingest_time_ns", "bigint"))
    core["source_type"] = F.coalesce(F.nullif(core["source_type"], F.lit("")), F.lit("unknown"))
    text = lambda n: F.coalesce(optional(df, f"{n}_json"), F.lit("{}")).alias(n)
    return df.select(*[c.alias(n) for n, c in core.items()], text("unmapped"), text("enrichments"))


def merge_latest(df: DataFrame, version: str = "mapping_version") -> DataFrame:
    """One row per (time, source_type, event_uid): the last version stays. Aggregates before the
    shuffle, so repeated copies of one event never meet in a sort."""
    keys = ["time", "source_type", "event_uid"]
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(version), F.xxhash64(*[F.col(f"`{c}`") for c in rest])) if version in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_r"))
    return latest.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def to_ecs_bulk(df: DataFrame, prefix: str = "events") -> DataFrame:
    """``value``: the two bulk lines (action, document) per record; the index is daily, the id is the event."""
    out = to_ecs(df)
    day = F.replace(event_date(optional(df, "time", "bigint"), optional(df, "ingest_time_ns", "bigint")), F.lit("-"), F.lit("."))
    action = F.to_json(F.struct(F.struct(F.concat(F.lit(f"{prefix}-"), day).alias("_index"), F.col("event_uid").alias("_id")).alias("index")))
    return out.select("event_uid", F.concat_ws("\n", action, F.to_json("ecs")).alias("value"))


def to_hec_envelopes(df: DataFrame, source: str = "rampart", host: str = "rampart", index: str | None = None) -> DataFrame:
    """``value``: one collector envelope per record with the CIM event and fractional seconds."""
    out = to_cim(df)
    at = F.coalesce(F.nullif(optional(df, "time", "bigint"), F.lit(0)), optional(df, "ingest_time_ns", "bigint"))
    kind = F.coalesce(F.nullif(optional(df, "source_type"), F.lit("")), F.lit("unknown"))
    parts = [(at / NS).alias("time"), F.lit(host).alias("host"), F.lit(source).alias("source"), kind.alias("sourcetype"), F.col("cim").alias("event")]
    parts += [F.lit(index).alias("index")] if index else []
    return out.select("event_uid", F.to_json(F.struct(*parts)).alias("value"))
