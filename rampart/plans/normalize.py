"""The whole batch from raw lines to validated OCSF records and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from rampart.definitions import Definition
from rampart.functions import ocsf
from rampart.functions.text import decode_text, has_bom
from rampart.operators.normalize import map_fields, match_source, parse_matched, prepare, sniffed_fields
from rampart.functions.text import canonical_json
from rampart.functions.times import parse_ts_ns

RAW_COLUMNS = ["event_uid", "raw", "raw_hash", "raw_len", "ingest_time_ns", "source_id", "transport", "peer"]
SCRATCH = ["text", "bom_stripped", "envelope", "message", "outer_format", "payload", "json_flat", "fields", "mapping_error", "parse_error"]


def normalize(
    raw: DataFrame,
    defs: list[Definition],
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    run_tag: str | None = None,
    keep_fields: bool = False,
) -> DataFrame:
    """One outcome row per raw event: flat OCSF columns, ``status`` (``ok``/``dead``/``template_only``)
    and, for dead rows, ``reason``, ``stage`` and ``detail``; ``parsed`` tells whether the line's engine could read it.

    Everything up to the sinks is a single projection: no shuffle, no Python worker.
    """
    df = raw.withColumn("text", decode_text(F.col("raw"))).withColumn("bom_stripped", has_bom(F.col("raw")))
    df = match_source(prepare(df), defs)
    df = map_fields(parse_matched(df, defs), defs)
    unknown = F.col("source_type").isNull()
    leftovers = sniffed_fields(df)
    stamp = parse_ts_ns(F.element_at(F.col("envelope"), "timestamp"), now_ns=F.col("ingest_time_ns"))
    df = df.withColumns({
        "class_uid": F.when(unknown, F.lit(4001)).otherwise(F.col("class_uid")).cast("bigint"),
        "category_uid": F.when(unknown, F.lit(4)).otherwise(F.col("category_uid")).cast("bigint"),
        "time": F.when(unknown, F.coalesce(stamp, F.col("ingest_time_ns"))).otherwise(F.col("time")),
        "unmapped": F.when(unknown, F.map_filter(leftovers, lambda k, v: v.isNotNull())).otherwise(F.col("unmapped")),
        "unmapped_json": F.when(unknown, canonical_json(leftovers)).otherwise(F.col("unmapped_json")),
        "mapping_version": F.when(unknown, "none").otherwise(F.col("mapping_version")),
        "source_type": F.coalesce(F.col("source_type"), F.lit("unknown")),
    })
    if run_tag is not None:
        tag = F.when(~unknown_type(df), F.concat(F.col("mapping_version"), F.lit(f"+{run_tag}")))
        df = df.withColumn("metadata.log_version", tag).withColumn("mapping_version", F.coalesce(tag, F.col("mapping_version")))
    df = ocsf.finalize(df)
    df = enrich(df) if enrich is not None else df
    df = ocsf.validate(df)
    strict = [d.name for d in defs if d.on_failure == "dead_letter"]
    invalid = F.col("source_type").isin(strict) & (F.size("errors") > 0)
    failed = F.when(F.col("parse_error").isNotNull(), "parse").when(F.col("mapping_error").isNotNull(), "map").when(invalid, "validate")
    detail = F.to_json(F.struct(
        F.col("source_type"), F.col("mapping_error.target").alias("target"), F.col("mapping_error.value").alias("value"),
        F.when(F.col("_failed") == "validate", F.col("errors")).alias("errors"), F.when(F.col("_failed") == "map", F.col("fields")).alias("parsed_fields"),
    ))
    # a filter on the outcome must not be pushed below: it would copy the whole mapping into the scan
    here = F.spark_partition_id() >= 0
    df = df.withColumn("_failed", F.when(here, failed)).withColumns({
        "status": F.when(F.col("_failed").isNotNull(), "dead").when(unknown_type(df), "template_only").otherwise("ok"),
        "reason": F.when(F.col("_failed") == "parse", F.col("parse_error")).when(F.col("_failed") == "map", F.col("mapping_error.reason"))
        .when(F.col("_failed") == "validate", "ocsf_validation_failed"),
        "stage": F.when(F.col("_failed") == "validate", "validate").when(F.col("_failed").isNotNull(), "normalize"),
        "detail": F.when(F.col("_failed").isNotNull(), detail),
        "parsed": F.coalesce(F.col("_failed") != "parse", F.lit(True)),
    })
    return df.drop("_failed", *(SCRATCH if not keep_fields else [c for c in SCRATCH if c not in ("fields", "text", "message")]))


def unknown_type(df: DataFrame):
    return F.col("source_type") == "unknown"


def accepted(outcomes: DataFrame) -> DataFrame:
    """Rows for the silver table (mapped and template-only records)."""
    return outcomes.filter(F.col("status") != "dead").drop("status", "reason", "stage", "detail", "parsed", "raw", "errors", "warnings")


def dead_letters(outcomes: DataFrame, now_ns: int | None = None) -> DataFrame:
    """Dead-letter rows; the raw bytes stay with every one of them."""
    ts = F.lit(now_ns).cast("bigint") if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return outcomes.filter(F.col("status") == "dead").select(
        "event_uid", "raw", "raw_hash", "reason", "stage", "detail", ts.alias("ts_ns")
    )
