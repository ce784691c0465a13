"""Raw events on a durable topic, keyed by source (needs the Kafka connector on the classpath)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rampart.schemas import RAW


def encode_raw_events(df: DataFrame) -> DataFrame:
    """``key`` = source id, ``value`` = JSON with base64 bytes."""
    raw = F.regexp_replace(F.base64("raw"), "[\r\n]", "")
    fields = [F.col(c.split()[0]) for c in RAW.split(", ")]
    out = df.withColumn("raw", raw)
    return out.select(F.col("source_id").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def decode_raw_events(df: DataFrame) -> DataFrame:
    """Raw events from the JSON of ``value``; ``unreadable_messages`` gives the rest."""
    return _parsed(df).filter(F.col("e.event_uid").isNotNull()).select("e.*").withColumn("raw", F.unbase64("raw"))


def unreadable_messages(df: DataFrame, now_ns: int | None = None) -> DataFrame:
    """Dead-letter rows of the messages without a readable event; their bytes stay."""
    value = F.col("value").cast("binary")
    ts = F.lit(now_ns).cast("bigint") if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return _parsed(df).filter(F.col("e.event_uid").isNull()).select(
        F.sha2(value, 256).alias("event_uid"), value.alias("raw"), F.sha2(value, 256).alias("raw_hash"), F.lit("unreadable_message").alias("reason"),
        F.lit("ingest").alias("stage"), F.to_json(F.struct(F.col("key").cast("string").alias("key"))).alias("detail"), ts.alias("ts_ns"))


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("e", F.from_json(F.col("value").cast("string"), RAW.replace("raw binary", "raw string")))


def kafka_options(servers: str, topic: str, **extra: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, **{k.replace("_", "."): v for k, v in extra.items()}, "topic": topic}


def stream_raw_events_kafka(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest", **options: str) -> DataFrame:
    """At-least-once stream of raw events from the start of the topic; offsets live in the query checkpoint. Unreadable
    messages are left to ``unreadable_messages``."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return decode_raw_events(reader.option("startingOffsets", starting_offsets).options(**options).load())


def write_raw_events_kafka(df: DataFrame, servers: str, topic: str, **options: str) -> None:
    encode_raw_events(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()
