"""Tables derived from the supplied ones: Spark frames and the matching SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rampart.functions.times import event_date
from rampart.session import configure, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


# One row per event: a flow between two addresses. Both texts follow the same rules.
_FLOW = {
    "event_uid": ("cast(event_id as string)", "cast(event_id as varchar)"),
    "time": ("us * 1000", "us * 1000"),
    "class_uid": ("cast(case when k % 4 = 3 then 4003 else 4001 end as bigint)",) * 2,
    "category_uid": ("cast(4 as bigint)",) * 2,
    "activity_id": ("cast(6 as bigint)",) * 2,
    "type_uid": ("cast(case when k % 4 = 3 then 400306 else 400106 end as bigint)",) * 2,
    "severity_id": ("cast(k % 7 as bigint)",) * 2,
    "source_type": ("concat('src_', event_type)", "'src_' || event_type"),
    "src_ip": ("concat('10.0.', user_id div 250 % 256, '.', user_id % 250 + 1)", "'10.0.' || (user_id // 250 % 256) || '.' || (user_id % 250 + 1)"),
    "src_port": ("cast(1024 + event_id * 7919 % 60000 as bigint)",) * 2,
    "dst_ip": ("case k % 5 when 0 then concat('203.0.113.', k) when 1 then concat('192.168.1.', k) when 2 then concat('8.8.4.', k) "
               "when 3 then concat('10.10.20.', k) else concat('2001:db8:aa::', k) end",
               "case k % 5 when 0 then '203.0.113.' || k when 1 then '192.168.1.' || k when 2 then '8.8.4.' || k "
               "when 3 then '10.10.20.' || k else '2001:db8:aa::' || k end"),
    "dst_port": ("cast(case k % 6 when 0 then 443 when 1 then 22 when 2 then 3389 when 3 then 53 when 4 then 49152 + k else 4444 end as bigint)",) * 2,
    "protocol": ("case k % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end",) * 2,
    "action_id": ("cast(case event_type when 'error' then 2 when 'signup' then 0 else 1 end as bigint)",) * 2,
    "bytes_in": ("cast(k * 10 as bigint)",) * 2,
    "bytes_out": ("case when k % 11 = 0 then null else cast(floor(value * 100) as bigint) end",) * 2,
    "unmapped_json": ("props",) * 2,
    "enrichments_json": ("cast(null as string)", "cast(null as varchar)"),
}
_COLUMNS = ["raw_hash", "date"]

EVENT_SQL = "e as (select *, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
FLOW_SQL = (
    f"with {EVENT_SQL}, flow as (select " + ", ".join(f'{sql} as "{name}"' for name, (_, sql) in _FLOW.items())
    + ", sha256(cast(event_id as varchar)) as raw_hash, strftime(make_timestamp(us), '%Y-%m-%d') as date from e)"
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with epoch microseconds ``us`` and the number ``k`` of its properties."""
    df = spread(table(spark, folder, "events"))
    return df.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("bigint")})


def flow(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder).selectExpr(*[f"{expr} as {name}" for name, (expr, _) in _FLOW.items()])
    return df.withColumns({"raw_hash": F.sha2("event_uid", 256), "date": event_date(F.col("time"))})


# The same flows with dotted OCSF columns, as the normalize plan makes them.
RECORD_SQL = FLOW_SQL


def record(spark: SparkSession, folder: str) -> DataFrame:
    df = flow(spark, folder)
    renamed = {"src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port",
               "protocol": "connection_info.protocol_name", "bytes_in": "traffic.bytes_in", "bytes_out": "traffic.bytes_out"}
    df = df.withColumnsRenamed(renamed)
    k = F.get_json_object("unmapped_json", "$.k").cast("bigint")
    return df.withColumns({
        "action": F.when(F.col("action_id") == 1, "Allowed").when(F.col("action_id") == 2, "Denied"),
        "metadata.uid": F.col("event_uid"), "metadata.version": F.lit("1.5.0"), "ingest_time_ns": F.col("time"),
        "metadata.product.vendor_name": F.lit("Acme"), "metadata.product.name": F.lit("Wall"),
        "unmapped": F.create_map(F.lit("nat_src_ip"), F.concat(F.lit("198.51.100."), k), F.lit("src_zone"), F.when(k % 2 == 0, "trust")),
        "mapping_version": F.lit("1"),
    })


# Larger flows for timing: one per order line.
BIG_SQL = (
    "with big as (select cast(l_orderkey as varchar) || '-' || l_linenumber || '-' || l_partkey as event_uid, epoch_us(l_shipdate) * 1000 + (l_partkey % 1440) * 60000000000 as \"time\", "
    "'10.1.' || (l_suppkey // 250 % 256) || '.' || (l_suppkey % 250 + 1) as src_ip, '198.51.' || (l_partkey // 250 % 256) || '.' || (l_partkey % 250 + 1) as dst_ip, "
    "l_partkey % 1000 as dst_port, case when l_returnflag = 'R' then 2 else 1 end as action_id, cast(floor(l_extendedprice) as bigint) as bytes_out, "
    "cast(floor(l_quantity) as bigint) as bytes_in, case when l_linestatus = 'O' then 'tcp' else 'udp' end as protocol, l_returnflag as source_type from lineitem)"
)


def flow_big(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("event_uid"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000 + (F.col("l_partkey") % 1440) * 60_000_000_000).alias("time"),
        F.expr("concat('10.1.', l_suppkey div 250 % 256, '.', l_suppkey % 250 + 1)").alias("src_ip"),
        F.expr("concat('198.51.', l_partkey div 250 % 256, '.', l_partkey % 250 + 1)").alias("dst_ip"),
        (F.col("l_partkey") % 1000).alias("dst_port"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("bigint").alias("action_id"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes_out"), F.floor("l_quantity").cast("bigint").alias("bytes_in"),
        F.when(F.col("l_linestatus") == "O", "tcp").otherwise("udp").alias("protocol"), F.col("l_returnflag").alias("source_type"),
    ).withColumn("date", event_date(F.col("time")))


# Reference tables, small and fixed, always met with the whole derived tables.
ZONES = [("10.0.0.0/8", "corp", "medium"), ("10.10.0.0/16", "servers", "high"), ("10.10.20.0/24", "vault", "critical"),
         ("192.168.1.0/24", "dmz", "high"), ("203.0.113.0/24", "edge", "medium"), ("2001:db8:aa::/48", "dmz6", "high")]
IOC_ROWS = [("10.10.20.33", "ip", "feed_a", "high"), ("8.8.4.42", "ip", "feed_a", "high"), ("203.0.113.0/26", "cidr", "feed_b", "low"),
            ("203.0.113.16/28", "cidr", "feed_b", "medium"), ("2001:db8:aa::/64", "cidr", "feed_c", "low"),
            ("casino-win.example.com", "domain", "feed_d", "high"), ("example.net", "domain", "feed_d", "low"),
            ("ththth.example.net", "domain", "feed_d", "medium")]


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "cidr string, zone string, criticality string")


def iocs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IOC_ROWS, "indicator string, ioc_type string, ioc_source string, confidence string")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {body})"


# Dead letters, resolutions and scorings derived from the events.
DEAD_SQL = (
    f"with {EVENT_SQL}, dead as (select cast(event_id as varchar) as event_uid, case k % 4 when 0 then 'grok_no_match' when 1 then 'invalid_ip' when 2 then "
    "'required_unresolved' else 'ocsf_validation_failed' end as reason, case when k % 4 = 3 then 'validate' else 'normalize' end as stage, "
    "case when k % 10 = 9 then null else 'src_' || event_type end as source, us * 1000 as ts_ns, 'line ' || repeat(event_type || ' ', cast(k as bigint)) as raw_text from e), "
    "res as (select cast(event_id as varchar) as event_uid from e where k % 3 = 0)"
)


def dead(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    source = F.when(F.col("k") % 10 != 9, F.concat(F.lit("src_"), "event_type"))
    text = F.concat(F.lit("line "), F.expr("repeat(concat(event_type, ' '), cast(k as int))"))
    return df.select(
        F.col("event_id").cast("string").alias("event_uid"), F.encode(text, "UTF-8").alias("raw"), F.sha2(text, 256).alias("raw_hash"),
        F.expr("case k % 4 when 0 then 'grok_no_match' when 1 then 'invalid_ip' when 2 then 'required_unresolved' else 'ocsf_validation_failed' end").alias("reason"),
        F.when(F.col("k") % 4 == 3, "validate").otherwise("normalize").alias("stage"),
        F.to_json(F.struct(source.alias("source_type"))).alias("detail"), (F.col("us") * 1000).alias("ts_ns"),
    )


def resolutions(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder).filter("k % 3 = 0")
    return df.select(F.col("event_id").cast("string").alias("event_uid"), (F.col("us") * 1000).alias("resolved_ts_ns"), F.lit("{}").alias("detail"))


SCORE_SQL = (
    f"with {EVENT_SQL}, scores as (select cast(event_id % 5000 as varchar) as event_uid, '10.0.0.' || (user_id % 250 + 1) as src_ip, "
    "epoch_us(timestamp '2024-01-01') * 1000 + (event_id % 5000) * 60000000000 as event_time_ns, value / 100 as anomaly_score, value > 100 as is_anomaly, us * 1000 as scored_at_ns from e), "
    "latest as (select * from scores qualify row_number() over (partition by event_uid order by scored_at_ns desc, anomaly_score desc) = 1)"
)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    return df.select(
        (F.col("event_id") % 5000).cast("string").alias("event_uid"), F.expr("concat('10.0.0.', user_id % 250 + 1)").alias("src_ip"),
        (F.lit(1_704_067_200_000_000_000) + (F.col("event_id") % 5000) * 60_000_000_000).alias("event_time_ns"),
        (F.col("value") / 100).alias("anomaly_score"), (F.col("value") > 100).alias("is_anomaly"), (F.col("us") * 1000).alias("scored_at_ns"),
    )


# Raw events over the document texts.
def bronze(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents")
    raw = F.encode("text", "UTF-8")
    return df.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("event_uid"), raw.alias("raw"), F.sha2(raw, 256).alias("raw_hash"),
        F.octet_length(raw).alias("raw_len"), (F.lit(1_704_067_200_000_000_000) + F.col("doc_id") * 1_000_000).alias("ingest_time_ns"),
        F.col("source").alias("source_id"), F.lit("file").alias("transport"), F.lit(None).cast("string").alias("peer"),
    )
