"""Tables, files and streams written in the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from rampart.catalog import bundled
from rampart.definitions import Definition
from rampart.functions.times import NS
from rampart.operators import integrity as I
from rampart.operators.drift import SIGNAL_SCHEMA, DriftConfig
from rampart.operators.flatten import to_silver
from rampart.plans.normalize import accepted, dead_letters, normalize
from rampart.plans.reprocess import Lake, replay_dead_letters, reprocess
from rampart.registry import query, views as V
from rampart.registry.queries_jobs import BRONZE_SQL, E, T0, drift_sql, templated
from rampart.registry.queries_parse import NORMAL_SQL, raw_lines
from rampart.registry.views import FLOW_SQL
from rampart.schemas import RAW
from rampart.session import scratch_folder
from rampart.sources import tables as tb
from rampart.sources.lines import event_uid, read_log_lines
from rampart.sources.merging import compact_all
from rampart.streaming import jobs

_DAY = "strftime(make_timestamp(1704067200000000 + doc_id * 1000), '%Y-%m-%d')"


def _flow_defs() -> list[Definition]:
    return [x for x in bundled() if x.name == "aws_vpc_flow"]


def _lake(spark: SparkSession, name: str) -> Lake:
    return Lake(scratch_folder(spark, name))


# -- files of lines ------------------------------------------------------------------------


@query("read_log_lines", f"{E} select chr(65279) || 'event ' || event_id || ' ' || event_type || case when k % 3 = 0 then chr(13) else '' end as line, md5(chr(65279) || 'event ' || event_id || ' ' || event_type || case when k % 3 = 0 then chr(13) else '' end) as digest from e")
def _(spark, d):
    """Every line begins with a byte-order mark, so the first line of each file shows whether its bytes were kept."""
    path = scratch_folder(spark, "lines")
    text = F.concat(F.lit("\ufeffevent "), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.when(F.col("k") % 3 == 0, "\r\r").otherwise(""))
    V.events(spark, d).select(text).write.text(path)
    return read_log_lines(spark, path, byte_exact=True).select(F.col("raw").cast("string").alias("line"), F.md5("raw").alias("digest"))


# -- bronze ----------------------------------------------------------------------------------


@query("bronze_table", f"{BRONZE_SQL} select event_uid, raw_hash, {_DAY} as date, true as whole from b")
def _(spark, d):
    path = _lake(spark, "bronze").bronze
    for _ in range(2):  # the same run again replaces its own files
        tb.write_bronze(V.bronze(spark, d), path, run="first")
    return tb.read_bronze(spark, path).select("event_uid", "raw_hash", "date", (F.sha2("raw", 256) == F.col("raw_hash")).alias("whole"))


@query("bronze_of_a_day", f"{BRONZE_SQL} select event_uid, raw_hash from b where {_DAY} = '2024-01-01'")
def _(spark, d):
    path = _lake(spark, "bronze").bronze
    tb.write_bronze(V.bronze(spark, d), path, "json", run="first")
    return tb.read_bronze(spark, path, "2024-01-01", "json").select("event_uid", "raw_hash")


@query("bronze_located", f"{BRONZE_SQL}, n as (select {_DAY} as date, count(*) as events from b group by 1) select date, events, events as places, true as dense from n")
def _(spark, d):
    """Locators are file and line: no two events share one, and the lines of a file are numbered without gaps."""
    path = _lake(spark, "bronze").bronze
    tb.write_bronze(V.bronze(spark, d), path, "json", run="first")
    file, line = F.substring_index("locator", "#L", 1), F.substring_index("locator", "#L", -1).cast("bigint")
    files = tb.read_bronze_located(spark, path).groupBy("date", file.alias("file")).agg(F.count("*").alias("n"), F.countDistinct("locator").alias("places"), F.max(line).alias("last"))
    return files.groupBy("date").agg(F.sum("n").alias("events"), F.sum("places").alias("places"), F.bool_and(F.col("last") == F.col("n")).alias("dense"))


@query("bronze_by_uid", f"{BRONZE_SQL} select event_uid, raw_hash from b where doc_id = (select max(doc_id) from documents)")
def _(spark, d):
    path = _lake(spark, "bronze").bronze
    raw = V.bronze(spark, d)
    tb.write_bronze(raw, path, run="first")
    return tb.bronze_by_uid(tb.read_bronze(spark, path), raw.agg(F.max("event_uid")).first()[0]).select("event_uid", "raw_hash")


def _minted(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines of some thirty days with ids in the library's own layout, and the ``number`` of each."""
    raw = raw_lines(spark, d).withColumnRenamed("event_uid", "number")
    return raw.withColumn("event_uid", event_uid(F.col("ingest_time_ns"), F.col("number")))


@query("bronze_by_minted_uid", f"{E} select event_id from e where event_id = (select max(event_id) from events)")
def _(spark, d):
    """The id names its day, so three partitions are read at most."""
    path = _lake(spark, "minted").bronze
    raw = _minted(spark, d)
    tb.write_bronze(raw.drop("number"), path, run="first")
    last = raw.agg(F.max_by("event_uid", F.col("number").cast("bigint"))).first()[0]
    found = tb.bronze_by_uid(tb.read_bronze(spark, path), last or "").select("event_uid")
    return found.join(raw.select("event_uid", "number"), "event_uid").select(F.col("number").cast("bigint").alias("event_id"))


@query("reprocess_day", f"{NORMAL_SQL}, day as (select n.status from n join e using (event_id) where strftime(make_timestamp(e.us + 5000000), '%Y-%m-%d') = '2024-01-02') select count(*) as in_scope, count(*) filter (status <> 'dead') as normalized, count(*) filter (status = 'dead') as dead_lettered, count(*) filter (status <> 'dead') as unchanged from day")
def _(spark, d):
    """One ingest date again by the same definition: every event has its previous row, and no row differs."""
    lake, defs, raw = _lake(spark, "again"), _flow_defs(), _minted(spark, d).drop("number")
    tb.write_bronze(raw, lake.bronze, run="first")
    tb.write_silver(to_silver(accepted(normalize(raw, defs))), lake.silver, run="first")
    report = reprocess(spark, lake, defs, "2024-01-02", compare=True)
    counts = [report["in_scope"], report["normalized"], report["dead_lettered"], report["compare"]["unchanged"]]
    return spark.createDataFrame([tuple(counts)], "in_scope bigint, normalized bigint, dead_lettered bigint, unchanged bigint")


@query("replay_dead_letters", f"{NORMAL_SQL} select event_id, 'unknown' as source_type, 'invalid_ip' as reason from n where status = 'dead'")
def _(spark, d):
    """Letters of one definition replayed without it, from bronze; a second replay finds none unresolved."""
    lake, raw = _lake(spark, "replayed"), _minted(spark, d)
    tb.write_bronze(raw.drop("number"), lake.bronze, run="first")
    tb.write_dead_letters(dead_letters(normalize(raw.drop("number"), _flow_defs()), T0 + 40 * 86_400 * NS), lake.dead_letters, run="first")
    others = [x for x in bundled() if x.name == "iptables"]
    for _ in range(2):
        replay_dead_letters(spark, lake, others)
    reasons = tb.read_resolutions(spark, lake.resolutions).select("event_uid", F.get_json_object("detail", "$.original_reason").alias("reason"))
    silver = tb.read_silver(spark, lake.silver).select("event_uid", "source_type")
    return silver.join(reasons, "event_uid").join(raw.select("event_uid", F.col("number").cast("bigint").alias("event_id")), "event_uid").drop("event_uid")


# -- silver -------------------------------------------------------------------------------------


def _written_silver(spark: SparkSession, d: str, lake: Lake) -> DataFrame:
    """Three writers whose ``extra`` is a whole number, a text, and missing."""
    flow = V.flow(spark, d).drop("date")
    third = F.col("event_uid").cast("bigint") % 3
    tb.write_silver(flow.filter(third == 0).withColumn("extra", F.col("severity_id").cast("int")), lake.silver, run="a")
    tb.write_silver(flow.filter(third == 1).withColumn("extra", F.col("protocol")), lake.silver, run="b")
    tb.write_silver(flow.filter(third == 2), lake.silver, run="c")
    return flow


_EXTRA = "case cast(event_uid as bigint) % 3 when 0 then cast(severity_id as varchar) when 1 then '\"' || protocol || '\"' end as extra"


@query("silver_table", f'{FLOW_SQL} select event_uid, "time", source_type, date, bytes_out, {_EXTRA} from flow')
def _(spark, d):
    lake = _lake(spark, "silver")
    _written_silver(spark, d, lake)
    return tb.read_silver(spark, lake.silver).select("event_uid", "time", "source_type", "date", "bytes_out", "extra")


@query("silver_compacted", f'{FLOW_SQL} select event_uid, "time", source_type, date, bytes_out, {_EXTRA} from flow')
def _(spark, d):
    lake = _lake(spark, "silver")
    _written_silver(spark, d, lake)
    compact_all(spark, lake.silver)
    return tb.read_silver(spark, lake.silver).select("event_uid", "time", "source_type", "date", "bytes_out", "extra")


# -- dead letters, resolutions, anomalies -----------------------------------------------------------


@query("dead_letter_table", f"{NORMAL_SQL} select event_uid, 'invalid_ip' as reason, 'normalize' as stage, '2024-01-02' as date from n where status = 'dead'")
def _(spark, d):
    lake = _lake(spark, "dead")
    tb.write_dead_letters(dead_letters(normalize(raw_lines(spark, d), _flow_defs()), 1_704_153_600 * NS), lake.dead_letters, run="a")
    return tb.read_dead_letters(spark, lake.dead_letters).select("event_uid", "reason", "stage", "date")


@query("resolution_table", f"{E} select cast(event_id as varchar) as event_uid, us * 1000 as resolved_ts_ns, 'k' || k as detail from e")
def _(spark, d):
    path = _lake(spark, "resolved").resolutions
    tb.write_resolutions(V.events(spark, d).select(F.col("event_id").cast("string").alias("event_uid"), (F.col("us") * 1000).alias("resolved_ts_ns"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("detail")), path, run="a")
    return tb.read_resolutions(spark, path).select("event_uid", "resolved_ts_ns", "detail")


@query("anomaly_table", f'{FLOW_SQL} select event_uid, src_ip, "time" as event_time_ns, date, severity_id / 8 as anomaly_score from flow')
def _(spark, d):
    path = _lake(spark, "anomalies").anomalies
    scored = V.flow(spark, d).select(
        "event_uid", "src_ip", F.col("time").alias("event_time_ns"), "source_type", (F.col("severity_id") / 8).alias("anomaly_score"), (F.col("severity_id") > 5).alias("is_anomaly"),
        F.col("time").alias("scored_at_ns"), F.lit("2024").alias("model_trained_at"), F.lit(None).cast("string").alias("explanation_json"))
    tb.write_anomalies(scored, path, run="a")
    return tb.read_anomalies(spark, path).select("event_uid", "src_ip", "event_time_ns", "date", "anomaly_score")


# -- streams --------------------------------------------------------------------------------------------


def _in_two(df: DataFrame, path: str, half, writer: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Write the two halves of ``df`` under ``path``, in as many files as there are tasks, and run the stream to its end after
    each: a half is one micro-batch, and the second goes on from the checkpoint of the first."""
    for part in (half, ~half):
        df.filter(part).write.mode("append").parquet(path)
        writer(df.sparkSession.readStream.schema(df.schema).parquet(path)).start().awaitTermination()


def _appended(out: DataFrame, path: str) -> DataStreamWriter:
    """``out`` appended to Parquet files in ``path``/out."""
    to = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    return to.trigger(availableNow=True)


@query("stream_to_lake", f"""{NORMAL_SQL} select event_uid, case when source_type = 'aws_vpc_flow' then source_type else 'unknown' end as source_type from n where status <> 'dead'""")
def _(spark, d):
    """Raw events in two micro-batches, the second of which is repeated, by one of the definitions."""
    lake, defs = _lake(spark, "landed"), _flow_defs()
    raw = raw_lines(spark, d)
    _in_two(raw, f"{lake.root}/in", F.crc32("event_uid") % 2 == 0, lambda stream: jobs.run_stream(stream, lake, defs, f"{lake.root}/checkpoint"))
    jobs.land_batch(raw.limit(0), 1, lake, defs)  # as after a failure: the events are those in bronze
    return tb.read_silver(spark, lake.silver).select("event_uid", "source_type")


@query("stream_dedup", f"{BRONZE_SQL} select event_uid, raw_hash from b")
def _(spark, d):
    """Every event is delivered twice."""
    path = scratch_folder(spark, "dedup")
    twice = V.bronze(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = lambda stream: _appended(jobs.dedup_stream(stream.drop("copy"), "3000 days").select("event_uid", "raw_hash"), path)
    _in_two(twice, f"{path}/in", F.col("copy") == 0, once)
    return spark.read.schema("event_uid string, raw_hash string").parquet(f"{path}/out")


@query("stream_seal", f"{BRONZE_SQL}, n as (select ledger, count(*) filter (crc % 2 = 0) as first_half, count(*) filter (crc % 2 = 1) as second_half from (select ledger, doc_id % 2 as crc from b) group by 1) select ledger, ceil(first_half / 16)::bigint + ceil(second_half / 16)::bigint as entries, true as chain_ok, case when first_half > 0 and second_half > 0 then false else true end as chain_ok_without_first from n")
def _(spark, d):
    """One chain over two micro-batches, the second of which is repeated; without the entries of the first the chain does not hold."""
    lake = _lake(spark, "sealed")
    raw = V.bronze(spark, d)
    half = F.col("event_uid").cast("bigint") % 2 == 0
    _in_two(raw, f"{lake.root}/in", half, lambda stream: jobs.stream_seal(stream, lake, f"{lake.root}/checkpoint", 16))
    jobs.seal_batch(raw.filter(~half), 1, lake, 16)
    ledger = spark.read.parquet(lake.ledger)
    cut = I.verify_chain(ledger.filter("batch = 1")).select("ledger", F.col("chain_ok").alias("chain_ok_without_first"))
    return I.verify_chain(ledger.drop("batch")).join(cut, "ledger", "left").select("ledger", "entries", "chain_ok", F.coalesce("chain_ok_without_first", F.lit(True)).alias("chain_ok_without_first"))


_KINDS = ("opened by user <*> from <IP>", "usage of disk <*> at <NUM> percent", "closed")


@query("stream_templates", f"""{E}, m as (select 'dev' || (user_id % 3) as source_id, case event_id % 3 when 0 then '{_KINDS[0]}' when 1 then '{_KINDS[1]}' else '{_KINDS[2]}' end as template, us from e)
 select source_id, template, count(*) as "count", min(us) * 1000 as first_seen_ns, max(us) * 1000 as last_seen_ns, count(distinct source_id || template) as ids from m group by 1, 2""")
def _(spark, d):
    """Two micro-batches; a template keeps its id when the second one widens it."""
    lake = _lake(spark, "templates")
    k = F.col("k").cast("string")
    word = F.element_at(F.array(*[F.lit(w) for w in ("ann", "bob", "cy", "dee")]), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("opened by user "), word, F.lit(" from 10.0.0."), k)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("usage of disk "), word, F.lit(" at "), k, F.lit(" percent"))).otherwise("closed")
    lines = V.events(spark, d).select(F.concat(F.lit("dev"), (F.col("user_id") % 3).cast("string")).alias("source_id"), line.alias("line"), (F.col("us") * 1000).alias("time"))
    _in_two(lines, f"{lake.root}/in", F.col("time") / 1000 % 2 == 0, lambda stream: jobs.stream_templates(stream, lake, f"{lake.root}/checkpoint"))
    found = jobs.seen_templates(spark, lake)
    return found.groupBy("source_id", "template").agg(F.sum("count").alias("count"), F.min("first_seen_ns").alias("first_seen_ns"), F.max("last_seen_ns").alias("last_seen_ns"), F.countDistinct("template_id").alias("ids"))


@query("stream_windows", f"""{FLOW_SQL}, w as (select src_ip, "time" // {3600 * NS} * {3600 * NS} as window_start, * exclude (src_ip) from flow), closed as (select * from w where window_start + {3600 * NS} <= (select max("time") from flow))
 select src_ip, window_start, count(*) as connection_count, count(distinct dst_ip) as distinct_dst_ips, count(distinct dst_port) as distinct_dst_ports, sum(greatest(coalesce(bytes_out, 0), 0))::bigint as total_bytes_out from closed group by all""")
def _(spark, d):
    """Windows that the watermark has closed, with exact distinct counts."""
    path = scratch_folder(spark, "windows")
    flow = V.flow(spark, d)
    flow.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(flow.schema).parquet(f"{path}/in")
    _appended(jobs.stream_window_features(stream, "1 hour", "0 seconds", exact=True), path).start().awaitTermination()
    kept = spark.read.parquet(f"{path}/out")
    return kept.select("src_ip", "window_start", "connection_count", F.col("distinct_dst_ips").cast("bigint"), F.col("distinct_dst_ports").cast("bigint"), F.col("total_bytes_out").cast("bigint"))


@query("stream_template_drift", drift_sql("(max(us) // 1000 - 3 * 86400000) // 43200000 - 1", "e"))
def _(spark, d):
    """Two micro-batches whose times overlap by up to two days, with a watermark of three: the signals of all windows it has closed."""
    path = scratch_folder(spark, "drift")
    mined = templated(spark, d).select("source_id", "template_id", "time")
    ends = mined.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    if ends["low"] is None:
        return spark.createDataFrame([], "source_id string, template_id string, window_index bigint, observed bigint, z_score double, direction string")
    about = F.col("time") + (F.crc32(F.col("time").cast("string")) % 172_800 - 86_400) * NS
    signals = lambda stream: jobs.stream_template_drift(stream, DriftConfig(z_threshold=2.0, window_minutes=720.0), "3 days")
    _in_two(mined, f"{path}/in", about < (ends["low"] + ends["high"]) // 2, lambda stream: _appended(signals(stream), path))
    return spark.read.schema(SIGNAL_SCHEMA).parquet(f"{path}/out").select("source_id", "template_id", "window_index", "observed", "z_score", "direction")
