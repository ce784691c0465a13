from pyspark.sql import functions as F

from lines import INGEST, NS, SAMPLES, raw_events
from rampart.catalog import bundled
from rampart.operators.drift import DriftConfig, template_drift_ewma, window_counts
from rampart.plans.reprocess import Lake
from rampart.schemas import RAW
from rampart.sources import tables as tb
from rampart.streaming import jobs


def files_stream(spark, df, path, schema):
    """A stream over Parquet files written so far, one file per trigger."""
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_lines_to_lake_resume_and_no_doubles(spark, tmp_path):
    inbox, lake = tmp_path / "in", Lake(str(tmp_path / "lake"))
    inbox.mkdir()
    (inbox / "a.log").write_text("\n".join([SAMPLES["iptables"], "", SAMPLES["zeek_conn"], "odd words"]) + "\n")
    start = lambda: jobs.run_stream(jobs.stream_lines_as_raw(spark, str(inbox)), lake, bundled(), str(tmp_path / "ck")).start()
    start().awaitTermination(120)
    (inbox / "b.log").write_text("2 123456789012 eni-0ab1 - - - - - - - 1777630830 1777630890 - NODATA\n" + SAMPLES["aws_vpc_flow"] + "\n")
    start().awaitTermination(120)
    start().awaitTermination(120)  # nothing new
    assert tb.read_bronze(spark, lake.bronze).count() == 5
    silver = tb.read_silver(spark, lake.silver)
    assert sorted(r["source_type"] for r in silver.collect()) == ["aws_vpc_flow", "iptables", "unknown", "zeek_conn"]
    assert tb.read_dead_letters(spark, lake.dead_letters).count() == 1
    raw = raw_events(spark, [SAMPLES["iptables"]])
    jobs.land_batch(raw, 7, lake, bundled())
    before = tb.read_silver(spark, lake.silver).count()
    jobs.land_batch(raw, 7, lake, bundled())  # a repeated batch replaces itself
    assert tb.read_silver(spark, lake.silver).count() == before == 5


def test_windows_dedup_and_seal(spark, tmp_path):
    raw = raw_events(spark, ["a", "b", "c"])
    stream = files_stream(spark, raw.unionByName(raw), str(tmp_path / "raw"), RAW)
    q = jobs.dedup_stream(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 3
    events = spark.createDataFrame([(f"e{i}", i * 60 * NS, "10.0.0.1", f"8.8.8.{i % 3}", 22, "tcp", 2, 1, 2) for i in range(10)] + [("z", 7200 * NS, "10.0.0.2", "1.1.1.1", 1, "udp", 1, 0, 0)],
                                   "event_uid string, time bigint, src_ip string, dst_ip string, dst_port bigint, protocol string, action_id bigint, bytes_in bigint, bytes_out bigint")
    s = files_stream(spark, events, str(tmp_path / "ev"), events.schema)
    q = jobs.stream_window_features(s, exact=True).writeStream.format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("win").orderBy("window_start").collect()
    assert [(r["window_start"], r["connection_count"], r["distinct_dst_ips"], r["deny_ratio"]) for r in rows] == [(0, 5, 3, 1.0), (300 * NS, 5, 3, 1.0)]
    lake = Lake(str(tmp_path / "lake"))
    q = jobs.stream_seal(spark.readStream.schema(RAW).parquet(str(tmp_path / "raw")), lake, str(tmp_path / "ck2"), batch_size=4).start()
    q.awaitTermination(60)
    assert spark.read.parquet(lake.ledger).agg(F.sum("leaf_count")).first()[0] == 6


def drift_signals(spark, folder, parts, watermark, cfg):
    """Signals of a stream that takes one part for each run; state is kept between runs."""
    schema = "source_id string, template_id string, time bigint"
    path, out = str(folder / "in"), str(folder / "out")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        signals = jobs.stream_template_drift(spark.readStream.schema(schema).parquet(path), cfg, watermark)
        writer = signals.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "ck"))
        writer.trigger(availableNow=True).start().awaitTermination(90)
    rows = spark.read.schema(signals.schema).parquet(out).orderBy("template_id", "window_index").collect()
    return [(r["template_id"], r["window_index"], r["observed"], r["direction"]) for r in rows]


def test_drift_state_carries_over_batches(spark, tmp_path):
    parts = [[("s", "t", ((first + w) * 300 + i) * NS) for w, n in enumerate(counts) for i in range(n)] for first, counts in ((0, [20, 20, 20]), (3, [20, 200, 20]))]
    assert drift_signals(spark, tmp_path, parts, "0 seconds", DriftConfig(window_minutes=5)) == [("t", 4, 200, "spike")]


def test_drift_by_event_time(spark, tmp_path):
    """Shuffled rows, a template that falls silent, one without a time and one late: as the batch finds it over the closed windows."""
    cfg = DriftConfig(window_minutes=5)
    shape = {"steady": [20] * 12, "silent": [30] * 5 + [0] * 7, "spiky": [10] * 6 + [150] + [10] * 5}
    rows = [("s", t, (w * 300 + i) * NS) for t, counts in shape.items() for w, n in enumerate(counts) for i in range(n)]
    halves = [sorted((r for r in rows if (r[2] // NS // 300 < 6) == early), key=lambda r: hash(r[2] * 31 + len(r[1])) % 1009) for early in (True, False)]
    swapped = [halves[0][:-40] + halves[1][:40], halves[0][-40:] + halves[1][40:] + [("s", "steady", None)]]
    got = drift_signals(spark, tmp_path, [*swapped, [("s", "spiky", 7 * NS), ("s", "steady", 13 * 3600 * NS)]], "1 hour", cfg)
    times = spark.createDataFrame(rows + [("s", "steady", 13 * 3600 * NS)], "source_id string, template_id string, time bigint")
    batch = template_drift_ewma(window_counts(times, 5), cfg, last_window=12 * 12 - 1).orderBy("template_id", "window_index").collect()
    assert got == [(r["template_id"], r["window_index"], r["observed"], r["direction"]) for r in batch]
    assert ("spiky", 6, 150, "spike") in got and ("silent", 5, 0, "drop") in got


def test_templates_are_carried_between_batches(spark, tmp_path):
    schema = "source_id string, line string, time bigint"
    lake, path = Lake(str(tmp_path / "lake")), str(tmp_path / "in")
    for part in range(2):
        rows = [("s", f"login of user {'abcdef'[i % 6]}x from 10.0.0.{i}", part * 100 + i) for i in range(12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        jobs.stream_templates(spark.readStream.schema(schema).parquet(path), lake, str(tmp_path / "ck")).start().awaitTermination(90)
    seen = spark.read.parquet(f"{lake.templates}/seen").collect()
    assert {r["template"] for r in seen} == {"login of user <*> from <IP>"} and sum(r["count"] for r in seen) == 24 and len({r["template_id"] for r in seen}) == 1
