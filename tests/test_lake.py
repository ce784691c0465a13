import json

import pytest
from pyspark.sql import functions as F

from lines import INGEST, NS, SAMPLES, raw_events
from rampart.catalog import bundled
from rampart.operators import lookups
from rampart.operators.crosswalk import to_warehouse_rows
from rampart.operators.flatten import to_silver
from rampart.plans.normalize import accepted, dead_letters, normalize
from rampart.plans.reprocess import Lake, replay_dead_letters, reprocess
from rampart.sources import tables as tb
from rampart.sources.fanout import Sink, write_all
from rampart.sources.iocs import read_iocs
from rampart.sources.lines import event_uid, read_log_lines, to_raw_events, uid_date
from rampart.sources.merging import compact, compact_all, partitions, reconcile_types, union_frames


def test_log_files_to_raw_events(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\r\n\n  \ntwo\ntwo\nbad \xff\n")
    exact = to_raw_events(read_log_lines(spark, str(tmp_path), byte_exact=True), ingest_time_ns=INGEST).collect()
    assert [bytes(r["raw"]) for r in exact] == [b"\xef\xbb\xbfone", b"two", b"two", b"bad \xff"]
    rows = to_raw_events(read_log_lines(spark, str(tmp_path)), ingest_time_ns=INGEST).collect()
    assert sorted(bytes(r["raw"]) for r in rows) == sorted([b"one", b"two", b"two", b"bad \xff"])
    assert len({r["event_uid"] for r in rows}) == 4 and {r["source_id"] for r in rows} == {"a.log"} and rows[0]["event_uid"][14] == "7"


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_bronze(spark, tmp_path, fmt):
    path = str(tmp_path / "bronze")
    assert tb.read_bronze(spark, path, fmt=fmt).count() == 0
    raw = raw_events(spark, [b"a" * 100, b"\x00\xff", "x"])
    tb.write_bronze(raw, path, fmt, run="r1")
    tb.write_bronze(raw, path, fmt, run="r1")  # the same run again replaces its own files
    tb.write_bronze(raw.withColumn("ingest_time_ns", F.col("ingest_time_ns") + 86_400 * NS), path, fmt, run="r2")
    back = tb.read_bronze(spark, path, fmt=fmt)
    assert back.count() == 6 and back.filter(F.sha2("raw", 256) != F.col("raw_hash")).count() == 0
    day = back.agg(F.min("date")).first()[0]
    assert tb.read_bronze(spark, path, day, fmt).count() == 3 and tb.bronze_by_uid(back, "u1").count() == 2
    located = tb.read_bronze_located(spark, path, day, fmt).collect()
    numbers = sorted(r["locator"].rsplit("#L", 1)[1] for r in located)
    assert all(r["locator"].startswith(f"date={day}/") for r in located) and len({r["locator"] for r in located}) == 3 and numbers[0] == "1"


def test_lookups_read_only_the_days_of_the_ids(spark, tmp_path):
    path = str(tmp_path / "bronze")
    raw = to_raw_events(spark.range(600).select(F.concat(F.lit("line "), F.col("id").cast("string")).cast("binary").alias("raw"), F.col("id").alias("row_id")), "s", ingest_time_ns=INGEST)
    days = raw.withColumn("ingest_time_ns", F.col("ingest_time_ns") + F.substring(F.decode("raw", "UTF-8"), 6, 9).cast("bigint") % 6 * 86_400 * NS)
    days = days.withColumn("event_uid", event_uid(F.col("ingest_time_ns"), F.col("raw_hash")))
    tb.write_bronze(days, path, run="a")
    table = tb.read_bronze(spark, path)
    dates = sorted(r[0] for r in table.select("date").distinct().collect())
    one = table.filter(F.col("date") == dates[3]).first()
    found = tb.bronze_by_uid(table, one["event_uid"])
    scan = next(line for line in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).splitlines() if "PartitionFilters" in line)
    limits = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert found.count() == 1 and [d in limits for d in dates] == [False, False, True, True, True, False] and f"EqualTo(event_uid,{one['event_uid'][:8]}" in scan
    assert table.filter(uid_date(F.col("event_uid")) != F.col("date")).count() == 0
    assert tb.uid_dates(table.filter(F.col("date") == dates[0])) == [dates[0]]
    assert tb.uid_dates(spark.createDataFrame([("u1",), (one["event_uid"],), (None,)], "event_uid string")) is None
    assert tb.bronze_on(table, []).count() == 0 and tb.bronze_on(table, None).count() == 600
    for name in found.inputFiles()[:1]:  # the id column has a Bloom filter
        jvm = spark._jvm.org.apache
        at = jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration())
        reader = jvm.parquet.hadoop.ParquetFileReader.open(at)
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        assert columns.get(0).getPath().toDotString() == "event_uid" and columns.get(0).getBloomFilterOffset() > 0 > columns.get(1).getBloomFilterOffset()
        reader.close()


def test_silver_and_dead_letters(spark, tmp_path):
    lake = Lake(str(tmp_path))
    assert tb.read_silver(spark, lake.silver).columns[:3] == ["event_uid", "raw_hash", "time"]
    out = normalize(raw_events(spark, [SAMPLES["zeek_conn"], SAMPLES["iptables"], "unknown words", "2 123456789012 eni-0ab1 - - - - - - - 1777630830 1777630890 - NODATA"]), bundled()).cache()
    tb.write_silver(to_silver(accepted(out)), lake.silver, run="a")
    tb.write_dead_letters(dead_letters(out, INGEST), lake.dead_letters, run="a")
    silver = tb.read_silver(spark, lake.silver)
    assert {(r["date"], r["source_type"]) for r in silver.collect()} == {("2026-05-01", "zeek_conn"), ("2026-05-01", "iptables"), ("2026-09-21", "unknown")}
    assert dict(silver.dtypes)["date"] == "string"
    dead = tb.read_dead_letters(spark, lake.dead_letters).first()
    assert dead["reason"] == "invalid_ip" and bytes(dead["raw"]).startswith(b"2 1234") and json.loads(dead["detail"])["source_type"] == "aws_vpc_flow"
    assert to_warehouse_rows(accepted(out)).filter("time is null or unmapped is null").count() == 0


def test_reprocess_and_replay(spark, tmp_path):
    lake = Lake(str(tmp_path))
    raw = raw_events(spark, [*SAMPLES.values(), "toy=1 m=view x=5"])
    tb.write_bronze(raw, lake.bronze, run="a")
    first = normalize(raw, bundled())
    tb.write_silver(to_silver(accepted(first)), lake.silver, run="a")
    report = reprocess(spark, lake, bundled(), "2026-09-21", dry_run=True, compare=True)
    assert (report["raw_events"], report["in_scope"], report["normalized"], report["written"]) == (12, 12, 12, 0)
    assert report["silver_dates"] == ["2026-05-01", "2026-09-21"] and report["compare"]["unchanged"] == 12
    scoped = reprocess(spark, lake, bundled(), "2026-09-21", source_type="iptables", compare=True)
    assert (scoped["in_scope"], scoped["written"], scoped["compare"]["unchanged"]) == (1, 1, 1)
    tags = tb.read_silver(spark, lake.silver).filter("source_type = 'iptables'").select("`metadata.log_version`").collect()
    assert sorted(t[0] or "" for t in tags) == ["", f"1.0.0+{scoped['mapping_version_tag']}"]
    # a letter that fails, then a definition that can read it
    line = "2 123456789012 eni-0ab1 - - - - - - - 1777630830 1777630890 - NODATA"
    bad = normalize(raw_events(spark, [line]).withColumn("event_uid", F.lit("late")), bundled())
    tb.write_dead_letters(dead_letters(bad, INGEST), lake.dead_letters, run="a")
    again = replay_dead_letters(spark, lake, bundled(), reason="invalid_ip")
    assert (again["candidates"], again["succeeded"], again["still_failing"]) == (1, 0, 1)
    other = [d for d in bundled() if d.name != "aws_vpc_flow"]
    fixed = replay_dead_letters(spark, lake, other)
    assert (fixed["candidates"], fixed["succeeded"], fixed["written"]) == (1, 1, 1)
    assert tb.read_resolutions(spark, lake.resolutions).first()["event_uid"] == "late"
    assert replay_dead_letters(spark, lake, other)["candidates"] == 0 and tb.read_dead_letters(spark, lake.dead_letters).count() == 2


def test_compaction_keeps_rows_and_reconciles_types(spark, tmp_path):
    path = str(tmp_path / "silver")
    base = spark.range(10).select(F.col("id").cast("string").alias("event_uid"), F.lit(1_777_630_830 * NS).alias("time"), F.lit("s").alias("source_type"), F.col("id").alias("mixed"))
    for i, df in enumerate([base, base.withColumn("mixed", F.concat(F.lit("t"), "mixed")), base.withColumn("extra", F.lit(1.5)), base]):
        tb.write_silver(df, path, run=f"r{i}")
    tb.write_silver(base.withColumn("source_type", F.lit("one")).coalesce(1), path, run="x")
    assert partitions(spark, path) == [("2026-05-01", "one"), ("2026-05-01", "s")]
    skipped, done = compact_all(spark, path)
    assert not skipped.compacted and skipped.rows == 10 and done.compacted and done.rows == 40 and done.files_after == 1 < done.files_before
    back = tb.read_silver(spark, path).filter("source_type = 's'")
    assert back.count() == 40 and back.filter(F.col("mixed").isin('"t3"', "3")).count() == 4 and back.filter("extra is not null").count() == 10
    assert compact(spark, path, "2026-05-01", "s").compacted is False


def test_union_promotes_numbers_and_stringifies_conflicts(spark):
    a = spark.createDataFrame([(1, 1, [1])], "n int, m int, l array<int>")
    b = spark.createDataFrame([(2.5, "x", "y")], "n double, m string, l string")
    rows = union_frames([a, b]).collect()
    assert [tuple(r) for r in rows] == [(1.0, "1", "[1]"), (2.5, '"x"', '"y"')]
    assert [f.dtypes for f in reconcile_types([a, a])][0] == a.dtypes


def test_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("u", "h", "s")], "event_uid string, raw_hash string, source_type string")
    seen, dead = [], []
    boom = lambda d: (_ for _ in ()).throw(RuntimeError("down"))
    out = write_all(df, [Sink("a", lambda d: seen.append(d.count()), True), Sink("b", boom)], lambda d: dead.extend(d.collect()))
    assert out["a"] == "ok" and "down" in out["b"] and seen == [1] and not dead
    write_all(df, [Sink("b", boom, True)], lambda d: dead.extend(d.collect()), now_ns=1)
    assert dead[0]["reason"] == "required_sink_failed" and json.loads(dead[0]["detail"])["failed_sinks"] == ["b"]


def test_indicator_files(spark, tmp_path):
    files = {"a.json": {"type": "ip", "source": "s", "confidence": "high", "indicators": [" 10.0.0.1 ", "2001:DB8::0001"]}, "b.json": {"type": "ip", "source": "s", "indicators": ["10.0.0.2", "nope"]},
             "c.json": {"type": "cidr", "source": "s", "indicators": ["10.1.2.3/16", "2001:db8::5/32", "1.2.3.4"]}, "d.json": {"type": "domain", "source": "s", "indicators": ["Bad.Example."]}, "e.json": {"type": "odd", "source": "s", "indicators": ["x"]}}
    for name, doc in files.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    rows = read_iocs(spark, str(tmp_path)).collect()
    assert sorted((r["ioc_type"], r["indicator"]) for r in rows) == [("cidr", "1.2.3.4/32"), ("cidr", "10.1.0.0/16"), ("cidr", "2001:db8::/32"), ("domain", "bad.example"), ("ip", "10.0.0.1"), ("ip", "2001:db8::1")]
    assert {r["confidence"] for r in rows} == {"high", "unknown"}


def test_range_lookups_agree_on_every_path(spark, monkeypatch):
    import ipaddress
    import random

    rng = random.Random(3)
    nets = {}
    for _ in range(120):
        n = rng.randint(8, 32)
        net = ipaddress.ip_network((rng.getrandbits(4) << 28 | rng.getrandbits(12) << 8, n), strict=False)
        nets[str(net)] = f"v{len(nets)}"
    nets["2001:db8::/32"], nets["2001:db8:1::/48"] = "six", "six-long"
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(4) << 28 | rng.getrandbits(12) << 8 | rng.getrandbits(3))) for _ in range(300)] + ["2001:db8:1::9", "2001:db8:2::9", "3::3", "bad", None]
    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        hits = [ipaddress.ip_network(n) for n in nets if a in ipaddress.ip_network(n)]
        return nets[str(max(hits, key=lambda n: n.prefixlen))] if hits else None
    table = spark.createDataFrame(list(nets.items()), "cidr string, name string")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i int, ip string")
    want = [best(x) for x in ips]
    for literals, probed in ((1000, 0), (0, 100), (0, 0)):
        monkeypatch.setattr(lookups, "LITERAL_RANGES", literals)
        monkeypatch.setattr(lookups, "PROBED_LENGTHS", probed)
        got = [r["name"] for r in lookups.cidr_lookup_join(df, "ip", table, ["name"]).orderBy("i").collect()]
        assert got == want, (literals, probed)


def test_domains_walk_up_to_but_not_into_the_top_level(spark):
    iocs = spark.createDataFrame([("example.com", "domain", "s", "c"), ("a.example.com", "domain", "s", "c"), ("com", "domain", "s", "c"), ("localhost", "domain", "s", "c")], "indicator string, ioc_type string, ioc_source string, confidence string")
    hosts = ["x.A.example.com.", "b.example.com", "example.com", "other.com", "com", "localhost", None]
    rows = lookups.ioc_domain_join(spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string"), "host", iocs).orderBy("i").collect()
    assert [r["hit"] and r["hit"]["indicator"] for r in rows] == ["a.example.com", "example.com", "example.com", None, "com", "localhost", None]


def test_pages_by_cursor_are_those_by_number(spark):
    from rampart.operators import lake

    rows = [(f"e{i:03d}", None if i % 7 == 0 else (i * 37) % 50) for i in range(100)]
    df = spark.createDataFrame(rows, "event_uid string, time bigint")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got, cursor = [], None
    while True:
        rows = lake.page_after(df, cursor, 17)
        cursor = lake.cursor_of(rows)
        if cursor is None:
            break
        got += [tuple(r) for r in rows.collect()]
    assert got == want
