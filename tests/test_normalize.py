import json

import pytest
from pyspark.sql import functions as F

from lines import SAMPLES, raw_events
from rampart.catalog import bundled
from rampart.operators.crosswalk import to_cim, to_ecs
from rampart.operators.enrich import AttackRule, enrichment_chain, run_enrichers, tag_attack
from rampart.operators.flatten import to_silver, unflatten
from rampart.plans.normalize import accepted, dead_letters, normalize
from rampart.plans.reprocess import check_sources, pipeline_metrics


@pytest.fixture(scope="module")
def outcomes(spark):
    extra = ["2 123456789012 eni-0ab1 - - - - - - - 1777630830 1777630890 - NODATA", "some unknown words", b"\xef\xbb\xbf" + SAMPLES["zeek_conn"].encode(), b"bad \xff bytes",
             "<4>Jan  2 03:04:05 gw app: who knows", "CEF:0|v|p|1|2|n|3|src=10.0.0.9 cs1=a cs1Label=k", SAMPLES["zeek_conn"].replace('"proto":"tcp"', '"proto":'), SAMPLES["fortigate_traffic"].replace("dstport=443", "dstport=70000")]
    names = [*SAMPLES, "nodata", "words", "bom", "bytes", "syslog", "cef", "broken", "port"]
    df = normalize(raw_events(spark, [*SAMPLES.values(), *extra]), bundled()).cache()
    rows = {names[int(r["event_uid"][1:])]: r.asDict() for r in df.collect()}
    return df, rows


def test_every_source_claims_its_own_line(outcomes):
    for name in SAMPLES:
        r = outcomes[1][name]
        assert (r["source_type"], r["status"], r["errors"]) == (name, "ok", []), name
        assert r["completeness"] > 0.6 and r["metadata.uid"] and r["metadata.log_hash"]
    seconds = {name: outcomes[1][name]["time"] // 10**9 for name in SAMPLES}
    assert set(seconds.values()) == {1777630830}


def test_mapped_values(outcomes):
    rows = outcomes[1]
    f = rows["fortigate_traffic"]
    assert (f["action"], f["action_id"], f["activity_name"], f["disposition"], f["severity"], f["type_uid"], f["firewall_rule.uid"]) == ("Denied", 2, "Traffic", "Blocked", "Medium", 400106, "4")
    left = json.loads(f["unmapped_json"])
    assert left["service"] == "HTTPS" and left["envelope.pri"] == 189 and "srcip" not in left
    assert (rows["panos_traffic_v11"]["disposition"], rows["panos_traffic_v11"]["app_name"], rows["panos_traffic_v10"]["traffic.packets_in"]) == ("Dropped", "ssl", 2)
    assert json.loads(rows["panos_traffic_v10"]["unmapped_json"]) == {"nat_src_ip": "203.0.113.1", "nat_dst_ip": "198.51.100.8", "nat_src_port": "4001", "nat_dst_port": "443", "src_zone": "in", "dst_zone": "out"}
    a = rows["suricata_eve_alert"]
    assert (a["finding_info.uid"], a["severity_id"], a["class_name"], json.loads(a["unmapped_json"])["alert.metadata.tag.1"]) == ("2001", 4, "Detection Finding", "b")
    z = rows["zeek_conn"]
    assert (z["dst_endpoint.ip"], z["activity_id"], json.loads(z["unmapped_json"])) == ("2001:db8::8", 4, {"local_orig": True, "tunnel_parents": []})
    assert (rows["zeek_dns"]["rcode"], rows["zeek_dns"]["query.class"], rows["zeek_http"]["activity_id"], rows["zeek_http"]["http_response.code"]) == ("NXDomain", "IN", 6, 404)
    assert (rows["iptables"]["disposition"], rows["iptables"]["connection_info.protocol_num"], rows["cisco_asa"]["activity_name"], rows["cisco_asa"]["traffic.bytes"]) == ("Dropped", 6, "Close", 42)


def test_failures_and_leftovers(outcomes):
    rows = outcomes[1]
    assert (rows["nodata"]["status"], rows["nodata"]["reason"], rows["nodata"]["stage"]) == ("dead", "invalid_ip", "normalize")
    assert json.loads(rows["nodata"]["detail"])["target"] == "src_endpoint.ip"
    assert (rows["broken"]["status"], rows["broken"]["reason"]) == ("dead", "invalid_json")
    assert (rows["port"]["status"], rows["port"]["reason"], rows["port"]["stage"]) == ("dead", "ocsf_validation_failed", "validate")
    assert rows["bom"]["status"] == "ok" and rows["bom"]["raw"].startswith(b"\xef\xbb\xbf")
    assert {rows[n]["status"] for n in ("words", "bytes", "syslog", "cef")} == {"template_only"}
    assert json.loads(rows["cef"]["unmapped_json"])["k"] == "a"
    assert rows["syslog"]["time"] // 10**9 == 1767323045  # 2026-01-02, resolved against the ingest time


def test_split_keeps_every_row(outcomes):
    df = outcomes[0]
    good, dead = accepted(df), dead_letters(df, now_ns=5)
    assert good.count() + dead.count() == df.count() and dead.filter(F.col("raw").isNull()).count() == 0
    silver = to_silver(good)
    assert silver.columns[:3] == ["event_uid", "raw_hash", "time"] and "src_endpoint.ip" in silver.columns
    back = unflatten(silver.filter("source_type = 'zeek_http'")).select("record.*").first()
    assert back["http_request"]["url"]["hostname"] == "www.example" and back["finding_info"] is None
    metrics = {(r["metric"], r["label"]): r["value"] for r in pipeline_metrics(df).collect()}
    assert metrics[("events_received", "file")] == 19 and metrics[("dead_letters", "normalize/invalid_ip")] == 1 and metrics[("completeness_le", "1.0")] == 17


def test_source_check(spark):
    df = spark.createDataFrame(list(SAMPLES.items()) , "name string, raw string")
    rows = check_sources(df, bundled()).collect()
    assert len(rows) == 11 and all(r["ok"] for r in rows), [r for r in rows if not r["ok"]]


def test_enrichment_and_crosswalk(spark, outcomes):
    zones = spark.createDataFrame([("192.0.2.0/24", "lan", "high"), ("0.0.0.0/0", "any", None)], "cidr string, zone string, criticality string")
    iocs = spark.createDataFrame([("198.51.100.8", "ip", "f", "high"), ("bad.example", "domain", "f", "low")], "indicator string, ioc_type string, ioc_source string, confidence string")
    geo = spark.createDataFrame([("8.8.0.0/16", "US", "United States", "X", 1.0, 2.0)], "cidr string, country_code string, country_name string, city string, latitude double, longitude double")
    good = accepted(outcomes[0]).cache()
    out = enrichment_chain(zones=zones, geo=geo, iocs=iocs)(good)
    rows = {r["source_type"]: r for r in out.collect()}
    assert rows["fortigate_traffic"]["network_context"]["src_zone"] == "lan" and rows["fortigate_traffic"]["network_context"]["direction"] == "transit"
    assert rows["fortigate_traffic"]["threat_intel"]["matched_on"] == "dst_endpoint.ip" and rows["iptables"]["threat_intel"]["matched_on"] == "src_endpoint.ip"
    assert rows["suricata_eve_alert"]["attack"]["technique_ids"] == ["T1046"] and rows["iptables"]["attack"]["tactics"] == ["credential-access"]
    assert json.loads(rows["iptables"]["enrichments_json"])["attack"]["technique_names"] == ["Brute Force"]
    ecs = {r["source_type"]: r["ecs"] for r in to_ecs(good).collect()}
    assert ecs["panos_traffic_v10"]["source"]["nat"]["port"] == 4001 and ecs["panos_traffic_v10"]["related"]["ip"] == ["192.0.2.5", "198.51.100.8", "203.0.113.1"]
    assert ecs["suricata_eve_alert"]["event"]["kind"] == "alert" and ecs["zeek_conn"]["@timestamp"] == "2026-05-01T10:20:30.250000Z"
    cim = {r["source_type"]: r["cim"] for r in to_cim(good).collect()}
    assert (cim["fortigate_traffic"]["action"], cim["fortigate_traffic"]["bytes"], cim["suricata_eve_alert"]["signature"], cim["zeek_dns"]["tags"]) == ("blocked", 30, "ET SCAN probe", [])


def test_rules_and_failing_enrichers(spark, outcomes):
    good = accepted(outcomes[0])
    rules = [AttackRule("none", ("T1",)), AttackRule("two", ("T1571", "T1021"), ("zzz",), {"class_uid": 4001, "dst_port_min": 440, "dst_port_max": 450}), AttackRule("no", ("T9",), (), {"dst_ports": [1]})]
    rows = {r["source_type"]: r["attack"] for r in tag_attack(good, rules).collect()}
    assert rows["fortigate_traffic"]["technique_ids"] == ["T1021", "T1571"] and rows["fortigate_traffic"]["tactics"] == ["lateral-movement", "command-and-control", "zzz"]
    assert rows["zeek_dns"] is None
    out = run_enrichers(good, {"bad": lambda df: df.select("no_such_column"), "good": lambda df: df.withColumn("x", F.lit(1)), "off": lambda df: df.withColumn("y", F.lit(1))}, {"off": False})
    assert "x" in out.columns and "y" not in out.columns
