import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lines import raw_events
from rampart.operators import integrity as I, templates as T
from rampart.operators.drift import DriftConfig, template_drift_ewma
from rampart.operators.features import MODEL_COLUMNS, extract_features, windowed_source_features
from rampart.operators.forest import IsolationForest
from rampart.operators.ordering import exact_quantile, global_position, order_statistics
from rampart.plans.scoring import score_features
from rampart.plans.suggest import SuggestError, definition_yaml, score_definition, suggest_definition
from rampart.definitions import load_yaml

NS = 1_000_000_000


def root_of(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


def test_merkle_roots_of_many_sizes(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 21, 33]
    rows = [(f"b{n}", i, hashlib.sha256(f"{n}/{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    got = {r["b"]: (r["root"], r["leaf_count"]) for r in I.merkle_roots(spark.createDataFrame(rows, "b string, i bigint, raw_hash string"), ["b"], ["i"]).collect()}
    for n in sizes:
        assert got[f"b{n}"] == (root_of([h for b, _, h in rows if b == f"b{n}"]), n)


def test_ledger_detects_tampering(spark):
    raw = raw_events(spark, [f"line {i}" for i in range(50)]).cache()
    ledger, index = I.seal_batches(raw, 4, sealed_at_ns=1)
    ledger = ledger.cache()
    rows = ledger.orderBy("seq").collect()
    assert [r["leaf_count"] for r in rows] == [4] * 12 + [2] and rows[0]["prev_chained_root"] == I.GENESIS
    for a, b in zip(rows[:4], rows[1:5]):
        assert b["prev_chained_root"] == a["chained_root"] == hashlib.sha256(bytes.fromhex(a["prev_chained_root"]) + bytes.fromhex(a["batch_root"])).hexdigest()
    assert I.verify_chain(ledger).first()["chain_ok"]
    head = ledger.orderBy(F.desc("seq")).limit(1).select("ledger", "chained_root")  # the next ledger of that name links to it
    later, _ = I.seal_batches(raw, 25, sealed_at_ns=2, prev=head)
    assert later.filter("seq = 0").first()["prev_chained_root"] == rows[-1]["chained_root"]
    assert I.verify_chain(later, head).first()["chain_ok"] and I.verify_chain(later).first()["first_bad_seq"] == 0
    bad = ledger.withColumn("batch_root", F.when(F.col("seq") == 7, F.sha2("batch_root", 256)).otherwise(F.col("batch_root")))
    assert I.verify_chain(bad).first()["first_bad_seq"] == 7
    gap = ledger.filter("seq <> 6")
    assert I.verify_chain(gap).first()["first_bad_seq"] == 7
    changed = raw.withColumn("raw", F.when(F.col("event_uid") == "u13", F.encode(F.lit("evil"), "UTF-8")).otherwise(F.col("raw")))
    checked = I.verify_events(changed, index, ledger).filter("not verified").collect()
    assert [r["event_uid"] for r in checked] == ["u13"] and checked[0]["hash_ok"] is False


def test_positions_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: r["position"] for r in global_position(df, ["g"], ["v", "i"]).collect()}
    for g in "ab":
        order = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in order] == list(range(len(order)))
    values = np.array([v for _, v, _ in rows], dtype=float)
    for q in (0.0, 0.31, 0.5, 0.98, 1.0):
        assert exact_quantile(df, "v", q) == pytest.approx(np.percentile(values, q * 100))
        assert exact_quantile(df, "i", q, bins=4, small=3) == pytest.approx(np.percentile(range(500), q * 100))
    grid = [r["value"] for r in order_statistics(df, ["v"], 50).orderBy("k").collect()]
    assert grid == list(np.sort(values)[np.linspace(0, 499, 50).round().astype(int)])


def test_drift_scenarios(spark):
    counts = {"spike": [2, 2, 2, 2, 80], "silent": [40] * 5 + [0, 0], "steady": [5, 6, 5, 4, 5], "late": [0, 0, 9, 9]}
    rows = [("s", name, w, n) for name, ns in counts.items() for w, n in enumerate(ns) if n]
    df = spark.createDataFrame(rows, "source_id string, template_id string, window_index bigint, n bigint")
    got = [(r["template_id"], r["window_index"], r["direction"]) for r in template_drift_ewma(df, DriftConfig(), last_window=6).collect()]
    assert ("spike", 4, "spike") in got and [g for g in got if g[0] == "silent"] == [("silent", 5, "drop"), ("silent", 6, "drop")]
    assert not [g for g in got if g[0] == "steady" and g[2] == "spike"]
    with pytest.raises(ValueError):
        DriftConfig(alpha=0)


def test_mining_finds_the_shapes_of_lines_and_of_one_bucket(spark):
    lines = [f"user u{i} logged in from 10.0.0.{i % 200} port {i}" for i in range(300)] + [f"disk usage sd{chr(97 + i % 26)} at {i} percent" for i in range(200)] + ["", "single"]
    df = spark.createDataFrame([("s", x, i) for i, x in enumerate(lines)], "source_id string, line string, time bigint")
    mined = T.mine_templates(df).cache()
    assert mined.count() == len(lines)
    assert {r["template"]: r["count"] for r in mined.groupBy("template").count().collect()} == {"user <*> logged in from <IP> port <NUM>": 300, "disk usage <*> at <NUM> percent": 200, "": 1, "single": 1}
    bucket = T.cluster_lines(spark.createDataFrame([("b", f"user u{i} in", i) for i in range(100)], "bucket string, text string, first_ns bigint"))
    assert {r["template"] for r in bucket.collect()} == {"user <*> in"} and bucket.count() == 100
    params = T.template_params(mined).filter("line like 'user u7 %'").first()["params"]
    assert params == ["u7", "10.0.0.7", "7"]


def test_suggested_definition_reads_new_lines(spark):
    line = lambda i: f"<134>Oct 11 22:14:{i % 60:02d} gw1 fw: flow verdict {'deny' if i % 3 else 'allow'} from 10.0.0.{i % 250} port {30000 + i % 500} to 8.8.4.{i % 250} port {i % 1000 + 1} bytes {5000 + i * 7}"
    df = spark.createDataFrame([(line(i),) for i in range(40)], "text string")
    definition, review = suggest_definition(df, "Edge FW")
    assert definition.name == "edge_fw" and definition.envelope == "syslog" and definition.engine in ("dissect", "grok")
    paths = {f.path for f in definition.fields}
    assert {"src_endpoint.ip", "dst_endpoint.ip", "time", "action_id", "src_endpoint.port", "dst_endpoint.port"} <= paths, paths
    assert load_yaml(definition_yaml(definition, review)) == definition
    score = score_definition(spark.createDataFrame([(line(i),) for i in range(500, 560)], "text string"), definition).first()
    assert score["parse_rate"] == 1.0 and score["required_fields_covered"] == 1.0 and score["confidence"] > 0.6, score
    kv = spark.createDataFrame([(f"time={1700000000 + i} src=10.0.0.{i} dst=10.0.1.{i} spt={4000 + i} act=deny intf=eth{i % 2} model=X9",) for i in range(10)], "text string")
    definition, _ = suggest_definition(kv, "kv-src")
    assert definition.engine == "kv" and {"src_endpoint.ip", "dst_endpoint.ip", "action"} <= {f.path for f in definition.fields}
    assert "model=X9" in str(definition.detect)
    with pytest.raises(SuggestError):
        suggest_definition(df.limit(2), "x")


@pytest.fixture(scope="module")
def flows(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", i * 10 * NS, f"10.0.0.{rng.randint(1, 20)}", f"8.8.4.{rng.randint(1, 4)}", rng.choice([443, 80]), "tcp", 1, 1, rng.randint(900, 1100), rng.randint(400, 600)) for i in range(1500)]
    rows += [(f"scan{i}", 3000 * NS + i, "10.9.9.9", "8.8.4.9", 5000 + i, "tcp", 2, 1, 0, 0) for i in range(12)]
    return spark.createDataFrame(rows, "event_uid string, time bigint, src_ip string, dst_ip string, dst_port bigint, protocol string, action_id bigint, severity_id bigint, bytes_in bigint, bytes_out bigint").withColumns(
        {"source_type": F.lit("s"), "date": F.lit("1970-01-01")}).cache()


def test_port_scan_stands_out_in_windows(flows):
    w = windowed_source_features(flows).filter("src_ip = '10.9.9.9'").first()
    assert (w["distinct_dst_ports"], w["deny_ratio"], w["connection_count"], w["distinct_dst_ips"]) == (12, 1.0, 12, 1)


def test_forest_flags_the_scan_and_survives_storage(spark, flows, tmp_path):
    features = extract_features(flows, keys=["date", "source_type"]).cache()
    model = IsolationForest(contamination=0.01, n_estimators=50).fit(features, MODEL_COLUMNS)
    rows = score_features(features, model, 1).collect()
    ranked = sorted(rows, key=lambda r: -r["anomaly_score"])
    assert all(r["event_uid"].startswith("scan") for r in ranked[:10]) and 5 <= sum(r["is_anomaly"] for r in rows) <= 30
    reasons = json.loads(ranked[0]["explanation_json"])
    assert len(reasons) == 3 and all(r["extremeness"] > 99 for r in reasons) and reasons[0]["training_p5"] <= reasons[0]["training_p95"]
    assert all((r["explanation_json"] != "") == r["is_anomaly"] for r in rows)
    model.save(spark, str(tmp_path / "m"))
    again = IsolationForest.load(spark, str(tmp_path / "m"))
    assert again.metadata == model.metadata
    scores = {r["event_uid"]: r["anomaly_score"] for r in rows}
    assert all(abs(scores[r["event_uid"]] - r["anomaly_score"]) < 1e-12 for r in score_features(features, again, 1).collect())
    other = IsolationForest(contamination=0.01, n_estimators=50).fit(features.repartition(7), MODEL_COLUMNS)
    assert other.trees.equals(model.trees)  # same data and seed, same trees, whatever the partitioning
    with pytest.raises(RuntimeError):
        IsolationForest().score(features)
