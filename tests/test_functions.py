import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from rampart.functions import coerce, ip, masks, text, times
from rampart.definitions import Definition, Field, from_mapping, load_yaml, to_mapping
from rampart.catalog import bundled


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = ["", "::", "::1", "1::", "1.2.3", "01.2.3.4", "1.2.3.4 ", "x", "1:2:3:4:5:6:7:8:9", "::2:3:4:5:6:7:8", "fe80::1%eth0", "192.0.0.9", "100.64.1.1", "224.0.0.1",
             "2001:3::1", "2001:20::1", "ff02::1", "1:0:0:2:0:0:0:3", "1:0:2:3:4:5:6:7", "1::8:1.2.3.4", "255.255.255.256", "64:ff9b:1::1"]
    for _ in range(60):
        bits = rng.getrandbits(128)
        for _ in range(rng.randint(0, 7)):
            bits &= ~(0xFFFF << 16 * rng.randint(0, 7))
        texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))), ipaddress.IPv6Address(bits).exploded.upper(), str(ipaddress.IPv6Address(bits))]
    c = F.col("a")
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select(
        "a", ip.is_ip(c).alias("ok"), ip.canonical_ip(c).alias("canon"), ip.classify_ip(c).alias("kind"), ip.is_private(c).alias("private"), ip.ip_bits(c).alias("bits")).collect()
    for r in rows:
        try:
            want = ipaddress.ip_address(r["a"])
        except ValueError:
            assert not r["ok"] and r["canon"] is None and not r["private"]
            continue
        doc = any(want in ipaddress.ip_network(n) for n in ip.DOCUMENTATION)
        assert r["ok"] and r["canon"] == str(want) and r["private"] == want.is_private, r["a"]
        assert tuple(r["kind"]) == (want.version, want.is_private and not doc, want.is_loopback, want.is_multicast, want.is_reserved, want.is_global or doc), r["a"]
        assert r["bits"] == format(int(want), f"0{want.max_prefixlen}b")


def test_timestamps(spark):
    now = 1_735_689_600 * times.NS  # 2025-01-01
    ns = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * times.NS
    cases = {
        "Oct 11 22:14:15": ns(2024, 10, 11, 22, 14, 15), "Feb 29 00:00:00": ns(2024, 2, 29), "Jan  1 00:00:00": ns(2025, 1, 1), "Jan  2 00:00:00": ns(2024, 1, 2),
        "2026-08-15T22:14:22.123456+0000": ns(2026, 8, 15, 22, 14, 22) + 123_456_000, "2026-08-15T22:14:22+02:00": ns(2026, 8, 15, 20, 14, 22),
        "1697062455.123456": 1_697_062_455_123_456_000, "1697062455123": 1_697_062_455_123_000_000, "garbage": None, "12:30": None, "2024-02-30": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", times.parse_ts_ns(F.col("a"), now_ns=F.lit(now)).alias("n")).collect()
    assert {r["a"]: r["n"] for r in rows} == cases


def test_dates_do_not_round_up_to_the_next_day(spark):
    last = 1_704_067_200 * times.NS - 1  # one nanosecond before midnight
    row = spark.range(1).select(times.event_date(F.lit(last)).alias("d"), times.hour_of_day(F.lit(last)).alias("h"), times.day_of_week(F.lit(last)).alias("w"),
                                times.event_date(F.lit(0).cast("bigint"), F.lit(last + 1)).alias("fallback"), times.floor_div(F.lit(-1).cast("bigint"), 1000).alias("neg")).first()
    assert tuple(row) == ("2023-12-31", 23, 6, "2024-01-01", -1)


def test_coercions(spark):
    rows = spark.createDataFrame([(x,) for x in ["12", "12.0", "12.5", "True", " +3 ", "1e3", "99999999999999999999", "off"]], "a string").select(
        "a", coerce.to_int(F.col("a")).alias("i"), coerce.to_bool(F.col("a")).alias("b")).collect()
    assert [r["i"] for r in rows] == [12, 12, None, None, 3, 1000, None, None]
    assert [r["b"] for r in rows] == [None, None, None, True, None, None, None, False]


@pytest.mark.parametrize("line,want", [
    ("a 10.0.0.1:443 b", "a <IP>:<PORT> b"), ("at fe80::1 ok", "at <IP> ok"), ("x Oct 11 22:14:15 y", "x <TIMESTAMP> y"), ("say 'hi 5' \"yo\"", "say <QUOTED> <QUOTED>"),
    ("size 10 bytes 5KB", "size <BYTES> <BYTES>"), ("id deadbeef01 0xff 12", "id <HEX> <HEX> <NUM>"), ("m 00:11:22:33:44:55", "m <MAC>"),
])
def test_masks(spark, line, want):
    assert spark.createDataFrame([(line,)], "a string").select(masks.mask_line(F.col("a"))).first()[0] == want


def test_capture_survives_its_own_separator(spark):
    df = spark.createDataFrame([("a=1;b=2",), ("a=\u0001x;b=2",), ("none",)], "t string")
    rows = df.select(text.capture(F.col("t"), r"a=([^;]*);b=(\d)", 2).alias("g")).collect()
    assert rows[0]["g"][1:] == ["1", "2"] and rows[1]["g"][1:] == ["\u0001x", "2"] and len(rows[2]["g"]) == 1


def test_definitions_round_trip_and_refuse_unknown_keys():
    for d in bundled():
        assert from_mapping(to_mapping(d)) == d
    doc = to_mapping(bundled()[0])
    with pytest.raises(ValueError, match="unknown keys"):
        from_mapping({**doc, "surprise": 1})
    with pytest.raises(ValueError, match="exactly one"):
        from_mapping({**doc, "detect": {"contains": "a", "regex": "b"}})
    text_yaml = "name: x\nversion: 1\nvendor: v\nproduct: p\nproduct_version: 1\ndetect: {contains: a}\nparse: {engine: kv}\nnormalize:\n  class_uid: 4001\n  category_uid: 4\n  activity_id: {from: m, map: {1: 2}, default: 0}\n  fields:\n    time: {from: [d, t], join: ' ', type: timestamp, required: true}\n"
    d = load_yaml(text_yaml)
    assert d.activity.values == {"1": 2} and d.fields[0].join == " " and d.unmapped == "drop"
