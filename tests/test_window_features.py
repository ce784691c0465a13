"""Window features: each event moves once, hot groups spread by value, and both ways count the same."""

import random

import pytest

from rampart.operators import features
from rampart.operators.features import windowed_source_features

SCHEMA = "date string, time bigint, src_ip string, dst_ip string, dst_port bigint, protocol string, action_id bigint, bytes_in bigint, bytes_out bigint"
WINDOW = 300 * 10**9


def odd_rows(n=600):
    rng = random.Random(11)
    some = lambda *values: rng.choice([*values, None])
    rows = [(some("a", "b"), some(0, 1, WINDOW, -1), some("10.0.0.1", "10.0.0.2"), some("", "x", "y", "z"), some(-1, 0, 22, 443), some("tcp", "UDP", "zz"), some(1, 2), some(-5, 7), some(-5, 9)) for _ in range(n)]
    return rows + rows[:50] + [("a", WINDOW * 5 + i, "10.9.9.9", f"8.8.4.{i % 3}", i, "tcp", 2, 1, 1) for i in range(40)]


def by_hand(rows, keyed):
    groups = {}
    for date, time, src, *rest in rows:
        if time is not None and src is not None:
            groups.setdefault((date if keyed else 0, src, time // WINDOW * WINDOW), []).append(rest)
    more = lambda x: max(x or 0, 0)
    known = {"tcp": 6, "udp": 17}
    return {k: (
        len(g), len({r[0] for r in g} - {None}), len({r[1] for r in g} - {None}), round(sum(r[3] == 2 for r in g) / len(g), 9), sum(more(r[5]) for r in g),
        round(sum(more(r[4]) + more(r[5]) for r in g) / len(g), 9), len({known.get((r[2] or "").lower(), 0) for r in g})) for k, g in groups.items()}


def counted(df, keyed):
    names = features.WINDOWED
    rows = df.collect()
    got = {((r["date"] if keyed else 0), r["src_ip"], r["window_start"]): tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("hot_rows", [1_000_000, 30, 0])
def test_both_ways_count_the_same(spark, monkeypatch, hot_rows, keyed):
    monkeypatch.setattr(features, "HOT_ROWS", hot_rows)
    rows = odd_rows()
    df = windowed_source_features(spark.createDataFrame(rows, SCHEMA).repartition(5), keys=["date"] if keyed else None)
    assert df.columns == (["date"] if keyed else []) + ["src_ip", "window_start", "connection_count", "distinct_dst_ips", "distinct_dst_ports", "deny_ratio",
                                                       "total_bytes_out", "mean_bytes_per_conn", "distinct_protocols"]
    assert counted(df, keyed) == by_hand(rows, keyed)


def test_events_are_not_multiplied_unless_a_group_is_hot(spark, monkeypatch):
    events = spark.createDataFrame(odd_rows(), SCHEMA)
    df = windowed_source_features(events)
    df.collect()
    assert "Expand" not in final_plan(df)
    monkeypatch.setattr(features, "HOT_ROWS", 30)
    df = windowed_source_features(events)
    df.collect()
    assert "Expand" in final_plan(df)
