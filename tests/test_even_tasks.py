"""Work is dealt over tasks by rows, not by the splits of the files it comes from."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rampart.functions.times import _OTHER_LAYOUTS, parse_ts_ns
from rampart.operators import forest
from rampart.registry import queries_io
from rampart.registry.views import events
from rampart.session import spread


def rows_by_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_rows_of_one_split_among_many_are_spread(spark):
    one_full = spark.range(0, 1600, 1, 16).filter("id < 80")  # one of 16 splits holds all rows
    assert max(rows_by_task(spread(one_full))) <= 20
    assert max(rows_by_task(spread(one_full, rows=4))) <= 8


def test_tasks_by_key_are_not_joined_again(spark):
    tasks = rows_by_task(spread(spark.range(0, 1000, 1, 2), "id", rows=10))  # of a few bytes, which adaptive execution would join
    assert len(tasks) > 50 and max(tasks) < 40


def test_events_of_one_row_group_are_spread(spark, tmp_path):
    made = spark.range(0, 80, 1, 1).selectExpr("id as event_id", "timestamp_micros(id) as ts", "id as user_id", "'view' as event_type", "1.0d as value", "'{\"k\": 1}' as props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    with_splits = events(spark, str(tmp_path))
    assert max(rows_by_task(with_splits)) <= 20 and with_splits.count() == 80


def test_halves_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    seen = []

    def writer(stream):
        out = stream.writeStream.foreachBatch(lambda df, i: seen.append((i, sorted(r["id"] for r in df.collect()))))
        return out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)

    queries_io._in_two(spark.range(0, 40, 1, 4), f"{tmp_path}/in", F.col("id") < 30, writer)
    assert seen == [(0, list(range(30))), (1, list(range(30, 40)))]
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 2


@pytest.mark.parametrize("text, want", [
    ("2024/1/5 10:11:12", "2024-01-05 10:11:12"), ("1/5/2024 10:11:12", "2024-01-05 10:11:12"), ("Jan 5 2024 10:11:12", "2024-01-05 10:11:12"), ("5 jan 2024 10:11:12", "2024-01-05 10:11:12"),
    ("JAN 5, 2024 10:11:12", "2024-01-05 10:11:12"), ("Jan 5 10:11:12 2024", "2024-01-05 10:11:12"), ("Fri, 5 Jan 2024 10:11:12 +0200", "2024-01-05 08:11:12"), ("20240105T101112Z", "2024-01-05 10:11:12"),
    ("5/Jan/2024 10:11:12", "2024-01-05 10:11:12"), ("2024/1/5", "2024-01-05 00:00:00"), ("xJan 5 2024 10:11:12", None), ("x2024/1/5", None), ("5 2024 Jan", None),
])
def test_layouts_are_tried_where_they_can_fit(spark, text, want):
    got = spark.range(1).select(F.date_format(F.timestamp_micros((parse_ts_ns(F.lit(text)) / 1000).cast("bigint")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def test_junk_meets_no_layout(spark):
    begins = [begin for _, begin in _OTHER_LAYOUTS]
    assert spark.range(1).select(*[F.lit("x2024-01-05 10:11:12").rlike(b).alias(f"b{i}") for i, b in enumerate(begins)]).first() == (False,) * len(begins)


def test_medians_take_one_pass_and_scores_are_made_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"event_uid": [str(i) for i in range(601)], "a": rng.normal(size=601), "b": rng.integers(0, 9, 601).astype(float), "c": [None] * 601})
    table.loc[0, "a"] = None
    df = spark.createDataFrame(table, "event_uid string, a double, b double, c double")
    monkeypatch.setattr(forest, "GRID", 100)  # as for a table beyond the grid
    monkeypatch.setattr(forest, "exact_quantile", lambda *_: pytest.fail("a pass for each column"))
    assert forest.feature_medians(df, ["a", "b", "c"]) == {"a": pytest.approx(np.median(table["a"][1:])), "b": np.median(table["b"]), "c": 0.0}
    scored = []
    monkeypatch.setattr(forest, "exact_quantile", lambda df, *rest: scored.append(df._jdf.queryExecution().optimizedPlan().toString()) or 0.5)
    forest.IsolationForest(contamination=0.1, n_estimators=3).fit(df, ["a", "b"])
    assert len(scored) == 1 and "ArrowEvalPython" not in scored[0]
