"""Training and scoring jobs over the silver table, template drift over mined lines."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from rampart.functions.times import NS
from rampart.operators.features import MODEL_COLUMNS, extract_features, load_feature_columns
from rampart.operators.forest import IsolationForest
from rampart.operators.lake import recent_window, silver_between
from rampart.operators.drift import DriftConfig, template_drift_ewma, window_counts
from rampart.operators.templates import template_drift_lifetime

KEYS = ["date", "source_type"]
ANOMALY_COLUMNS = ["event_uid", "src_ip", "event_time_ns", "source_type", "anomaly_score", "is_anomaly", "scored_at_ns", "model_trained_at", "explanation_json"]


def range_features(silver: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Feature matrix of a date range; windows do not cross (date, source type) partitions."""
    return extract_features(load_feature_columns(silver_between(silver, date_from, date_to)), keys=KEYS)


def train(silver: DataFrame, date_from: str, date_to: str, contamination: float | str = 0.02, n_estimators: int = 100) -> IsolationForest:
    model = IsolationForest(contamination=contamination, n_estimators=n_estimators)
    return model.fit(range_features(silver, date_from, date_to), MODEL_COLUMNS)


def score_features(features: DataFrame, model: IsolationForest, scored_at_ns: int | None = None) -> DataFrame:
    """Anomaly rows of a feature frame; flagged rows carry an explanation."""
    at = scored_at_ns if scored_at_ns is not None else time.time_ns()
    out = model.explain(model.score(features))
    return out.select(
        "event_uid", "src_ip", F.col("time").alias("event_time_ns"), "source_type", "anomaly_score", "is_anomaly",
        F.lit(at).cast("bigint").alias("scored_at_ns"), F.lit(model.trained_at).alias("model_trained_at"), "explanation_json",
    )


def score_day(silver: DataFrame, model: IsolationForest, date: str, scored_at_ns: int | None = None) -> DataFrame:
    return score_features(range_features(silver, date, date), model, scored_at_ns)


def score_recent(silver: DataFrame, model: IsolationForest, minutes: float, now_ns: int) -> DataFrame:
    """Events of the last ``minutes``; their windows still see the whole event dates they touch."""
    days = sorted({time.strftime("%Y-%m-%d", time.gmtime(t // NS)) for t in (now_ns - int(minutes * 60 * NS), now_ns)})
    features = range_features(silver, days[0], days[-1])
    return score_features(recent_window(features, minutes, now_ns), model, now_ns)


def template_drift(mined: DataFrame, method: str = "ewma", cfg: DriftConfig = DriftConfig(), now_ns: int | None = None,
                   source_id: str | None = None) -> DataFrame:
    """Drift of mined lines by the weighted baseline (``ewma``) or the template lifetime (``lifetime``)."""
    mined = mined.filter(F.col("source_id") == source_id) if source_id is not None else mined
    if method == "ewma":
        return template_drift_ewma(window_counts(mined, cfg.window_minutes), cfg)
    if method == "lifetime":
        return template_drift_lifetime(mined, int(cfg.window_minutes * 60), now_ns if now_ns is not None else time.time_ns())
    raise ValueError(f"unknown drift method {method!r}")


def load_model(spark: SparkSession, path: str) -> IsolationForest:
    return IsolationForest.load(spark, path)
