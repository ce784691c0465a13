"""Template rate drift: an exponentially weighted baseline with spike and silence signals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rampart.functions.times import NS, floor_div

SIGNAL_SCHEMA = (
    "source_id string, template_id string, window_index bigint, observed bigint, expected double, baseline_rate double, "
    "current_rate double, z_score double, direction string"
)


@dataclass(frozen=True)
class DriftConfig:
    z_threshold: float = 3.0
    alpha: float = 0.3
    warmup_windows: int = 3
    window_minutes: float = 5.0
    freeze_on_signal: bool = True

    def __post_init__(self):
        if not 0.0 < self.alpha <= 1.0 or self.z_threshold <= 0.0 or self.window_minutes <= 0.0:
            raise ValueError("alpha must be in (0, 1], z_threshold and window_minutes positive")


def advance(state: tuple[float, int] | None, observed: int, cfg: DriftConfig):
    """One window: ``(new state, signal or None)`` with state ``(baseline per minute, windows folded)``."""
    rate = observed / cfg.window_minutes
    if state is None:
        return (rate, 1), None
    baseline, seen = state
    expected = baseline * cfg.window_minutes
    signal = None
    if seen >= max(1, cfg.warmup_windows) and expected > 0.0:
        z = (observed - expected) / math.sqrt(expected)
        if abs(z) >= cfg.z_threshold:
            signal = (observed, round(expected, 4), round(baseline, 6), round(rate, 6), round(z, 4), "spike" if z > 0 else "drop")
    if signal is not None and cfg.freeze_on_signal:
        return state, signal
    return (cfg.alpha * rate + (1.0 - cfg.alpha) * baseline, seen + 1), signal


def window_counts(df: DataFrame, window_minutes: float = 5.0) -> DataFrame:
    """Events per template and window: ``source_id, template_id, window_index, n``."""
    width = int(window_minutes * 60)
    index = floor_div(F.col("time"), width * NS)
    return df.groupBy("source_id", "template_id", index.alias("window_index")).agg(F.count("*").alias("n"))


def template_drift_ewma(counts: DataFrame, cfg: DriftConfig = DriftConfig(), last_window: int | None = None) -> DataFrame:
    """Signals of every template over all windows up to the newest (or ``last_window``); a window
    without events counts as zero. A group is the window counts of one template, not its events."""
    end = counts.agg(F.max("window_index")).first()[0] if last_window is None else last_window

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_window = dict(zip(pdf["window_index"], pdf["n"]))
        source, template = pdf["source_id"].iloc[0], pdf["template_id"].iloc[0]
        state, out = None, []
        for w in range(int(min(by_window)), int(end) + 1):
            state, signal = advance(state, int(by_window.get(w, 0)), cfg)
            if signal is not None:
                out.append((source, template, w, *signal))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SIGNAL_SCHEMA.split(", ")])

    if end is None:
        return counts.sparkSession.createDataFrame([], SIGNAL_SCHEMA)
    signals = counts.groupBy("source_id", "template_id").applyInPandas(run, SIGNAL_SCHEMA)
    return signals.orderBy(F.abs("z_score").desc(), "source_id", "template_id", "window_index")
