"""Writing one result to several sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Sink:
    name: str
    write: Callable[[DataFrame], None]
    required: bool = False


def write_all(df: DataFrame, sinks: list[Sink], dead_letter: Callable[[DataFrame], None], now_ns: int | None = None) -> dict[str, str]:
    """Write to every sink and report ``ok`` or the error of each.

    A failed required sink sends the rows to ``dead_letter``; optional failures are only reported.
    The rows are kept on disk once so that sinks do not recompute them.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        outcome: dict[str, str] = {}
        for sink in sinks:
            try:
                sink.write(df)
                outcome[sink.name] = "ok"
            except Exception as exc:
                _log.warning("sink %s failed: %s", sink.name, exc)
                outcome[sink.name] = f"{type(exc).__name__}: {exc}"
        failed = [s.name for s in sinks if s.required and outcome[s.name] != "ok"]
        if failed:
            ts = F.lit(now_ns).cast("bigint") if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
            detail = F.to_json(F.struct(F.col("source_type"), F.array(*[F.lit(n) for n in failed]).alias("failed_sinks"),
                                        F.create_map(*[F.lit(x) for n in failed for x in (n, outcome[n])]).alias("errors")))
            raw = F.col("raw") if "raw" in df.columns else F.lit(None).cast("binary")
            dead_letter(df.select("event_uid", raw.alias("raw"), "raw_hash", F.lit("required_sink_failed").alias("reason"),
                                  F.lit("sinks").alias("stage"), detail.alias("detail"), ts.alias("ts_ns")))
        return outcome
    finally:
        df.unpersist()
