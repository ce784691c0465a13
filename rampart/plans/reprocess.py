"""Reprocessing history, replaying dead letters, and checking that results are reproducible."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rampart.definitions import Definition
from rampart.functions.ocsf import completeness, optional
from rampart.functions.times import event_date
from rampart.operators.dead_letters import filter_dead_letters, replay_source
from rampart.operators.flatten import to_silver
from rampart.operators.normalize import match_source, prepare
from rampart.plans.normalize import accepted, dead_letters, normalize
from rampart.schemas import SILVER_CORE
from rampart.session import spread
from rampart.sources.tables import bronze_on, read_bronze, read_dead_letters, read_resolutions, read_silver, uid_dates, write_dead_letters, write_resolutions, write_silver


@dataclass(frozen=True)
class Lake:
    """Folders of the lake tables."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("bronze", "silver", "dead_letters", "resolutions", "anomalies", "ledger", "index", "templates"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def run_tag(now: float | None = None) -> str:
    """A tag that orders runs by time and tells runs of one second apart."""
    return time.strftime("reprocess-%Y%m%dT%H%M%SZ", time.gmtime(now)) + f"-{uuid.uuid4().hex[:6]}"


def latest_generation(silver: DataFrame) -> DataFrame:
    """The newest row of each event: a real ``metadata.log_version`` beats none, then the run tag after
    the last ``+`` decides. Aggregated before the shuffle, so many copies of one event cost one row."""
    tag = F.nullif(optional(silver, "metadata.log_version"), F.lit(""))
    rank = F.struct(tag.isNotNull().alias("a"), F.coalesce(F.substring_index(tag, "+", -1), F.lit("")).alias("b"))
    rest = [c for c in silver.columns if c != "event_uid"]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    best = silver.groupBy("event_uid").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(rank.alias("r"), tie.alias("t"))).alias("_r"))
    return best.select("event_uid", *[F.col("_r").getField(c).alias(c) for c in rest])


def compare_generations(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each new silver row with ``outcome`` (``changed``/``unchanged``/``no_previous``) against the newest
    previous row of its event, and both completeness scores."""
    core = list(SILVER_CORE)
    previous = latest_generation(old)
    previous = previous.withColumn("_c", completeness(previous)).select(
        F.col("event_uid").alias("_uid"), F.struct(*[F.col(c) for c in core]).alias("_core"), F.col("_c").alias("completeness_old"))
    fresh = new.withColumn("completeness_new", F.coalesce(completeness(new), F.lit(0.0)))
    joined = fresh.join(previous, F.col("event_uid") == F.col("_uid"), "left")
    same = F.lit(True)
    for c in core:
        same = same & F.col(c).eqNullSafe(F.col(f"_core.{c}"))
    outcome = F.when(F.col("_uid").isNull(), "no_previous").when(same, "unchanged").otherwise("changed")
    return joined.select("event_uid", outcome.alias("outcome"), "completeness_old", "completeness_new")


def compare_report(compared: DataFrame) -> DataFrame:
    """One row: counts per outcome and the average completeness before and after."""
    both = F.col("completeness_old").isNotNull()
    old, new = F.avg(F.when(both, F.col("completeness_old"))), F.avg(F.when(both, F.col("completeness_new")))
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return compared.agg(count("no_previous"), count("changed"), count("unchanged"), old.alias("completeness_old_avg"),
                        new.alias("completeness_new_avg"), (new - old).alias("completeness_delta_avg"))


def reprocess_report(outcomes: DataFrame, raw_events: int | None = None) -> DataFrame:
    """One row: in scope, normalized, dead-lettered and the silver dates touched."""
    date = F.when(F.col("status") != "dead", event_date(F.col("time"), F.col("ingest_time_ns")))
    return outcomes.agg(
        F.lit(raw_events).cast("bigint").alias("raw_events"), F.count("*").alias("in_scope"), F.count_if(F.col("status") != "dead").alias("normalized"),
        F.count_if(F.col("status") == "dead").alias("dead_lettered"), F.array_sort(F.collect_set(date)).alias("silver_dates"),
    )


def reprocess(spark: SparkSession, lake: Lake, defs: list[Definition], date: str, source_type: str | None = None, dry_run: bool = False,
              compare: bool = False, enrich: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Run one ingest date of bronze through today's definitions and append the results.

    Comparison joins on the event over the event dates the run touches, so late events find
    their previous rows.
    """
    tag = run_tag()
    bronze = read_bronze(spark, lake.bronze, date)
    outcomes = normalize(bronze, defs, enrich, run_tag=tag)
    if source_type is not None:
        outcomes = outcomes.filter(F.col("source_type") == source_type)
    outcomes = outcomes.persist(StorageLevel.DISK_ONLY)
    try:
        report = reprocess_report(outcomes, bronze.count()).first().asDict()
        report |= {"date": date, "source_type": source_type, "dry_run": dry_run, "mapping_version_tag": tag, "compare": None}
        silver = to_silver(accepted(outcomes))
        if compare:
            old = read_silver(spark, lake.silver).filter(F.col("date").isin(report["silver_dates"]))
            report["compare"] = compare_report(compare_generations(silver, old)).first().asDict()
        report["written"] = 0 if dry_run else report["normalized"]
        if not dry_run:
            write_silver(silver, lake.silver, run=tag)
            write_dead_letters(dead_letters(outcomes), lake.dead_letters, run=tag)
        return report
    finally:
        outcomes.unpersist()


def replay_dead_letters(spark: SparkSession, lake: Lake, defs: list[Definition], reason: str | None = None, since_ns: int | None = None,
                        dry_run: bool = False, enrich: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Run unresolved dead letters again; successes land in silver and are marked resolved, the letters stay.

    Bronze is read for the days named in the letters' ids only; where one of them names none, all of it.
    """
    dead, done = read_dead_letters(spark, lake.dead_letters), read_resolutions(spark, lake.resolutions)
    letters = filter_dead_letters(dead, done, reason=reason, since_ns=since_ns, unresolved_only=True).dropDuplicates(["event_uid"])
    letters = letters.persist(StorageLevel.DISK_ONLY)
    candidates = replay_source(letters, bronze_on(read_bronze(spark, lake.bronze), uid_dates(letters)))
    outcomes = normalize(candidates, defs, enrich).persist(StorageLevel.DISK_ONLY)
    try:
        counts = outcomes.agg(F.count("*").alias("candidates"), F.count_if(F.col("status") != "dead").alias("succeeded")).first()
        report = {"reason": reason, "dry_run": dry_run, **counts.asDict(), "still_failing": counts["candidates"] - counts["succeeded"], "written": 0}
        if not dry_run and counts["candidates"]:
            run = run_tag().replace("reprocess", "replay")
            good = outcomes.filter(F.col("status") != "dead")
            write_silver(to_silver(accepted(outcomes).drop("original_reason", "original_stage")), lake.silver, run=run)
            detail = F.to_json(F.struct("original_reason", "original_stage"))
            now = F.unix_micros(F.current_timestamp()) * 1000
            write_resolutions(good.select("event_uid", now.alias("resolved_ts_ns"), detail.alias("detail")), lake.resolutions, run=run)
            write_dead_letters(dead_letters(outcomes), lake.dead_letters, run=run)
            report["written"] = counts["succeeded"]
        return report
    finally:
        outcomes.unpersist()
        letters.unpersist()


# -- reproducibility ------------------------------------------------------------------------


def roundtrip_report(bronze: DataFrame, defs: list[Definition]) -> DataFrame:
    """One row: share of events with unaltered bytes, with the same parse twice, with the same record twice.

    Both passes read the stored bytes anew; the second pass runs over rows in another partitioning.
    """
    keep = ["event_uid", "status", "reason", "source_type"]

    def signature(df: DataFrame, name: str) -> DataFrame:
        out = normalize(df, defs, keep_fields=True)
        skip = {"raw", "transport", "peer", "source_id", *keep, "errors", "warnings", "detail", "stage", "unmapped", "fields", "mapping_version"}
        record = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in out.columns if c not in skip])), 256)
        fields = F.sha2(F.to_json(F.array_sort(F.map_entries("fields"))), 256)
        return out.select(*[F.col(c).alias(f"{c}_{name}") if c != "event_uid" else F.col(c) for c in keep], fields.alias(f"f_{name}"), record.alias(f"r_{name}"))

    first, second = signature(bronze, "a"), signature(spread(bronze, "event_uid"), "b")
    both = first.join(second, "event_uid").join(bronze.select("event_uid", (F.sha2("raw", 256) == F.lower("raw_hash")).alias("lossless")), "event_uid")
    known = F.col("source_type_a") != "unknown"
    mapped = known & ((F.col("status_a") == "ok") | (F.col("reason_a") == "ocsf_validation_failed"))
    stable_parse = F.col("f_a").eqNullSafe(F.col("f_b")) & F.col("source_type_a").eqNullSafe(F.col("source_type_b")) & (F.col("f_a").isNotNull() | ~known)
    rate = lambda n, d: F.round(F.when(F.col(d) == 0, 100.0).otherwise(F.col(n) / F.col(d) * 100.0), 4)
    counts = both.agg(
        F.count("*").alias("total"), F.count_if("lossless").alias("byte_lossless"), F.count_if(stable_parse).alias("reparse_stable"),
        F.count_if(mapped).alias("normalized_originally"), F.count_if(mapped & (F.col("r_a") == F.col("r_b"))).alias("renormalize_stable"),
        F.count_if(known & ~mapped).alias("dead_letter_count"), F.count_if(~known).alias("no_source_match_count"),
    )
    return counts.select("*", rate("byte_lossless", "total").alias("byte_lossless_rate"), rate("reparse_stable", "total").alias("reparse_stable_rate"),
                         rate("renormalize_stable", "normalized_originally").alias("renormalize_stable_rate"))


def check_sources(samples: DataFrame, defs: list[Definition]) -> DataFrame:
    """Whether each definition claims its own sample (``name, raw``) and yields a valid, fairly complete
    record with traceability and leftovers."""
    raw = samples.select(
        F.col("name").alias("source_id"), F.col("raw").cast("binary").alias("raw"), F.col("name").alias("event_uid"),
        F.sha2(F.col("raw").cast("binary"), 256).alias("raw_hash"), F.octet_length("raw").alias("raw_len"),
        (F.unix_micros(F.current_timestamp()) * 1000).alias("ingest_time_ns"), F.lit("file").alias("transport"), F.lit(None).cast("string").alias("peer"))
    out = normalize(raw, defs)
    checks = {
        "claims_sample": F.col("source_type") == F.col("source_id"), "has_class": F.col("class_uid").isNotNull(),
        "valid": F.size("errors") == 0, "complete": F.col("completeness") > 0.6, "has_uid": F.col("`metadata.uid`").isNotNull(),
        "has_hash": F.col("`metadata.log_hash`").isNotNull(), "keeps_leftovers": F.coalesce(F.size("unmapped") > 0, F.lit(False)),
    }
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & F.coalesce(c, F.lit(False))
    return out.select(F.col("source_id").alias("name"), F.col("source_type").alias("matched_name"), "class_uid", "completeness",
                      *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()], passed.alias("ok"))


def pipeline_metrics(outcomes: DataFrame) -> DataFrame:
    """``metric, label, value``: events received and their bytes, parsed, normalized per source and class, dead per stage and
    reason, the parse share, and a completeness histogram with cumulative bounds 0.0 .. 1.0."""
    per = outcomes.groupBy("transport", "status", "source_type", "class_uid", "stage", "reason", "parsed").agg(
        F.count("*").alias("n"), F.sum("raw_len").alias("bytes"),
        *[F.count_if(F.col("completeness") <= b / 10 + 1e-12).alias(f"le_{b}") for b in range(11)],
    )
    # a share is a sum over a sum; all other metrics are sums
    row = lambda metric, label, value, of=F.lit(None): F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value"), of.cast("double").alias("of"))
    ok, dead = F.col("status") != "dead", F.col("status") == "dead"
    events = F.array_compact(F.array(
        row("events_received", F.col("transport"), F.col("n")), row("bytes_received", F.col("transport"), F.col("bytes")),
        F.when(F.col("parsed"), row("events_parsed", F.col("source_type"), F.col("n"))),
        row("parse_share", F.lit(""), F.when(F.col("parsed"), F.col("n")).otherwise(0), F.col("n")),
        F.when(ok, row("events_normalized", F.concat_ws("/", "source_type", F.col("class_uid").cast("string")), F.col("n"))),
        F.when(dead, row("dead_letters", F.concat_ws("/", "stage", "reason"), F.col("n"))),
        *[F.when(ok | (F.col("stage") == "validate"), row("completeness_le", F.lit(f"{b / 10:.1f}"), F.col(f"le_{b}"))) for b in range(11)],
    ))
    summed = per.select(F.explode(events).alias("m")).groupBy("m.metric", "m.label").agg(F.sum("m.value").alias("value"), F.sum("m.of").alias("of"))
    return summed.select("metric", "label", (F.col("value") / F.coalesce("of", F.lit(1.0))).alias("value"))
