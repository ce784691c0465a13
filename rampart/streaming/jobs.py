"""Streaming jobs: lines to lake, windowed features, scoring, drift, sealing, templates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rampart.definitions import Definition
from rampart.functions.masks import mask_line
from rampart.functions.times import to_timestamp
from rampart.operators.drift import SIGNAL_SCHEMA, DriftConfig, advance
from rampart.operators.features import protocol_number
from rampart.operators.flatten import to_silver
from rampart.operators.forest import IsolationForest
from rampart.operators.integrity import ledger_heads, seal_batches
from rampart.operators.templates import DEPTH, MAX_CHILDREN, SIMILARITY, WILD, template_tokens
from rampart.plans.normalize import accepted, dead_letters, normalize
from rampart.plans.reprocess import Lake
from rampart.plans.scoring import score_recent
from rampart.session import checkpoint, spread
from rampart.sources.lines import stream_log_lines, to_raw_events
from rampart.sources.tables import batch_numbers, drop_batches, landed_dates, mark_landed, read_bronze_run, read_silver, write_anomalies, write_bronze, write_dead_letters, write_silver


def land_batch(raw: DataFrame, batch_id: int, lake: Lake, defs: list[Definition], enrich: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One micro-batch of lines or raw events to bronze, silver and dead letters. Every table gets the
    batch as its run, so a repeated batch replaces its own files. Ids and dates are those stored in bronze: a batch
    repeated after bronze was written takes its events from there."""
    run = f"batch-{batch_id:012d}"
    spark = raw.sparkSession
    dates = landed_dates(spark, lake.bronze, run)
    if dates is None:
        if "event_uid" not in raw.columns:
            raw = to_raw_events(raw.withColumn("row_id", F.monotonically_increasing_id()))
        write_bronze(raw, lake.bronze, run=run)
        dates = mark_landed(spark, lake.bronze, run)
    stored = spread(read_bronze_run(spark, lake.bronze, run, dates)).persist(StorageLevel.MEMORY_AND_DISK)
    outcomes = normalize(stored, defs, enrich).persist(StorageLevel.DISK_ONLY)
    try:
        write_silver(to_silver(accepted(outcomes)), lake.silver, run=run)
        write_dead_letters(dead_letters(outcomes), lake.dead_letters, run=run)
    finally:
        outcomes.unpersist()
        stored.unpersist()


def stream_lines_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a folder as a stream for :func:`run_stream`; ids are minted inside each micro-batch,
    where row numbers are stable when a task is repeated."""
    return stream_log_lines(spark, folder)


def run_stream(raw_events: DataFrame, lake: Lake, defs: list[Definition], checkpoint: str,
               enrich: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> DataStreamWriter:
    """The continuous pipeline over a stream of raw events; call ``.start()``. At least once from the
    source, exactly once per table and batch."""
    writer = raw_events.writeStream.foreachBatch(lambda df, i: land_batch(df, i, lake, defs, enrich))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def dedup_stream(df: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop redelivered events (same id) within the watermark of the ingest time."""
    stamped = df if "ingest_ts" in df.columns else df.withColumn("ingest_ts", to_timestamp(F.col("ingest_time_ns")))
    return stamped.withWatermark("ingest_ts", watermark).dropDuplicatesWithinWatermark(["event_uid"])


def stream_window_features(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Window aggregates per source address on a stream; distinct counts are estimates unless ``exact``.

    Exact counts chain two aggregations: the first keeps a state row per window, address and different value, the second adds
    them up when the watermark closes the window. So no buffer grows with a hot address, and its values spread over all tasks.
    """
    amount = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    stamped = events.filter(F.col("src_ip").isNotNull()).select(
        to_timestamp(F.col("time")).alias("event_ts"), "src_ip", "dst_ip", "dst_port", protocol_number(events).alias("protocol_num"),
        F.coalesce((F.col("action_id") == 2).cast("int"), F.lit(0)).alias("deny"), amount("bytes_out").alias("bytes_out"), (amount("bytes_in") + amount("bytes_out")).alias("volume"),
    ).withWatermark("event_ts", watermark)
    counted = ("dst_ip", "dst_port", "protocol_num")
    if exact:
        fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
        facts = stamped.withColumn("fact", F.explode(F.array(fact("", F.lit(None)), *[fact(c, F.col(c)) for c in counted]))).select("*", "fact.kind", "fact.value")
        values = facts.filter((F.col("kind") == "") | F.col("value").isNotNull()).groupBy(F.window("event_ts", window), "src_ip", "kind", "value").agg(
            F.count("*").alias("n"), F.sum("deny").alias("deny"), F.sum("bytes_out").alias("bytes_out"), F.sum("volume").alias("volume"))
        whole = lambda c: F.sum(F.when(F.col("kind") == "", F.col(c)))
        grouped, n = values.groupBy(F.window(F.window_time("window"), window), "src_ip"), whole("n")
        distinct = lambda c: F.count_if(F.col("kind") == c)
        deny, out, volume = whole("deny") / n, whole("bytes_out"), whole("volume") / n
    else:
        grouped, n, distinct = stamped.groupBy(F.window("event_ts", window), "src_ip"), F.count("*"), F.approx_count_distinct
        deny, out, volume = F.avg("deny"), F.sum("bytes_out"), F.avg("volume")
    names = ("distinct_dst_ips", "distinct_dst_ports", "distinct_protocols")
    ips, ports, protocols = (distinct(c).alias(name) for c, name in zip(counted, names))
    return grouped.agg(
        n.alias("connection_count"), ips, ports, deny.alias("deny_ratio"), out.alias("total_bytes_out"), volume.alias("mean_bytes_per_conn"), protocols,
    ).select(F.unix_micros("window.start").alias("_us"), "*").withColumn("window_start", F.col("_us") * 1000).drop("_us", "window")


def stream_scoring(ticks: DataFrame, model: IsolationForest, lake: Lake, minutes: float, checkpoint: str, trigger: dict | None = None) -> DataStreamWriter:
    """Re-score the last ``minutes`` of silver on every micro-batch of ``ticks`` (any stream with ``time``);
    readers keep the newest scoring per event."""

    def score(df: DataFrame, batch_id: int) -> None:
        now = df.agg(F.max("time")).first()[0]
        if now is not None:
            scored = score_recent(read_silver(df.sparkSession, lake.silver), model, minutes, now)
            write_anomalies(scored, lake.anomalies, run=f"batch-{batch_id:012d}")

    return ticks.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def stream_template_drift(mined: DataFrame, cfg: DriftConfig = DriftConfig(), watermark: str = "10 minutes") -> DataFrame:
    """Drift signals per template on a stream of mined lines (``source_id, template_id, time``).

    State per template: baseline, windows folded, the first open window and the counts of the open ones. A window closes when the
    watermark passes its end, so rows may come in any order within the watermark and the signals are those of
    ``template_drift_ewma`` over the closed windows; a timer on event time closes the empty windows of silent templates.
    Rows of closed windows are late and left out, and so are rows without a time.
    """
    width_ms = int(cfg.window_minutes * 60) * 1000
    names = [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"baseline": None, "first": None, "open": {}}
        counts = {int(w): n for w, n in kept["open"].items()}
        folded, first = kept["baseline"] and tuple(kept["baseline"]), kept["first"]
        if not state.hasTimedOut:
            for pdf in frames:
                for w, n in (pdf["time"] // (width_ms * 1_000_000)).value_counts().items():
                    if first is None or w >= first:
                        counts[int(w)] = counts.get(int(w), 0) + int(n)
        begin = min(counts, default=0) if first is None else first
        end = state.getCurrentWatermarkMs() // width_ms  # windows before this one have ended
        out = []
        for w in range(begin, end):
            folded, signal = advance(folded, counts.pop(w, 0), cfg)
            if signal is not None:
                out.append((*key, w, *signal))
        first = end if end > begin else first
        state.update((json.dumps({"baseline": folded, "first": first, "open": counts}),))
        state.setTimeoutTimestamp((max(begin, end) + 1) * width_ms)
        yield pd.DataFrame(out, columns=names)

    timed = mined.filter(F.col("time").isNotNull()).select("source_id", "template_id", "time", to_timestamp(F.col("time")).alias("event_ts"))
    return timed.withWatermark("event_ts", watermark).groupBy("source_id", "template_id").applyInPandasWithState(
        run, SIGNAL_SCHEMA, "drift string", "append", GroupStateTimeout.EventTimeTimeout)


def seal_batch(raw: DataFrame, batch_id: int, lake: Lake, batch_size: int = 1000) -> None:
    """Seal one micro-batch at the end of the ledgers of its dates and sources.

    The heads of all ledgers after a batch are kept under its id. A batch starts from those of the batch before it, so a
    repeated one seals the same entries on the same heads; its time of sealing is that of its newest event.
    """
    spark, heads = raw.sparkSession, f"{lake.ledger}_heads"
    known = batch_numbers(spark, heads)
    before = max((n for n in known if n < batch_id), default=None)
    prev = None if before is None else spark.read.parquet(f"{heads}/batch={before}")
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        newest = raw.agg(F.max("ingest_time_ns")).first()[0]
        if newest is None:
            return  # nothing to seal: the heads stay with the batch before
        ledger, index = seal_batches(raw, batch_size, sealed_at_ns=newest, prev=prev)
        ledger = checkpoint(ledger)
        for frame, path in ((ledger, lake.ledger), (index, lake.index)):
            frame.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        ledger_heads(ledger, prev).write.mode("overwrite").parquet(f"{heads}/batch={batch_id}")
    finally:
        raw.unpersist()
    drop_batches(spark, heads, [n for n in known if before is not None and n < before])


def stream_seal(raw_events: DataFrame, lake: Lake, checkpoint: str, batch_size: int = 1000, trigger: dict | None = None) -> DataStreamWriter:
    """Seal every micro-batch (its trigger is the age limit, ``batch_size`` the size limit): one chain per ingest date and source over all batches."""
    writer = raw_events.writeStream.foreachBatch(lambda df, i: seal_batch(df, i, lake, batch_size))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def _placed(templates: list[list[str]], tokens: list[str], sim_th: float) -> int:
    """The template that a line of tokens joins, the most similar one, widened; a new one at the end if none is similar enough."""
    best, best_rank = -1, (sim_th, -1)
    for i, template in enumerate(templates):
        same = sum(a == b != WILD for a, b in zip(template, tokens)) / len(tokens)
        rank = (same, template.count(WILD))
        if same >= sim_th and rank > best_rank:
            best, best_rank = i, rank
    if best < 0:
        templates.append(list(tokens))
        return len(templates) - 1
    templates[best] = [a if a == b else WILD for a, b in zip(templates[best], tokens)]
    return best


def mined_stream(lines: DataFrame, depth: int = DEPTH, sim_th: float = SIMILARITY, max_children: int = MAX_CHILDREN) -> DataFrame:
    """``source_id, line, time, template_id, template`` of a stream of ``source_id, line, time``.

    The tree of each source and token count is state: nodes of leading tokens, each with at most ``max_children`` branches (the
    first tokens met; later ones share the wild branch), and the templates of each leaf. A line meets the templates
    known so far, in order of time and text, and no earlier line is read again. An id is the hash of the place where a template began, so
    it stays when the template is widened; ``template`` is its text after the batch.
    """
    levels = max(depth - 3, 0)
    tokens = template_tokens(mask_line(F.col("line")))
    keyed = lines.select("source_id", "line", "time", F.array_join(tokens, " ").alias("masked"), F.size(tokens).alias("length"))

    def mine(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree = json.loads(state.get[0]) if state.exists else {"children": {}, "leaves": {}}
        children, leaves = tree["children"], tree["leaves"]
        rows = pd.concat(list(frames)).sort_values(["time", "masked", "line"], kind="stable")
        placed, number_of = [], {}
        for masked in rows["masked"]:
            if masked not in number_of:  # equal lines of a batch share a template
                words, path = masked.split(" "), []
                for word in words[:min(levels, max(len(words) - 1, 0))]:
                    known = children.setdefault(json.dumps(path), [])
                    if word != WILD and word not in known:
                        if len(known) < max_children - 1 and not any(c.isdigit() for c in word):
                            known.append(word)
                        else:
                            word = WILD
                    path.append(word)
                leaf = json.dumps(path)
                number_of[masked] = (leaf, _placed(leaves.setdefault(leaf, []), words, sim_th))
            placed.append(number_of[masked])
        state.update((json.dumps(tree),))
        begin = f"{key[0]}\n{key[1]}"
        ids = {p: hashlib.sha256(f"{begin}\n{p[0]}\n{p[1]}".encode()).hexdigest()[:16] for p in set(placed)}
        yield pd.DataFrame({"source_id": rows["source_id"], "line": rows["line"], "time": rows["time"], "template_id": [ids[p] for p in placed], "template": [" ".join(leaves[p[0]][p[1]]) for p in placed]})

    schema = "source_id string, line string, time bigint, template_id string, template string"
    return keyed.groupBy("source_id", "length").applyInPandasWithState(mine, schema, "tree string", "append", GroupStateTimeout.NoTimeout)


def stream_templates(lines: DataFrame, lake: Lake, checkpoint: str, trigger: dict | None = None) -> DataStreamWriter:
    """Mine a stream of lines and write the counts of each micro-batch to ``templates/seen``; ``seen_templates`` reads the catalog."""

    def count(df: DataFrame, batch_id: int) -> None:
        counts = df.groupBy("source_id", "template_id", "template").agg(F.count("*").alias("count"), F.min("time").alias("first_seen_ns"), F.max("time").alias("last_seen_ns"))
        counts.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{lake.templates}/seen")

    return mined_stream(lines).writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def seen_templates(spark: SparkSession, lake: Lake) -> DataFrame:
    """``source_id, template_id, template`` (as it stands now)``, count, first_seen_ns, last_seen_ns`` over all batches."""
    seen = spark.read.parquet(f"{lake.templates}/seen").withColumn("batch", F.col("batch").cast("bigint"))
    return seen.groupBy("source_id", "template_id").agg(
        F.max_by("template", "batch").alias("template"), F.sum("count").alias("count"), F.min("first_seen_ns").alias("first_seen_ns"), F.max("last_seen_ns").alias("last_seen_ns"))
