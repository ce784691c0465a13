"""Mining templates from free-text lines, the template catalog, rates and field inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rampart.functions.ip import is_ip
from rampart.functions.masks import mask_line, suggested_fields
from rampart.functions.text import strip
from rampart.functions.times import NS, parse_ts_ns
from rampart.session import broadcast_if_small, checkpoint

WILD = "<*>"
DEPTH, SIMILARITY, MAX_CHILDREN = 5, 0.45, 100
SAMPLES = 5


def template_tokens(c: Column) -> Column:
    """Tokens of a masked line."""
    return F.split(F.regexp_replace(strip(c), r"\s+", " "), " ")


def _lead(tokens: Column, i: int, count: Column) -> Column:
    """Leading token ``i`` as a tree key; tokens with digits and positions past the tree are wild."""
    token = F.get(tokens, F.lit(i))
    return F.when((count > i + 1) & ~token.rlike("[0-9]"), token).otherwise(WILD)


def _limit_children(df: DataFrame, parents: list[str], key: str, children: int) -> DataFrame:
    """Keep the ``children - 1`` commonest tokens of a tree node; further ones share the wild branch."""
    counts = df.filter(F.col(key) != WILD).groupBy(*parents, key).agg(F.sum("n").alias("_c"))
    w = Window.partitionBy(*parents).orderBy(F.desc("_c"), key)
    kept = counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") < children).select(*parents, key, F.lit(True).alias("_kept"))
    out = df.join(broadcast_if_small(kept), [*parents, key], "left")
    return out.withColumn(key, F.when(F.col("_kept"), F.col(key)).otherwise(WILD)).drop("_kept")


class _Bucket:
    """The templates of one bucket, all of one token count, as rows of token numbers; number 0 is the wild one."""

    def __init__(self, length: int, sim_th: float):
        self.sim_th, self.length = sim_th, length
        self.names, self.numbers = [WILD], {WILD: 0}
        self.rows, self.used = np.zeros((16, length), dtype=np.int32), 0

    def add(self, tokens: list[str]) -> int:
        """The template that a line joins: the most similar one at or above the threshold, widened, else a new one."""
        codes = np.array([self.numbers.get(t, -1) for t in tokens], dtype=np.int32)
        held = self.rows[:self.used]
        same = ((held == codes) & (held != 0)).sum(axis=1)
        best = int(same.max(initial=-1))
        if best >= 0 and best / self.length >= self.sim_th:
            near = np.flatnonzero(same == best)
            found = int(near[np.argmax((held[near] == 0).sum(axis=1))])
            held[found][held[found] != codes] = 0
            return found
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for t in tokens:
            if t not in self.numbers:
                self.numbers[t] = len(self.names)
                self.names.append(t)
        self.rows[self.used] = [self.numbers[t] for t in tokens]
        self.used += 1
        return self.used - 1

    def templates(self) -> list[str]:
        return [" ".join(self.names[c] for c in row) for row in self.rows[:self.used]]


def _greedy(sim_th: float):
    """Merge the lines of each bucket in the order they come; one row per line with the number of its template, and, after
    a bucket's last line, one per template. Only templates are held, never a bucket's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                out.extend((current, None, i, t) for i, t in enumerate(state.templates()))

        def rows() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int32(), pa.string())
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "text", "number", "template"])

        for batch in batches:
            for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = text.split(" ")
                if state is None or bucket != current:
                    close()
                    current, state = bucket, _Bucket(len(tokens), sim_th)
                out.append((bucket, text, state.add(tokens), None))
            yield rows()
        close()
        yield rows()

    return run


def cluster_lines(lines: DataFrame, sim_th: float = SIMILARITY) -> DataFrame:
    """``bucket, text, template`` for distinct ``bucket, text, first_ns`` rows; the lines of a bucket have one token count.

    Every bucket, of whatever size, takes one pass in order of appearance, since each line depends on the
    templates before it. A bucket is one task, which streams its lines.
    """
    ordered = lines.select("bucket", "text", "first_ns").repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_last("first_ns"), "text")
    both = checkpoint(ordered.select("bucket", "text").mapInArrow(_greedy(sim_th), "bucket string, text string, number int, template string"))
    templates = both.filter("template is not null").select("bucket", "number", "template")
    return both.filter("text is not null").select("bucket", "text", "number").join(broadcast_if_small(templates), ["bucket", "number"]).select("bucket", "text", "template")


def mine_templates(df: DataFrame, line: str = "line", depth: int = DEPTH, sim_th: float = SIMILARITY, max_children: int = MAX_CHILDREN) -> DataFrame:
    """Add ``template`` and ``template_id`` to lines with ``source_id`` and ``time``.

    Only distinct masked lines with their counts are clustered, in buckets of source, token count
    and leading tokens; ids are a hash of source and final template.
    """
    masked = df.withColumn("_masked", F.array_join(template_tokens(mask_line(F.col(line))), " "))
    # everything below reads the distinct masked lines several times; the raw lines are masked once for it
    distinct = checkpoint(masked.groupBy("source_id", "_masked").agg(F.count("*").alias("n"), F.min("time").alias("first_ns")))
    tokens = F.split("_masked", " ")
    tree = distinct.withColumn("_len", F.size(tokens))
    parents = ["source_id", "_len"]
    for i in range(max(depth - 3, 0)):
        tree = tree.withColumn(f"_t{i}", _lead(tokens, i, F.col("_len")))
        tree = _limit_children(tree, parents, f"_t{i}", max_children)
        parents.append(f"_t{i}")
    tree = tree.withColumn("bucket", F.sha2(F.to_json(F.struct(*parents)), 256))
    found = cluster_lines(tree.select("bucket", F.col("_masked").alias("text"), "first_ns"), sim_th)
    found = found.join(tree.select("bucket", "source_id", F.col("_masked").alias("text")), ["bucket", "text"])
    names = found.select("source_id", F.col("text").alias("_masked"), "template",
                         F.substring(F.sha2(F.concat_ws("\n", "source_id", "template"), 256), 1, 16).alias("template_id"))
    return masked.join(broadcast_if_small(names), ["source_id", "_masked"], "left").drop("_masked")


def template_params(df: DataFrame, line: str = "line", template: str = "template") -> DataFrame:
    """Add ``params``: the text at each ``<..>`` of the row's template, empty when the line does not fit."""
    pieces = F.split(F.col(template), "<[^>]*>", -1)
    literal = lambda p: F.concat(F.lit(r"\Q"), F.replace(F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"^\s*"), F.array_join(F.transform(pieces, literal), "(.+?)"), F.lit(r"\s*$"))
    holes = F.size(pieces) - 1
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(holes, F.lit(1))), lambda i: F.concat(F.lit("$"), i.cast("string"))), "\u0001")
    fits = F.regexp_like(F.col(line), pattern)
    values = F.split(F.regexp_replace(F.col(line), pattern, refs), "\u0001", -1)
    return df.withColumn("params", F.when(fits & (holes > 0), values).otherwise(F.array().cast("array<string>")))


def template_catalog(df: DataFrame, line: str = "line") -> DataFrame:
    """Each template with count, first and last time, its first five lines and mask names."""
    keys = ["source_id", "template_id"]
    stats = df.groupBy(*keys).agg(F.count("*").alias("count"), F.min("time").alias("first_seen_ns"), F.max("time").alias("last_seen_ns"),
                                  F.max_by("template", F.struct("time", "template")).alias("template"))
    tie = [F.col(c) for c in ("event_uid",) if c in df.columns]
    first = Window.partitionBy(*keys).orderBy("time", *tie, line)
    samples = df.select(*keys, "time", *tie, line).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= SAMPLES)
    samples = samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line))), lambda x: x[line]).alias("sample_lines"))
    return stats.join(samples, keys).withColumn("suggested_fields", suggested_fields(F.col("template")))


def list_templates(catalog: DataFrame, source_id: str | None = None, order_by: str = "count") -> DataFrame:
    if order_by not in ("count", "first_seen_ns", "last_seen_ns", "template_id"):
        raise ValueError(f"cannot order templates by {order_by!r}")
    out = catalog.filter(F.col("source_id") == source_id) if source_id is not None else catalog
    first = F.col(order_by) if order_by == "template_id" else F.desc(order_by)
    return out.orderBy(first, "source_id", "template_id")


# -- rates -----------------------------------------------------------------------------------


def template_drift_lifetime(df: DataFrame, window_seconds: int, now_ns: int) -> DataFrame:
    """Rate in the current window against the template's lifetime rate, with a Poisson z."""
    start = now_ns - window_seconds * NS
    stats = df.groupBy("source_id", "template_id").agg(
        F.count("*").alias("_n"), ((F.max("time") - F.min("time")) / NS).alias("_life"), F.count_if(F.col("time") >= start).alias("observed_in_window"),
    )
    base = F.col("_n") / F.greatest(F.lit(1.0), F.col("_life"))
    expected = base * window_seconds
    z = F.when(expected > 0, (F.col("observed_in_window") - expected) / F.sqrt(expected))
    out = stats.select(
        "source_id", "template_id", F.lit(window_seconds).alias("window_seconds"), F.round(base, 6).alias("baseline_rate_per_s"),
        F.round(F.col("observed_in_window") / window_seconds, 6).alias("current_rate_per_s"), "observed_in_window",
        F.round(expected, 4).alias("expected_in_window"), F.round(z, 4).alias("z_score"),
    )
    return out.orderBy(F.abs("z_score").desc_nulls_last(), "source_id", "template_id")


SPARKLINE_SECONDS = [900, 3600, 14_400, 43_200, 86_400]


def template_sparkline(df: DataFrame, now_ns: int, windows: list[int] | None = None) -> DataFrame:
    """Events per minute of each template between nested look-back windows, oldest first."""
    windows = windows or SPARKLINE_SECONDS
    rates, before = [], 0
    for width in windows:
        age = F.lit(now_ns) - F.col("time")
        hits = F.count_if((age <= width * NS) & ((age > before * NS) if before else F.lit(True)))
        rates.append(hits / F.lit(max(1, width - before)) * 60)
        before = width
    return df.groupBy("source_id", "template_id").agg(F.array(*reversed(rates)).alias("rates_per_minute"))


# -- field inference ---------------------------------------------------------------------------

# IANA protocol numbers and action words.
IANA_PROTOCOLS = [1, 2, 4, 6, 17, 41, 47, 50, 51, 58, 88, 89, 103, 112, 115, 132]
ACTION_WORDS = ["allow", "allowed", "deny", "denied", "accept", "accepted", "drop", "dropped", "block", "blocked",
                "permit", "permitted", "reject", "rejected", "pass", "passed"]
FLOORS = {"ip": 0.75, "protocol": 0.9, "action": 0.75, "timestamp": 0.7, "port": 0.7, "bytes": 0.9, "interface": 0.6}


def _rising_share(numbers: DataFrame, group: list[str]) -> DataFrame:
    """``monotone``: the share of changing steps between neighbouring rows of a group that go up.

    Rows are range-partitioned by (group, row); steps are taken inside each partition, and the one step
    across each border from the partitions' end values, so a hot group spans many tasks.
    """
    n = max(int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    fixed = checkpoint(numbers.repartitionByRange(n, *group, "row").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_p").orderBy("row")
    steps = fixed.select(*group, "_num", F.lag("_num").over(inside).alias("_prev"))
    ends = fixed.groupBy(*group, "_p").agg(F.min_by("_num", "row").alias("_num"), F.max_by("_num", "row").alias("_last"))
    borders = ends.select(*group, "_num", F.lag("_last").over(Window.partitionBy(*group).orderBy("_p")).alias("_prev"))
    return steps.unionByName(borders).filter(F.col("_num") != F.col("_prev")).groupBy(*group).agg(F.avg((F.col("_num") > F.col("_prev")).cast("double")).alias("monotone"))


def field_statistics(values: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics per (keys, ``position``) of parameter values in ``value`` with ``mask_type``.

    ``row`` orders the samples for the share of rising steps.
    """
    v = strip(F.col("value"))
    number = F.when(v.rlike(r"^[0-9]+\z"), v.try_cast("decimal(38,0)"))
    flagged = values.filter(F.coalesce(v, F.lit("")) != "").withColumns({
        "_num": number,
        "_ip": F.coalesce(is_ip(v) & v.rlike("[.:]"), F.lit(False)),
        "_port": F.coalesce(number.between(0, 65535), F.lit(False)),
        "_proto": F.coalesce(number.isin(IANA_PROTOCOLS), F.lit(False)),
        "_action": F.coalesce(F.lower(F.btrim(v, F.lit("\"'"))).isin(ACTION_WORDS), F.lit(False)),
        "_ts": parse_ts_ns(v).isNotNull(),
    })
    rise = _rising_share(flagged.filter(F.col("_num").isNotNull()).select(*keys, "position", "row", "_num"), [*keys, "position"])
    share = lambda c: F.avg(F.col(c).cast("double"))
    loose_ts = F.avg((F.col("_ts") & F.col("_num").isNull()).cast("double"))
    firsts = flagged.groupBy(*keys, "position", "value").agg(F.min("row").alias("row"))
    rank = Window.partitionBy(*keys, "position").orderBy("row")
    examples = firsts.withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= 5).groupBy(*keys, "position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda x: x["value"]).alias("example_values"))
    stats = flagged.groupBy(*keys, "position").agg(
        F.first("mask_type").alias("mask_type"), F.count("*").alias("n"), F.countDistinct("value").alias("distinct"),
        share("_ip").alias("ip"), F.avg(F.col("_num").isNotNull().cast("double")).alias("integer"), share("_port").alias("port"),
        share("_proto").alias("protocol"), F.countDistinct("_num").alias("distinct_numbers"), F.min("_proto").alias("_all_proto"),
        F.count("_num").alias("numbers"), F.bool_and(F.col("_num").isNull() | F.col("_proto")).alias("only_protocols"),
        share("_action").alias("action"), share("_ts").alias("timestamp"), loose_ts.alias("timestamp_text"), F.max("_num").alias("largest"),
    ).drop("_all_proto")
    return stats.join(rise, [*keys, "position"], "left").join(examples, [*keys, "position"], "left").withColumn("monotone", F.coalesce("monotone", F.lit(0.0)))


def infer_fields(values: DataFrame, keys: list[str], preceding: str | None = None) -> DataFrame:
    """``semantic`` and ``confidence`` of each position from its statistics and neighbours.

    ``preceding`` names a column of the input with the literal text before the position.
    """
    stats = field_statistics(values, keys)
    if preceding is not None:
        stats = stats.join(values.groupBy(*keys, "position").agg(F.first(preceding).alias("_before")), [*keys, "position"])
    mask = F.upper("mask_type")
    ts_share = F.when(mask == "TIMESTAMP", F.col("timestamp")).otherwise(F.col("timestamp_text"))
    proto_ok = (F.col("integer") >= 0.95) & (F.col("numbers") > 0) & F.col("only_protocols") & (F.col("distinct_numbers") <= 4) & (F.col("protocol") >= FLOORS["protocol"])
    proto_conf = F.col("protocol") * F.when(F.col("distinct_numbers") <= 2, 1.0).otherwise(0.85)
    claim = lambda name, conf: F.struct(F.lit(name).alias("s"), conf.cast("double").alias("c"))
    primary = (
        F.when(F.col("ip") >= FLOORS["ip"], claim("ip_address", F.col("ip")))
        .when(proto_ok, claim("protocol", proto_conf))
        .when((F.col("action") >= FLOORS["action"]) & (F.col("distinct") <= 8), claim("action", F.col("action")))
        .when(mask == "TIMESTAMP", claim("timestamp", F.greatest(ts_share, F.lit(0.5))))
        .when(ts_share >= FLOORS["timestamp"], claim("timestamp", ts_share))
    )
    out = stats.withColumn("_p", primary)
    near = Window.partitionBy(*keys).orderBy("position")  # the positions of one template, a few dozen
    forced = mask == "PORT"
    eligible = F.col("_p").isNull() & (F.col("port") >= F.when(forced, 0.5).otherwise(FLOORS["port"]))
    # runs of eligible positions that touch an address (or a forced port) are ports
    out = out.withColumn("_e", eligible).withColumn("_seed", (F.col("_p.s") == "ip_address") | (eligible & forced))
    out = out.withColumn("_seed", F.coalesce("_seed", F.lit(False)))
    breaks = F.sum((~(F.col("_e") | F.col("_seed"))).cast("int"))
    out = out.withColumn("_run", breaks.over(near.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*keys, "_run")
    out = out.withColumn("_touch", F.max(F.col("_seed") & (F.col("_e") | F.col("_seed"))).over(chain))
    port_conf = F.when(forced, F.greatest("port", F.lit(0.5))).otherwise(F.col("port"))
    out = out.withColumn("_p", F.when(F.col("_e") & (forced | F.col("_touch")), claim("port", port_conf)).otherwise(F.col("_p")))
    varied = F.col("distinct_numbers") >= F.greatest(F.lit(3.0), F.col("numbers") * 0.5)
    sizes = F.when(mask == "BYTES", F.col("distinct_numbers") >= 2).otherwise(varied & (F.col("largest") >= 1000))
    bytes_conf = F.col("integer") * (F.lit(0.7) + F.lit(0.3) * F.col("monotone"))
    out = out.withColumn("_p", F.when(F.col("_p").isNull() & (F.col("integer") >= FLOORS["bytes"]) & sizes, claim("byte_count", bytes_conf)).otherwise(F.col("_p")))
    if preceding is not None:
        before = F.lower(F.substring(F.col("_before"), -24, 24))
        named = before.rlike("interface|intf|iface") | before.rlike(r"\bport\b")
        words = (1 - F.col("integer") >= 0.8) & (F.col("distinct") <= 10)
        conf = (1 - F.col("integer")) * F.when(F.col("distinct") <= 6, 1.0).otherwise(0.7)
        out = out.withColumn("_p", F.when(F.col("_p").isNull() & named & words, claim("interface_name", conf)).otherwise(F.col("_p")))
    role = F.sum((F.col("_p.s") == "ip_address").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0))
    semantic = F.when(F.col("_p.s") == "ip_address", F.when(role == 1, "source_ip").when(role == 2, "destination_ip").otherwise("ip_address")).otherwise(F.coalesce("_p.s", F.lit("unknown")))
    miss = 1 - F.greatest("ip", "action", "port", "timestamp_text", "integer")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_p.c", miss))), 2)
    return out.select(*keys, "position", "mask_type", semantic.alias("semantic"), confidence.alias("confidence"), "example_values", "n")


def params_long(df: DataFrame, keys: list[str], row: str = "time") -> DataFrame:
    """One row per parameter of mined lines: ``keys, row, position, value, mask_type, before``."""
    marks = F.regexp_extract_all("template", F.lit("<([^>]*)>"), F.lit(1))
    texts = F.split("template", "<[^>]*>", -1)
    fits = df.filter(F.size("params") > 0).select(*keys, F.col(row).alias("row"), marks.alias("_m"), texts.alias("_x"), F.posexplode("params").alias("position", "value"))
    return fits.select(*keys, "row", "position", "value", F.get("_m", F.col("position")).alias("mask_type"), F.get("_x", F.col("position")).alias("before"))


def majority_format(df: DataFrame) -> DataFrame:
    """The (outer, inner) format most lines of each source have; ties go to the smaller name."""
    votes = df.groupBy("source_id", "outer_format", "inner_format").agg(F.count("*").alias("votes"))
    best = votes.groupBy("source_id").agg(F.max("votes").alias("votes"))
    return votes.join(best, ["source_id", "votes"]).groupBy("source_id", "votes").agg(F.min(F.struct("outer_format", "inner_format")).alias("_f")).select(
        "source_id", F.col("_f.outer_format"), F.col("_f.inner_format"), "votes")


def common_keys(df: DataFrame, min_presence: float = 0.5, row: str = "row", fields: str = "fields") -> DataFrame:
    """Keys present in at least ``min_presence`` of the rows, in order of first appearance."""
    total = df.agg(F.count("*").alias("_total"))
    seen = df.select(F.col(row).alias("_row"), F.posexplode(F.map_keys(fields)).alias("_at", "key"))
    stats = seen.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct("_row", "_at")).alias("_first"))
    kept = stats.crossJoin(F.broadcast(total)).filter(F.col("rows") >= F.col("_total") * min_presence)
    return kept.orderBy("_first").select("key", "rows", (F.col("rows") / F.col("_total")).alias("presence"))
