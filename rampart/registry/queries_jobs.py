"""Evidence, template, model, drift and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.catalog import bundled
from rampart.functions import masks
from rampart.functions.times import NS
from rampart.operators import integrity as I, templates as T
from rampart.operators.drift import DriftConfig, template_drift_ewma, window_counts
from rampart.operators.features import MODEL_COLUMNS, extract_features
from rampart.operators.forest import IsolationForest
from rampart.operators.lake import stats_by_source
from rampart.operators.ordering import global_position
from rampart.plans.normalize import dead_letters, normalize
from rampart.plans.reprocess import compare_generations, compare_report, latest_generation, reprocess_report
from rampart.plans.scoring import score_features
from rampart.registry import query, views as V
from rampart.registry.queries_parse import NORMAL_SQL, raw_lines
from rampart.registry.views import BIG_SQL, EVENT_SQL, FLOW_SQL
from rampart.sources.merging import union_frames

E = f"with {EVENT_SQL}"
T0 = 1_704_067_200_000_000_000

# -- evidence --------------------------------------------------------------------------------

BRONZE_SQL = "with b as (select lpad(cast(doc_id as varchar), 12, '0') as event_uid, sha256(text) as raw_hash, source, strftime(make_timestamp(1704067200000000 + doc_id * 1000), '%Y-%m-%d') || '/' || source as ledger, doc_id, row_number() over (partition by source, strftime(make_timestamp(1704067200000000 + doc_id * 1000), '%Y-%m-%d') order by doc_id) - 1 as pos from documents)"


def _tree_sql(batch: int, levels: int) -> str:
    """Merkle levels of batches of at most 2**levels leaves, one CTE per level."""
    out = [f"l0 as (select ledger, pos // {batch} as seq, pos % {batch} as i, raw_hash as h from b)"]
    for n in range(levels):
        pair = f"sha256(unhex(x.h) || unhex(coalesce(y.h, x.h)))"
        one = f"(select count(*) from l{n} c where c.ledger = x.ledger and c.seq = x.seq) = 1"
        out.append(f"c{n} as (select ledger, seq, count(*) as m from l{n} group by all)")
        out.append(f"l{n + 1} as (select x.ledger, x.seq, x.i // 2 as i, case when c{n}.m = 1 then x.h else {pair} end as h from l{n} x left join l{n} y on x.ledger = y.ledger and x.seq = y.seq and y.i = x.i + 1 join c{n} on c{n}.ledger = x.ledger and c{n}.seq = x.seq where x.i % 2 = 0)")
    return ", ".join(out)


@query("verify_hashes", "select lpad(cast(doc_id as varchar), 12, '0') as event_uid, doc_id % 10 <> 0 as hash_ok from documents")
def _(spark, d):
    df = V.bronze(spark, d)
    damaged = df.withColumn("raw", F.when(F.substring("event_uid", -1, 1) == "0", F.concat("raw", F.unhex(F.lit("00")))).otherwise(F.col("raw")))
    return I.verify_hashes(damaged).select("event_uid", "hash_ok")


@query("global_position", "select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 as position from orders")
def _(spark, d):
    df = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return global_position(df, ["o_orderstatus"], ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("merkle_roots", f"{BRONZE_SQL}, {_tree_sql(16, 4)} select ledger, seq, h as root, (select count(*) from l0 where l0.ledger = l4.ledger and l0.seq = l4.seq) as leaf_count from l4")
def _(spark, d):
    _, index = I.seal_batches(V.bronze(spark, d), 16)
    leaves = index.join(V.bronze(spark, d), "event_uid")
    return I.merkle_roots(leaves, ["ledger", "ledger_seq"], [], positioned="leaf_index").withColumnRenamed("ledger_seq", "seq")


_LARGE_SQL = f"{FLOW_SQL}, b as (select source_type as ledger, raw_hash, row_number() over (partition by source_type order by \"time\", event_uid) - 1 as pos from flow), {_tree_sql(1 << 40, 24)}".replace(" as (select", " as materialized (select")


@query("merkle_roots_large", f"{_LARGE_SQL} select l24.ledger as source_type, h as root, n.leaf_count from l24 join (select ledger, count(*) as leaf_count from b group by 1) n on n.ledger = l24.ledger")
def _(spark, d):
    """One tree over all rows of a source, folded over many tasks."""
    return I.merkle_roots(V.flow(spark, d), ["source_type"], ["time", "event_uid"])


@query("seal_batches", f"{BRONZE_SQL}, {_tree_sql(16, 4)} select b.ledger, b.pos // 16 as seq, min(event_uid) as first_event_uid, max(event_uid) as last_event_uid, count(*) as leaf_count, max(l4.h) as batch_root from b join l4 on l4.ledger = b.ledger and l4.seq = b.pos // 16 group by 1, 2")
def _(spark, d):
    ledger, _ = I.seal_batches(V.bronze(spark, d), 16, sealed_at_ns=T0)
    return ledger.select("ledger", "seq", "first_event_uid", "last_event_uid", "leaf_count", "batch_root")


@query("ledger_chain", f"""with recursive {BRONZE_SQL.removeprefix('with ')}, {_tree_sql(16, 4)}, chain(ledger, seq, prev, chained) as (select ledger, seq, repeat('00', 32), sha256(unhex(repeat('00', 32)) || unhex(h)) from l4 where seq = 0
 union all select l4.ledger, l4.seq, chain.chained, sha256(unhex(chain.chained) || unhex(l4.h)) from l4 join chain on l4.ledger = chain.ledger and l4.seq = chain.seq + 1) select ledger, seq, prev as prev_chained_root, chained as chained_root from chain""")
def _(spark, d):
    ledger, _ = I.seal_batches(V.bronze(spark, d), 16)
    return ledger.select("ledger", "seq", "prev_chained_root", "chained_root")


@query("verify_chain", f"{BRONZE_SQL}, n as (select ledger, max(pos) // 8 + 1 as entries from b group by ledger) select ledger, entries, entries <= 3 as chain_ok, case when entries > 3 then 3 end as first_bad_seq from n")
def _(spark, d):
    ledger, _ = I.seal_batches(V.bronze(spark, d), 8)
    bad = ledger.withColumn("batch_root", F.when(F.col("seq") == 3, F.sha2("batch_root", 256)).otherwise(F.col("batch_root")))
    return I.verify_chain(bad)


@query("ledger_status", f"{BRONZE_SQL}, n as (select ledger, max(pos) // 16 + 1 as entries, count(*) as c from b group by ledger) select cast(sum(entries) as bigint) as entries, cast(sum(c) as bigint) as events_sealed, {T0} as last_sealed_at_ns, true as chain_ok from n")
def _(spark, d):
    return I.ledger_status(I.seal_batches(V.bronze(spark, d), 16, sealed_at_ns=T0)[0])


@query("locate_leaves", f"{BRONZE_SQL} select event_uid, ledger, pos // 16 as ledger_seq, pos % 16 as leaf_index from b")
def _(spark, d):
    ledger, index = I.seal_batches(V.bronze(spark, d), 16)
    return I.locate_leaves(V.bronze(spark, d).select("event_uid"), index, ledger).select("event_uid", "ledger", "ledger_seq", "leaf_index")


@query("verify_events", f"{BRONZE_SQL} select event_uid, doc_id % 10 <> 0 as hash_ok, doc_id % 10 <> 0 as proof_ok, true as chain_ok, doc_id % 10 <> 0 as verified from b")
def _(spark, d):
    df = V.bronze(spark, d)
    ledger, index = I.seal_batches(df, 16)
    damaged = df.withColumn("raw", F.when(F.substring("event_uid", -1, 1) == "0", F.concat("raw", F.unhex(F.lit("00")))).otherwise(F.col("raw")))
    return I.verify_events(damaged, index, ledger).select("event_uid", "hash_ok", "proof_ok", "chain_ok", "verified")


@query("event_proof", f"{BRONZE_SQL} select event_uid, ledger, pos // 16 as ledger_seq, true as verified, true as same_batch from b where doc_id = (select max(doc_id) from documents)")
def _(spark, d):
    df = V.bronze(spark, d)
    ledger, index = I.seal_batches(df, 16)
    uid = df.agg(F.max("event_uid")).first()[0]
    return I.event_proof(df, index, ledger, uid).select("event_uid", "ledger", "ledger_seq", "verified", F.col("batch_root").isNotNull().alias("same_batch"))


@query("lineage", f"{BRONZE_SQL} select event_uid, source as source_type, source as source_id, true as raw_verified, ledger, pos // 16 as ledger_seq from b")
def _(spark, d):
    df = V.bronze(spark, d)
    ledger, index = I.seal_batches(df, 16)
    silver = df.select("event_uid", "raw_hash", F.col("source_id").alias("source_type"))
    return I.lineage(silver, df, index, ledger).select("event_uid", "source_type", "source_id", "raw_verified", "ledger", "ledger_seq")


# -- templates -----------------------------------------------------------------------------------


@query("mask_line", f"""{E} select event_id, '<TIMESTAMP> conn <IP>:<PORT> id <UUID> via <MAC> said <QUOTED> size <BYTES> ref <HEX> n <NUM> ' || event_type as masked from e""")
def _(spark, d):
    k, u = F.col("k").cast("string"), F.lpad(F.col("user_id").cast("string"), 4, "0")
    text = F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" conn 10.0.0."), k, F.lit(":"), k, F.lit(" id 6f9619ff-8b86-d011-b42d-00c04fc9"), u, F.lit(" via 00:11:22:33:44:"), F.lpad(F.col("k").cast("string"), 2, "0"),
                    F.lit(' said "a '), k, F.lit('" size '), k, F.lit(" bytes ref 0xab"), k, F.lit(" n "), k, F.lit(" "), F.col("event_type"))
    return V.events(spark, d).select("event_id", masks.mask_line(text).alias("masked"))


@query("suggested_fields", f"{E} select event_id, case when k % 2 = 0 then 'IP,NUM' else 'NUM' end as names from e")
def _(spark, d):
    text = F.concat(F.when(F.col("k") % 2 == 0, "<IP> <NUM> <IP> ").otherwise("<NUM> "), F.col("event_type"))
    return V.events(spark, d).select("event_id", F.array_join(masks.suggested_fields(text), ",").alias("names"))


_SHAPES = ["user {u} logged in from 10.0.0.{k} port {u}", "disk sda{k} usage at {k} percent on host", "session {u} closed after {k} seconds by {t}", "link eth0 went {s} at speed {k}"]


def text_lines(spark, d):
    """Free-text lines of four shapes in turn."""
    df = V.events(spark, d)
    state = F.when(F.col("k") % 2 == 0, "up").otherwise("down")

    def render(shape: str):
        for mark, c in (("{u}", F.col("user_id")), ("{k}", F.col("k")), ("{t}", F.col("event_type")), ("{s}", state)):
            shape = [shape] if isinstance(shape, str) else shape
            shape = [y for x in shape for y in ([z for part in x.split(mark) for z in (part, c.cast("string"))][:-1] if isinstance(x, str) else [x])]
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape])

    line = F.coalesce(*[F.when(F.col("event_id") % 4 == i, render(s)) for i, s in enumerate(_SHAPES)])
    return df.select(F.col("event_id").cast("string").alias("event_uid"), line.alias("line"), (F.col("us") * 1000).alias("time"), F.concat(F.lit("dev"), F.col("user_id") % 3).alias("source_id"), "event_type", "user_id", "k")


@query("mine_templates", f"""{E} select 'dev' || (user_id % 3) as source_id, case event_id % 4 when 0 then 'user <NUM> logged in from <IP> port <NUM>' when 1 then 'disk <*> usage at <NUM> percent on host' when 2 then 'session <NUM> closed after <NUM> seconds by <*>'
 else 'link eth0 went <*> at speed <NUM>' end as template, count(*) as n from e group by all""")
def _(spark, d):
    mined = T.mine_templates(text_lines(spark, d))
    return mined.groupBy("source_id", "template").agg(F.count("*").alias("n"))


@query("template_params", f"""{E} select event_id, case event_id % 4 when 0 then user_id || '|10.0.0.' || k || '|' || user_id when 1 then 'sda' || k || '|' || k when 2 then user_id || '|' || k || '|' || event_type else case when k % 2 = 0 then 'up' else 'down' end || '|' || k end as params from e""")
def _(spark, d):
    mined = T.template_params(T.mine_templates(text_lines(spark, d)))
    return mined.select(F.col("event_uid").cast("bigint").alias("event_id"), F.array_join("params", "|").alias("params"))


_TEMPLATED = f"{E}, m as (select 'dev' || (user_id % 3) as source_id, cast(event_id % 4 as varchar) as template_id, us * 1000 as \"time\", event_type || ' ' || k as line, event_id from e)"


def templated(spark, d):
    df = V.events(spark, d)
    return df.select(F.concat(F.lit("dev"), F.col("user_id") % 3).alias("source_id"), (F.col("event_id") % 4).cast("string").alias("template_id"), (F.col("us") * 1000).alias("time"), F.lit("t <NUM>").alias("template"),
                     F.concat_ws(" ", "event_type", "k").alias("line"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_uid"))


@query("template_catalog", f"""{_TEMPLATED}, f as (select *, row_number() over (partition by source_id, template_id order by "time", event_id) as rn from m)
 select source_id, template_id, count(*) as "count", min("time") as first_seen_ns, max("time") as last_seen_ns, string_agg(line, '|' order by rn) filter (rn <= 5) as samples, 'NUM' as suggested from f group by 1, 2""")
def _(spark, d):
    out = T.template_catalog(templated(spark, d))
    return out.select("source_id", "template_id", "count", "first_seen_ns", "last_seen_ns", F.array_join("sample_lines", "|").alias("samples"), F.array_join("suggested_fields", ",").alias("suggested"))


_NOW = T0 + 25 * 86400 * NS


@query("list_templates", f"""{_TEMPLATED} select source_id, template_id, count(*) as "count" from m where source_id = 'dev1' group by 1, 2""")
def _(spark, d):
    return T.list_templates(T.template_catalog(templated(spark, d)), "dev1", "last_seen_ns").select("source_id", "template_id", "count")


@query("template_drift_lifetime", f"""{_TEMPLATED}, s as (select source_id, template_id, count(*) as n, greatest(1.0, (max("time") - min("time")) / 1e9) as life, count(*) filter ("time" >= {_NOW - 86400 * NS}) as observed from m group by 1, 2), x as (select *, n / life as base, n / life * 86400 as expected from s)
 select source_id, template_id, round(base, 6) as baseline_rate_per_s, observed as observed_in_window, round(round(expected, 4), 3) as expected_in_window, round(round((observed - expected) / sqrt(expected), 4), 3) as z_score from x""")
def _(spark, d):
    out = T.template_drift_lifetime(templated(spark, d), 86400, _NOW)
    return out.select("source_id", "template_id", "baseline_rate_per_s", "observed_in_window", F.round("expected_in_window", 3).alias("expected_in_window"), F.round("z_score", 3).alias("z_score"))


@query("template_sparkline", f"""{_TEMPLATED}, a as (select source_id, template_id, {_NOW} - "time" as age from m), c as (select source_id, template_id, {', '.join(f'count(*) filter (age <= {w * NS}{f" and age > {b * NS}" if b else ""}) / {w - b} * 60 as r{i}' for i, (b, w) in enumerate(zip([0, 900, 3600, 14400, 43200], [900, 3600, 14400, 43200, 86400])))} from a group by 1, 2)
 select source_id, template_id, {', '.join(f'round(r{4 - i}, 6) as p{i}' for i in range(5))} from c""")
def _(spark, d):
    out = T.template_sparkline(templated(spark, d), _NOW)
    return out.select("source_id", "template_id", *[F.round(F.get("rates_per_minute", F.lit(i)), 6).alias(f"p{i}") for i in range(5)])


def drift_sql(last: str, rows: str) -> str:
    """The drift of 12-hour windows up to window ``last``, an expression over ``rows``."""
    return f"""with recursive {EVENT_SQL}, m as (select 'dev' || (user_id % 3) as source_id, cast(event_id % 4 as varchar) as template_id, us * 1000 // {43200 * NS} as w from e), c as (select source_id, template_id, w, count(*) as n from m group by all),
 b as (select {last} as last from {rows}), g as (select source_id, template_id, min(w) as first from c group by 1, 2), z as (select g.source_id, g.template_id, w.w, coalesce(c.n, 0) as n, w.w - g.first as i from g, b, lateral (select unnest(range(g.first, b.last + 1)) as w) w left join c on c.source_id = g.source_id and c.template_id = g.template_id and c.w = w.w),
 r(source_id, template_id, i, w, n, before, seen, after, z) as (select source_id, template_id, i, w, n, cast(null as double), 0, n / 720.0, cast(null as double) from z where i = 0 union all
 select z.source_id, z.template_id, z.i, z.w, z.n, r.after, r.seen + 1, case when r.seen + 1 >= 3 and r.after > 0 and abs((z.n - r.after * 720) / sqrt(r.after * 720)) >= 2 then r.after else 0.3 * (z.n / 720.0) + 0.7 * r.after end, case when r.seen + 1 >= 3 and r.after > 0 then (z.n - r.after * 720) / sqrt(r.after * 720) end
 from z join r on z.source_id = r.source_id and z.template_id = r.template_id and z.i = r.i + 1)
 select source_id, template_id, w as window_index, n as observed, round(z, 4) as z_score, case when z > 0 then 'spike' else 'drop' end as direction from r where abs(z) >= 2"""


@query("template_drift_ewma", drift_sql("max(w)", "c"))
def _(spark, d):
    cfg = DriftConfig(z_threshold=2.0, window_minutes=720.0)
    out = template_drift_ewma(window_counts(templated(spark, d), 720.0), cfg)
    return out.select("source_id", "template_id", "window_index", "observed", "z_score", "direction")


@query("field_statistics", f"""{E}, v as (select 'dev' || (user_id % 3) as source_id, 0 as position, '10.0.0.' || k as value from e union all select 'dev' || (user_id % 3), 1, cast(user_id as varchar) from e union all select 'dev' || (user_id % 3), 2, case when k % 2 = 0 then 'deny' else 'Accept' end from e)
 select source_id, position, count(*) as n, count(distinct value) as "distinct", round(avg((position = 0)::int), 6) as ip, round(avg((position = 1)::int), 6) as integer, round(avg((position = 2)::int), 6) as action from v group by 1, 2""")
def _(spark, d):
    return _value_rows(spark, d, lambda v: T.field_statistics(v, ["source_id"])).select("source_id", "position", "n", "distinct", *[F.round(c, 6).alias(c) for c in ("ip", "integer", "action")])


def _value_rows(spark, d, fn):
    df = V.events(spark, d)
    values = F.array(F.concat(F.lit("10.0.0."), "k"), F.col("user_id").cast("string"), F.when(F.col("k") % 2 == 0, "deny").otherwise("Accept"))
    rows = df.select(F.concat(F.lit("dev"), F.col("user_id") % 3).alias("source_id"), F.col("us").alias("row"), F.posexplode(values).alias("position", "value"))
    return fn(rows.withColumn("mask_type", F.when(F.col("position") == 0, "IP").otherwise("*")))


@query("infer_fields", f"""{E}, s as (select distinct 'dev' || (user_id % 3) as source_id from e) select source_id, p as position, case p when 0 then 'source_ip' when 1 then 'port' else 'action' end as semantic, 1.0 as confidence from s, (select unnest([0, 1, 2]) as p)""")
def _(spark, d):
    return _value_rows(spark, d, lambda v: T.infer_fields(v, ["source_id"])).select("source_id", "position", "semantic", "confidence")


# -- models ----------------------------------------------------------------------------------------


@query("isolation_forest")
def _(spark, d):
    """Train on all flows and score them; the injected scan-like shape is in the tests."""
    features = extract_features(V.flow(spark, d), keys=["date", "source_type"])
    model = IsolationForest(contamination=0.02).fit(features, MODEL_COLUMNS)
    return score_features(features, model, T0).drop("model_trained_at")


@query("model_flag_share", "select count(*) as scored, true as share_ok, true as explained from events")
def _(spark, d):
    features = extract_features(V.flow(spark, d), keys=["date", "source_type"])
    out = score_features(features, IsolationForest(contamination=0.02, n_estimators=20).fit(features, MODEL_COLUMNS), T0)
    share = F.abs(F.avg(F.col("is_anomaly").cast("int")) - 0.02) < 0.005
    explained = F.bool_and((F.length("explanation_json") > 2) == F.col("is_anomaly"))
    return out.agg(F.count("*").alias("scored"), share.alias("share_ok"), explained.alias("explained"))


# -- history -----------------------------------------------------------------------------------------


def generations(spark, d):
    """Two stored generations of the flows: the original, and for even events a reprocessed one."""
    first = V.flow(spark, d).withColumn("metadata.log_version", F.lit(None).cast("string"))
    later = first.filter(F.col("event_uid").cast("bigint") % 2 == 0)
    again = later.withColumns({"metadata.log_version": F.lit("1.0+reprocess-20240101T000000Z-aa"), "severity_id": F.lit(9).cast("bigint")})
    newest = later.filter(F.col("event_uid").cast("bigint") % 4 == 0).withColumns({"metadata.log_version": F.lit("0.9+reprocess-20240201T000000Z-bb"), "severity_id": F.lit(10).cast("bigint")})
    return first.unionByName(again).unionByName(newest)


@query("latest_generation", f"{FLOW_SQL} select event_uid, case when cast(event_uid as bigint) % 4 = 0 then 10 when cast(event_uid as bigint) % 2 = 0 then 9 else severity_id end as severity_id from flow")
def _(spark, d):
    return latest_generation(generations(spark, d)).select("event_uid", "severity_id")


_COMPARED = f"{FLOW_SQL}, x as (select event_uid, cast(event_uid as bigint) as id, severity_id from flow), o as (select event_uid, case when id % 10 = 9 then 'no_previous' when case when id % 4 = 0 then 10 when id % 2 = 0 then 9 else severity_id end = severity_id then 'unchanged' else 'changed' end as outcome from x)"


@query("compare_generations", f"{_COMPARED} select event_uid, outcome from o")
def _(spark, d):
    old = generations(spark, d).filter(F.col("event_uid").cast("bigint") % 10 != 9)
    return compare_generations(V.flow(spark, d), old).select("event_uid", "outcome")


@query("compare_report", f"{_COMPARED} select count(*) filter (outcome = 'no_previous') as no_previous, count(*) filter (outcome = 'changed') as changed, count(*) filter (outcome = 'unchanged') as unchanged from o")
def _(spark, d):
    old = generations(spark, d).filter(F.col("event_uid").cast("bigint") % 10 != 9)
    return compare_report(compare_generations(V.flow(spark, d), old)).select("no_previous", "changed", "unchanged")


@query("reprocess_report", f"""{NORMAL_SQL} select count(*) as in_scope, count(*) filter (status <> 'dead') as normalized, count(*) filter (status = 'dead') as dead_lettered, count(distinct case when status <> 'dead' then strftime(make_timestamp("time" // 1000), '%Y-%m-%d') end) as dates from n""")
def _(spark, d):
    out = reprocess_report(normalize(raw_lines(spark, d), bundled(), run_tag="reprocess-x"))
    return out.select("in_scope", "normalized", "dead_lettered", F.size("silver_dates").cast("bigint").alias("dates"))


@query("normalize_dead_letters", f"{NORMAL_SQL} select event_uid, 'invalid_ip' as reason, 'normalize' as stage, 'aws_vpc_flow' as source_type, 'src_endpoint.ip' as target, '-' as value from n where status = 'dead'")
def _(spark, d):
    out = dead_letters(normalize(raw_lines(spark, d), bundled()))
    at = lambda p: F.get_json_object("detail", p)
    return out.select("event_uid", "reason", "stage", at("$.source_type").alias("source_type"), at("$.target").alias("target"), at("$.value").alias("value"))


@query("union_frames", """select cast(o_orderkey as double) as id, cast(o_custkey as varchar) as mixed, o_orderstatus as only_orders, null as only_lines from orders union all select l_quantity, '"' || l_returnflag || '"', null, l_linestatus from lineitem""")
def _(spark, d):
    a = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("mixed"), F.col("o_orderstatus").alias("only_orders"))
    b = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("id"), F.col("l_returnflag").alias("mixed"), F.col("l_linestatus").alias("only_lines"))
    return union_frames([a, b])


@query("stats_by_source_big", f"""{BIG_SQL} select source_type, count(*) as events, min("time") as first_time_ns, max("time") as last_time_ns, cast(sum(bytes_in + bytes_out) as bigint) as total_bytes, count(distinct src_ip) as distinct_src_ip from big group by 1""")
def _(spark, d):
    return stats_by_source(V.flow_big(spark, d))
