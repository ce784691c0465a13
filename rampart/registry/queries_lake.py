"""Lake, feature and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions import ip as ipf
from rampart.functions.times import NS, event_date
from rampart.operators import anomalies, crosswalk, dead_letters, enrich, features, flatten, forest, lake, lookups
from rampart.operators.ordering import order_statistics
from rampart.registry import query, views as V
from rampart.registry.views import BIG_SQL, DEAD_SQL, FLOW_SQL, IOC_ROWS, SCORE_SQL, ZONES, values_sql

CORE = "event_uid, \"time\", source_type, src_ip, dst_ip, src_port, dst_port, action_id, bytes_in, bytes_out"
CORE_COLUMNS = ["event_uid", "time", "source_type", "src_ip", "dst_ip", "src_port", "dst_port", "action_id", "bytes_in", "bytes_out"]
T0 = 1_704_067_200_000_000_000  # 2024-01-01


@query("stats_by_source", f"""{FLOW_SQL} select source_type, count(*) as events, min("time") as first_time_ns, max("time") as last_time_ns,
 cast(sum(coalesce(bytes_in, 0) + coalesce(bytes_out, 0)) as bigint) as total_bytes, count(distinct src_ip) as distinct_src_ip from flow group by source_type""")
def _(spark, d):
    return lake.stats_by_source(V.flow(spark, d))


@query("counts_by_class", f"{FLOW_SQL} select class_uid, count(*) as events from flow group by class_uid")
def _(spark, d):
    return lake.counts_by_class(V.flow(spark, d))


@query("counts_by_action", f"{FLOW_SQL} select action_id, count(*) as events from flow group by action_id")
def _(spark, d):
    return lake.counts_by_action(V.flow(spark, d))


@query("summary", f"""{DEAD_SQL}, t as (select (select count(*) from events) as n, (select count(*) from dead) as d)
 select n as total_events, d as dlq_total, round(d / (n + d), 4) as dlq_rate from t""")
def _(spark, d):
    return lake.summary(V.flow(spark, d), V.dead(spark, d))


@query("timeseries", f"""{FLOW_SQL}, s as (select time_bucket(interval 6 hours, make_timestamp("time" // 1000)) as b, source_type from flow)
 select strftime(b, '%Y-%m-%dT%H:%M:%S') as bucket, source_type, count(*) as events from s where b >= (select max(b) from s) - interval 7 days group by b, source_type""")
def _(spark, d):
    return lake.timeseries(V.flow(spark, d), "6 hours", "7 days")


@query("timeseries_week", f"""{FLOW_SQL}, s as (select time_bucket(interval 1 week, make_timestamp("time" // 1000)) as b, source_type from flow)
 select strftime(b, '%Y-%m-%dT%H:%M:%S') as bucket, source_type, count(*) as events from s where b >= (select max(b) from s) - interval 4 weeks group by b, source_type""")
def _(spark, d):
    return lake.timeseries(V.flow(spark, d), "1w", "4w")


_SOURCES = ["src_click", "src_error", "src_purchase", "src_signup", "src_view"]


@query("timeseries_pivot", f"""{FLOW_SQL}, s as (select time_bucket(interval 1 day, make_timestamp("time" // 1000)) as b, source_type from flow)
 select strftime(b, '%Y-%m-%dT%H:%M:%S') as bucket, strftime(b, '%H:%M') as label, {', '.join(f"count(*) filter (source_type = '{s}') / 86400 as {s}" for s in _SOURCES)}
 from s where b >= (select max(b) from s) - interval 30 days group by b""")
def _(spark, d):
    points = lake.timeseries(V.flow(spark, d), "1d", "30d")
    return lake.timeseries_pivot(points, _SOURCES, 86_400)


@query("search", f"""{FLOW_SQL} select {CORE} from flow where source_type = 'src_error' and dst_port = 22 and "time" >= {T0 + 5 * 86400 * NS} and "time" <= {T0 + 20 * 86400 * NS}""")
def _(spark, d):
    found = lake.search(V.flow(spark, d), {"source_type": "src_error", "dst_port": 22, "since_ns": T0 + 5 * 86400 * NS, "until_ns": T0 + 20 * 86400 * NS})
    return found.select(*CORE_COLUMNS)


@query("filter_events", f"""{FLOW_SQL} select {CORE} from flow where action_id = 1 and (src_port = 4444 or dst_port = 4444)
 and (unmapped_json ilike '%k": 5%' or src_ip ilike '%k": 5%' or dst_ip ilike '%k": 5%')""")
def _(spark, d):
    return lake.filter_events(V.flow(spark, d), action_id=1, port=4444, q='K": 5').select(*CORE_COLUMNS)


@query("recent_events", f'{FLOW_SQL} select {CORE} from flow order by "time" desc nulls last, event_uid limit 250')
def _(spark, d):
    return lake.recent_events(V.flow(spark, d), 250).select(*CORE_COLUMNS)


@query("by_source", f"{FLOW_SQL} select {CORE} from flow where source_type = 'src_view' order by \"time\" desc nulls last, event_uid limit 100")
def _(spark, d):
    return lake.by_source(V.flow(spark, d), "src_view", 100).select(*CORE_COLUMNS)


@query("page", f"{FLOW_SQL} select {CORE}, (select count(*) from flow) as total from flow order by \"time\" desc nulls last, event_uid limit 50 offset 100")
def _(spark, d):
    rows, total = lake.page(V.flow(spark, d), 3, 50)
    return rows.select(*CORE_COLUMNS, F.lit(total).cast("bigint").alias("total"))


@query("page_after", f"{FLOW_SQL} select {CORE} from flow order by \"time\" desc nulls last, event_uid limit 50 offset 100")
def _(spark, d):
    """The third page, by the cursors of the first two."""
    flow, cursor = V.flow(spark, d), None
    for _ in range(2):
        cursor = lake.cursor_of(lake.page_after(flow, cursor, 50))
    return lake.page_after(flow, cursor, 50).select(*CORE_COLUMNS)


@query("recent_per_source", f"{FLOW_SQL} select {CORE} from flow qualify row_number() over (partition by source_type order by \"time\" desc nulls last, event_uid) <= 20")
def _(spark, d):
    return lake.recent_per_source(V.flow(spark, d), 20).select(*CORE_COLUMNS)


@query("silver_between", f"{FLOW_SQL} select date, source_type, count(*) as n from flow where date between '2024-01-03' and '2024-01-12' and source_type in ('src_view', 'src_error') group by date, source_type")
def _(spark, d):
    rows = lake.silver_between(V.flow(spark, d), "2024-01-03", "2024-01-12", ["src_view", "src_error"])
    return rows.groupBy("date", "source_type").agg(F.count("*").alias("n"))


@query("recent_window", f"{FLOW_SQL} select {CORE} from flow where \"time\" between {T0 + 86400 * NS - 90 * 60 * NS} and {T0 + 86400 * NS}")
def _(spark, d):
    return lake.recent_window(V.flow(spark, d), 90, T0 + 86400 * NS).select(*CORE_COLUMNS)


@query("lake_sql", f"{FLOW_SQL} select dst_port, count(*) as n, max(bytes_out) as most from flow where action_id = 2 group by dst_port")
def _(spark, d):
    sql = "select dst_port, count(*) as n, max(bytes_out) as most from events where action_id = :action group by dst_port"
    return lake.lake_sql(spark, sql, {"events": V.flow(spark, d)}, {"action": 2})


@query("event_date", """select strftime(o_orderdate, '%Y-%m-%d') as date, count(*) as n from orders group by 1""")
def _(spark, d):
    orders = V.table(spark, d, "orders")
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    return orders.select(event_date(F.lit(0).cast("bigint"), ns).alias("date")).groupBy("date").agg(F.count("*").alias("n"))


# -- features -------------------------------------------------------------------------

_PORT = "coalesce(greatest(dst_port, 0), 0)"
_PRIV_DST = "case when dst_ip like '8.8.%' then 0 else 1 end"
_PER_EVENT = f"""event_uid, src_ip, "time", coalesce(bytes_in, 0) as bytes_in, coalesce(bytes_out, 0) as bytes_out,
 round(coalesce(bytes_out, 0) / (coalesce(bytes_in, 0) + 1.0), 6) as bytes_ratio, 0 as packets, 0.0 as duration, dst_port,
 case when dst_port between 1 and 1023 then 1 else 0 end as is_well_known_port, case when dst_port >= 49152 then 1 else 0 end as is_ephemeral_port,
 case protocol when 'tcp' then 6 when 'udp' then 17 else 1 end as protocol_num, action_id, severity_id,
 extract(hour from make_timestamp("time" // 1000)) as hour_of_day, (extract(isodow from make_timestamp("time" // 1000)) - 1) as day_of_week,
 1 as is_private_src, {_PRIV_DST} as is_private_dst, case when {_PRIV_DST} = 1 then 3 else 2 end as direction_id"""
_WINDOWED = """count(*) as connection_count, count(distinct dst_ip) as distinct_dst_ips, count(distinct dst_port) as distinct_dst_ports,
 round(avg(case when action_id = 2 then 1.0 else 0.0 end), 6) as deny_ratio, cast(sum(coalesce(bytes_out, 0)) as bigint) as total_bytes_out,
 round(avg(coalesce(bytes_in, 0) + coalesce(bytes_out, 0)), 6) as mean_bytes_per_conn, count(distinct protocol) as distinct_protocols"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("per_event_features", f"{FLOW_SQL} select {_PER_EVENT} from flow")
def _(spark, d):
    return _rounded(features.per_event_features(V.flow(spark, d)), "bytes_ratio")


@query("windowed_source_features", f"""{FLOW_SQL} select src_ip, "time" - "time" % {3600 * NS} as window_start, {_WINDOWED} from flow group by all""")
def _(spark, d):
    return _rounded(features.windowed_source_features(V.flow(spark, d), "1h"), "deny_ratio", "mean_bytes_per_conn")


@query("windowed_source_features_big", f"""{BIG_SQL} select src_ip, "time" - "time" % {300 * NS} as window_start, {_WINDOWED} from big group by all""")
def _(spark, d):
    return _rounded(features.windowed_source_features(V.flow_big(spark, d)), "deny_ratio", "mean_bytes_per_conn")


_WIN = features.WINDOWED


@query("extract_features", f"""{FLOW_SQL}, w as (select date, source_type, src_ip, "time" - "time" % {86400 * NS} as ws, {_WINDOWED} from flow group by all)
 select p.*, {', '.join(f'w.{n} as win_{n}' for n in _WIN)} from (select source_type, date, {_PER_EVENT} from flow) p
 join w on p.date = w.date and p.source_type = w.source_type and p.src_ip = w.src_ip and p."time" - p."time" % {86400 * NS} = w.ws""")
def _(spark, d):
    out = features.extract_features(V.flow(spark, d), "1d", keys=["date", "source_type"])
    return _rounded(out, "bytes_ratio", "win_deny_ratio", "win_mean_bytes_per_conn")


@query("load_feature_columns", f"""{FLOW_SQL} select event_uid, "time", src_ip, dst_ip, dst_port, protocol, action_id, severity_id, bytes_in, bytes_out,
 cast(null as double) as duration, cast(null as bigint) as packets from flow where date = '2024-01-05' and source_type = 'src_click'""")
def _(spark, d):
    out = features.load_feature_columns(V.flow(spark, d), "2024-01-05", "src_click")
    return out.withColumnRenamed("traffic.packets", "packets").drop("source_type", "date", "connection_info.protocol_num", "connection_info.direction_id", "traffic.packets_in", "traffic.packets_out")


_GRID = 500


@query("feature_distributions", f"""{FLOW_SQL}, v as (select 'bytes_in' as feature, cast(bytes_in as double) as value from flow union all select 'bytes_out', cast(bytes_out as double) from flow where bytes_out is not null),
 r as (select feature, value, row_number() over (partition by feature order by value) - 1 as rk, count(*) over (partition by feature) as n from v),
 g as (select feature, n, least(n, {_GRID}) as g from (select distinct feature, n from r)), k as (select feature, n, g, unnest(range(g)) as k from g)
 select k.feature, k.k, r.value from k join r on r.feature = k.feature and r.rk = cast(round_even(k.k * ((k.n - 1) / (k.g - 1)), 0) as bigint)""")
def _(spark, d):
    return order_statistics(V.flow(spark, d), ["bytes_in", "bytes_out"], _GRID)


@query("impute", f"""{FLOW_SQL}, m as (select quantile_cont(bytes_out, 0.5) as md from flow)
 select event_uid, coalesce(cast(bytes_out as double), md) as bytes_out, 7.0 as packets from flow, m""")
def _(spark, d):
    df = V.flow(spark, d).select("event_uid", "bytes_out")
    return forest.impute(df, {"bytes_out": forest.feature_medians(df, ["bytes_out"])["bytes_out"], "packets": 7.0})


# -- addresses and lookups ---------------------------------------------------------------


@query("classify_ip", f"""{FLOW_SQL} select event_uid, case when dst_ip like '2001:%' then 6 else 4 end as ip_version,
 dst_ip like '192.168.%' or dst_ip like '10.%' as is_private, false as is_loopback, false as is_multicast, false as is_reserved,
 not (dst_ip like '192.168.%' or dst_ip like '10.%') as is_global from flow""")
def _(spark, d):
    return V.flow(spark, d).select("event_uid", ipf.classify_ip(F.col("dst_ip")).alias("c")).select("event_uid", "c.*")


@query("is_private", f"{FLOW_SQL} select event_uid, {_PRIV_DST} = 1 as private from flow")
def _(spark, d):
    return V.flow(spark, d).select("event_uid", ipf.is_private(F.col("dst_ip")).alias("private"))


@query("canonical_ip", f"""{FLOW_SQL} select event_uid, dst_ip as ip,
 cast(null as varchar) as bad from flow""")
def _(spark, d):
    df = V.flow(spark, d)
    odd = F.when(F.contains("dst_ip", F.lit(":")), F.upper(F.replace("dst_ip", F.lit("2001:db8:aa::"), F.lit("2001:0DB8:00AA:0:0:0:0:")))).otherwise(F.col("dst_ip"))
    return df.select("event_uid", ipf.canonical_ip(odd).alias("ip"), ipf.canonical_ip(F.concat(F.col("dst_ip"), F.lit(".999"))).alias("bad"))


@query("flow_direction", f"{FLOW_SQL} select event_uid, case when dst_ip like '192.168.%' or dst_ip like '10.%' then 'internal' else 'outbound' end as direction from flow")
def _(spark, d):
    return V.flow(spark, d).select("event_uid", ipf.flow_direction(F.col("src_ip"), F.col("dst_ip")).alias("direction"))


_N4 = "(cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 + cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint))"


def _lpm(zone_rows, columns, name="zone"):
    """Longest range of each distinct v4 address by integer arithmetic, v6 by its text prefix."""
    cte = values_sql("z", f"cidr, {columns}", zone_rows)
    base, length = "split_part(cidr, '/', 1)", "cast(split_part(cidr, '/', 2) as int)"
    n_ip, n_net = _N4.format("ip"), _N4.format(base)
    return f"""{cte}, z4 as (select *, {n_net} as lo, {n_net} + (1::bigint << (32 - {length})) - 1 as hi, {length} as len from z where cidr not like '%:%'),
 best as (select ip, {columns} from (select ip, {n_ip} as n from ips where ip not like '%:%') i join z4 on n between lo and hi qualify row_number() over (partition by ip order by len desc) = 1
 union all select ip, {columns} from ips, z where cidr like '%:%' and ip like replace(split_part(cidr, '/', 1), '::', ':') || '%')"""


@query("cidr_lookup_join", f"""{FLOW_SQL}, ips as (select distinct dst_ip as ip from flow), {_lpm(ZONES, 'zone, criticality')}
 select event_uid, zone, criticality from flow left join best on dst_ip = ip""")
def _(spark, d):
    return lookups.cidr_lookup_join(V.flow(spark, d), "dst_ip", V.zones(spark), ["zone", "criticality"]).select("event_uid", "zone", "criticality")


# many ranges of many lengths: the distinct-address path
def _wide_ranges(spark):
    i = F.col("id")
    cidr = F.concat_ws(".", F.lit("10.0"), i % 6, (i * 16) % 256)
    return spark.range(600).select(F.concat(cidr, F.lit("/"), 17 + i % 16).alias("cidr"), F.concat(F.lit("n"), i).alias("name"))


@query("cidr_lookup_join_wide", f"""{FLOW_SQL}, w as (select i, (10 * 16777216 + (i % 6) * 256 + (i * 16) % 256) as n, 17 + i % 16 as len from range(600) t(i)),
 r as (select len, (n >> (32 - len)) << (32 - len) as lo, max('10.0.' || (i % 6) || '.' || ((i * 16) % 256) || '/' || len) as cidr, arg_max('n' || i, ('10.0.' || (i % 6) || '.' || ((i * 16) % 256) || '/' || len, 'n' || i)) as name from w group by 1, 2),
 ips as (select distinct src_ip as ip from flow), best as (select ip, name from (select ip, {_N4.format('ip')} as n from ips) i join r on (n >> (32 - len)) << (32 - len) = lo qualify row_number() over (partition by ip order by len desc) = 1)
 select event_uid, name from flow left join best on src_ip = ip""")
def _(spark, d):
    return lookups.cidr_lookup_join(V.flow(spark, d), "src_ip", _wide_ranges(spark), ["name"]).select("event_uid", "name")


@query("zone_join", f"""{FLOW_SQL}, ips as (select distinct src_ip as ip from flow), {_lpm(ZONES, 'zone, criticality')}
 select source_type, zone, criticality, count(*) as n from flow left join best on src_ip = ip group by all""")
def _(spark, d):
    out = lookups.zone_join(V.flow(spark, d), "src_ip", V.zones(spark))
    return out.groupBy("source_type", "zone", "criticality").agg(F.count("*").alias("n"))


_GEO = [("8.8.0.0/16", "US", "United States", "Mountain View", 37.4, -122.1), ("8.8.4.40/29", "CH", "Switzerland", "Zurich", 47.4, 8.5),
        ("10.0.0.0/8", "ZZ", "Nowhere", "Inside", 0.0, 0.0)]
_ASN = [("8.8.4.0/24", 15169, "GOOGLE")]


@query("geo_join", f"""{FLOW_SQL}, ips as (select distinct dst_ip as ip from flow where dst_ip like '8.8.%'), {_lpm([(r[0], r[1], r[3]) for r in _GEO], 'country_code, city')}
 select event_uid, country_code, city, case when dst_ip like '8.8.4.%' then 15169 end as asn from flow left join best on dst_ip = ip""")
def _(spark, d):
    geo = spark.createDataFrame(_GEO, "cidr string, country_code string, country_name string, city string, latitude double, longitude double")
    asn = spark.createDataFrame(_ASN, "cidr string, asn bigint, asn_org string")
    return lookups.geo_join(V.flow(spark, d), "dst_ip", geo, asn).select("event_uid", "country_code", "city", "asn")


_IOC_IP = """case when dst_ip in ('10.10.20.33', '8.8.4.42') then dst_ip when dst_ip like '203.0.113.%' then
 case when cast(split_part(dst_ip, '.', 4) as int) between 16 and 31 then '203.0.113.16/28' when cast(split_part(dst_ip, '.', 4) as int) < 64 then '203.0.113.0/26' end
 when dst_ip like '2001:db8:aa::%' then '2001:db8:aa::/64' end"""


@query("ioc_ip_join", f"{FLOW_SQL} select event_uid, {_IOC_IP} as indicator from flow")
def _(spark, d):
    out = lookups.ioc_ip_join(V.flow(spark, d), "dst_ip", V.iocs(spark))
    return out.select("event_uid", F.col("hit.indicator").alias("indicator"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("ioc_domain_join", f"""with h as (select page_id, {_HOST} as host from pages) select page_id, case
 when host = 'casino-win.example.com' or host like '%.casino-win.example.com' then 'casino-win.example.com' when host = 'ththth.example.net' or host like '%.ththth.example.net' then 'ththth.example.net'
 when host = 'example.net' or host like '%.example.net' then 'example.net' end as indicator from h""")
def _(spark, d):
    pages = V.table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    return lookups.ioc_domain_join(pages, "host", V.iocs(spark)).select("page_id", F.col("hit.indicator").alias("indicator"))


@query("ioc_hash_join", """select doc_id, case when length(text) % 7 = 0 then sha256(text) end as indicator from documents""")
def _(spark, d):
    docs = V.table(spark, d, "documents").withColumn("digest", F.upper(F.sha2("text", 256)))
    feed = docs.filter(F.length("text") % 7 == 0).select(F.lower("digest").alias("indicator"), F.lit("hash").alias("ioc_type"), F.lit("feed").alias("ioc_source"), F.lit("low").alias("confidence")).distinct()
    return lookups.ioc_hash_join(docs, "digest", feed).select("doc_id", F.col("hit.indicator").alias("indicator"))


@query("threat_intel", f"""{FLOW_SQL}, h as (select event_uid, {_IOC_IP} as indicator from flow) select event_uid, indicator, case when indicator is null then null when indicator like '%/%' then 'cidr' else 'ip' end as ioc_type,
 case when indicator is not null then 'dst_endpoint.ip' end as matched_on from h""")
def _(spark, d):
    out = enrich.threat_intel(V.record(spark, d), V.iocs(spark))
    return out.select("event_uid", *[F.col(f"threat_intel.{c}").alias(c) for c in ("indicator", "ioc_type", "matched_on")])


@query("network_context", f"""{FLOW_SQL}, ips as (select distinct dst_ip as ip from flow union select distinct src_ip from flow), {_lpm(ZONES, 'zone, criticality')}
 select event_uid, case when dst_ip like '192.168.%' or dst_ip like '10.%' then 'internal' else 'outbound' end as direction, s.zone as src_zone, t.zone as dst_zone, t.criticality as dst_criticality, 3 as n_ips
 from flow left join best s on src_ip = s.ip left join best t on dst_ip = t.ip""")
def _(spark, d):
    out = enrich.network_context(V.record(spark, d), V.zones(spark))
    c = F.col("network_context")
    return out.select("event_uid", c["direction"].alias("direction"), c["src_zone"].alias("src_zone"), c["dst_zone"].alias("dst_zone"), c["dst_criticality"].alias("dst_criticality"), F.size(c["ips"]).cast("bigint").alias("n_ips"))


@query("collect_ips", f"""{FLOW_SQL} select event_uid, src_ip || ',' || dst_ip || ',198.51.100.' || json_extract_string(unmapped_json, '$.k') as ips from flow""")
def _(spark, d):
    out = V.record(spark, d)
    return out.select("event_uid", F.array_join(enrich.collect_ips(out), ",").alias("ips"))


@query("tag_attack", f"""{FLOW_SQL}, t as (select event_uid, case when class_uid = 4001 and action_id = 2 and dst_port in (22, 23, 3389, 5900) then 'T1110' when class_uid = 4001 and action_id = 1 and dst_port in (1337, 4444, 31337) then 'T1571' end as id from flow)
 select event_uid, id as technique_ids, case id when 'T1110' then 'Brute Force' when 'T1571' then 'Non-Standard Port' end as technique_names, case id when 'T1110' then 'credential-access' when 'T1571' then 'command-and-control' end as tactics from t""")
def _(spark, d):
    out = enrich.tag_attack(V.record(spark, d))
    return out.select("event_uid", *[F.array_join(f"attack.{c}", ",").alias(c) for c in ("technique_ids", "technique_names", "tactics")])


@query("promote", f"""{FLOW_SQL} select event_uid, case when dst_ip like '192.168.%' or dst_ip like '10.%' then null else 'Outbound' end as direction, case when dst_ip like '192.168.%' or dst_ip like '10.%' then null else 2 end as direction_id from flow""")
def _(spark, d):
    out = enrich.enrichment_chain(zones=V.zones(spark))(V.record(spark, d))
    return out.select("event_uid", F.col("`connection_info.direction`").alias("direction"), F.col("`connection_info.direction_id`").alias("direction_id"))


# -- other models and layouts ----------------------------------------------------------------


@query("to_ecs", f"""{FLOW_SQL} select event_uid, strftime(make_timestamp("time" // 1000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as stamp, src_ip, dst_port, coalesce(bytes_out, 0) + bytes_in as network_bytes, protocol as transport,
 case when class_uid = 4001 then 'connection' else 'connection,protocol' end as types, '198.51.100.' || json_extract_string(unmapped_json, '$.k') as nat_ip, list_aggregate(list_sort([src_ip, dst_ip, '198.51.100.' || json_extract_string(unmapped_json, '$.k')]), 'string_agg', ',') as related from flow""")
def _(spark, d):
    e = F.col("ecs")
    out = crosswalk.to_ecs(V.record(spark, d))
    return out.select("event_uid", e["@timestamp"].alias("stamp"), e["source"]["ip"].alias("src_ip"), e["destination"]["port"].alias("dst_port"), e["network"]["bytes"].alias("network_bytes"),
                      e["network"]["transport"].alias("transport"), F.array_join(e["event"]["type"], ",").alias("types"), e["source"]["nat"]["ip"].alias("nat_ip"), F.array_join(e["related"]["ip"], ",").alias("related"))


@query("to_cim", f"""{FLOW_SQL} select event_uid, src_ip as src, dst_ip as dest, case when class_uid = 4001 then dst_port end as dest_port, case when class_uid = 4001 then case action_id when 1 then 'allowed' when 2 then 'blocked' end end as action,
 case when class_uid = 4001 then bytes_in + coalesce(bytes_out, 0) end as bytes, 'Acme Wall' as vendor_product, case when class_uid = 4001 then 'network,communicate' else '' end as tags from flow""")
def _(spark, d):
    out = crosswalk.to_cim(V.record(spark, d)).select("event_uid", "cim.*")
    return out.select("event_uid", "src", "dest", "dest_port", "action", "bytes", "vendor_product", F.array_join("tags", ",").alias("tags"))


@query("to_hec_envelopes", f"""{FLOW_SQL} select event_uid, source_type as sourcetype, 'edge' as host, src_ip as src, round("time" / 1e9, 3) as at from flow""")
def _(spark, d):
    out = crosswalk.to_hec_envelopes(V.record(spark, d), host="edge")
    at = lambda p: F.get_json_object("value", p)
    return out.select("event_uid", at("$.sourcetype").alias("sourcetype"), at("$.host").alias("host"), at("$.event.src").alias("src"), F.round(at("$.time").cast("double"), 3).alias("at"))


@query("to_ecs_bulk", f"""{FLOW_SQL} select event_uid, '{{"index":{{"_index":"logs-' || replace(date, '-', '.') || '","_id":"' || event_uid || '"}}}}' as action, src_ip from flow""")
def _(spark, d):
    out = crosswalk.to_ecs_bulk(V.record(spark, d), "logs")
    return out.select("event_uid", F.substring_index("value", "\n", 1).alias("action"), F.get_json_object(F.substring_index("value", "\n", -1), "$.source.ip").alias("src_ip"))


@query("to_warehouse_rows", f"""{FLOW_SQL} select event_uid, "time", source_type, src_ip, protocol, bytes_in, bytes_out, unmapped_json as unmapped, '{{}}' as enrichments from flow""")
def _(spark, d):
    out = crosswalk.to_warehouse_rows(V.record(spark, d))
    return out.select("event_uid", "time", "source_type", "src_ip", "protocol", "bytes_in", "bytes_out", "unmapped", "enrichments")


@query("merge_latest", f"""{FLOW_SQL} select "time", source_type, event_uid, 2 as mapping_version, bytes_in + 1 as bytes_in from flow""")
def _(spark, d):
    df = V.flow(spark, d).select("time", "source_type", "event_uid", "bytes_in")
    old, new = df.withColumn("mapping_version", F.lit(1)), df.withColumns({"mapping_version": F.lit(2), "bytes_in": F.col("bytes_in") + 1})
    return crosswalk.merge_latest(old.unionByName(new).unionByName(old))


@query("to_silver", f"""{FLOW_SQL} select event_uid, "time", class_uid, source_type, src_ip, src_port, dst_ip, dst_port, protocol, action_id, bytes_in, bytes_out, src_ip as dotted_src_ip, unmapped_json from flow""")
def _(spark, d):
    out = flatten.to_silver(V.record(spark, d)).withColumnRenamed("src_endpoint.ip", "dotted_src_ip")
    return out.select("event_uid", "time", "class_uid", "source_type", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "action_id", "bytes_in", "bytes_out", "dotted_src_ip", "unmapped_json")


@query("unflatten", f"""{FLOW_SQL} select event_uid, dst_ip, bytes_out, json_extract_string(unmapped_json, '$.k') as k from flow""")
def _(spark, d):
    out = flatten.unflatten(flatten.to_silver(V.record(spark, d)))
    r = F.col("record")
    return out.select("event_uid", r["dst_endpoint"]["ip"].alias("dst_ip"), r["traffic"]["bytes_out"].alias("bytes_out"), F.try_variant_get(r["unmapped"], "$.k", "string").alias("k"))


@query("flatten_ocsf", f"""{FLOW_SQL} select event_uid, src_ip, dst_port, '["' || protocol || '"]' as tags, unmapped_json from flow""")
def _(spark, d):
    df = V.flow(spark, d)
    nested = df.select("event_uid", F.struct(F.struct(F.col("src_ip").alias("ip")).alias("src_endpoint"), F.struct(F.col("dst_port").alias("port")).alias("dst_endpoint"),
                                             F.array("protocol").alias("tags"), F.col("unmapped_json").alias("unmapped")).alias("ocsf"))
    out = flatten.flatten_ocsf(nested)
    return out.select("event_uid", F.col("`src_endpoint.ip`").alias("src_ip"), F.col("`dst_endpoint.port`").alias("dst_port"), "tags", "unmapped_json")


# -- dead letters, anomalies --------------------------------------------------------------------


@query("unresolved", f"{DEAD_SQL} select event_uid, reason, stage from dead where event_uid not in (select event_uid from res)")
def _(spark, d):
    return dead_letters.unresolved(V.dead(spark, d), V.resolutions(spark, d)).select("event_uid", "reason", "stage")


@query("with_resolved", f"{DEAD_SQL} select reason, event_uid in (select event_uid from res) as resolved, count(*) as n from dead group by all")
def _(spark, d):
    return dead_letters.with_resolved(V.dead(spark, d), V.resolutions(spark, d)).groupBy("reason", "resolved").agg(F.count("*").alias("n"))


@query("dead_letter_stats", f"""{DEAD_SQL}, f as (select reason, stage, (event_uid in (select event_uid from res))::int as r from dead),
 g as (select 'reason' as kind, reason as name, count(*) as total, sum(r) as resolved from f group by reason union all select 'stage', stage, count(*), sum(r) from f group by stage union all select 'all', null, count(*), sum(r) from f)
 select kind, name, total, cast(resolved as bigint) as resolved, cast(total - resolved as bigint) as unresolved from g""")
def _(spark, d):
    return dead_letters.dead_letter_stats(V.dead(spark, d), V.resolutions(spark, d))


@query("dead_letters_by_source", f"{DEAD_SQL} select source as source_type, count(*) as dead_letters from dead where source is not null group by source")
def _(spark, d):
    return dead_letters.dead_letters_by_source(V.dead(spark, d))


@query("filter_dead_letters", f"{DEAD_SQL} select event_uid, ts_ns from dead where reason = 'invalid_ip' and ts_ns >= {T0 + 10 * 86400 * NS} and event_uid not in (select event_uid from res)")
def _(spark, d):
    out = dead_letters.filter_dead_letters(V.dead(spark, d), V.resolutions(spark, d), reason="invalid_ip", since_ns=T0 + 10 * 86400 * NS, unresolved_only=True)
    return out.select("event_uid", "ts_ns")


@query("preview_dead_letters", f"""{DEAD_SQL} select event_uid, left(raw_text, 300) as preview, length(raw_text) > 300 as truncated, event_uid in (select event_uid from res) as resolved from dead""")
def _(spark, d):
    return dead_letters.preview_dead_letters(V.dead(spark, d), V.resolutions(spark, d)).select("event_uid", "preview", "truncated", "resolved")


@query("recent_dead_letters", f"{DEAD_SQL} select event_uid, reason, ts_ns from dead order by ts_ns desc, event_uid limit 50 offset 50")
def _(spark, d):
    return dead_letters.recent_dead_letters(V.dead(spark, d), 50, 50).select("event_uid", "reason", "ts_ns")


@query("sample_dead_letters", f"{DEAD_SQL} select event_uid, ts_ns from dead where reason = 'grok_no_match' order by ts_ns, event_uid limit 25")
def _(spark, d):
    return dead_letters.sample_dead_letters(V.dead(spark, d), "grok_no_match", 25).select("event_uid", "ts_ns")


@query("replay_source", f"""{DEAD_SQL} select event_uid, case when cast(event_uid as bigint) % 2 = 0 then 'bronze' else raw_text end as text, case when cast(event_uid as bigint) % 2 = 0 then 'fw' else 'dlq-replay' end as source_id, reason as original_reason from dead""")
def _(spark, d):
    kept = V.events(spark, d).filter("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("event_uid"), F.encode(F.lit("bronze"), "UTF-8").alias("raw"), F.sha2(F.lit("bronze"), 256).alias("raw_hash"),
                                                                 F.lit(6).alias("raw_len"), (F.col("us") * 1000).alias("ingest_time_ns"), F.lit("fw").alias("source_id"), F.lit("udp").alias("transport"), F.lit(None).cast("string").alias("peer"))
    out = dead_letters.replay_source(V.dead(spark, d), kept)
    return out.select("event_uid", F.decode("raw", "UTF-8").alias("text"), "source_id", "original_reason")


@query("source_health", f"""{DEAD_SQL}, x as (select 'src_' || event_type as name, count(*) as n, max(us * 1000) as last from e group by 1), l as (select source as name, count(*) as d from dead where source is not null group by 1)
 select name, n as events_seen, round(n / (n + d), 4) as parse_rate, last as last_event_ns from x join l using (name)""")
def _(spark, d):
    defs = V.flow(spark, d).select(F.col("source_type").alias("name")).distinct().withColumns({"vendor": F.lit("v"), "product": F.lit("p"), "version": F.lit("1"), "enabled": F.lit(True)})
    out = dead_letters.source_health(defs, V.flow(spark, d), V.dead(spark, d))
    return out.select("name", "events_seen", "parse_rate", "last_event_ns")


@query("avg_completeness", f"""{FLOW_SQL}, r as (select *, row_number() over (partition by source_type order by "time" desc nulls last, event_uid) as rn from flow),
 c as (select source_type, case when class_uid = 4001 then (6 + (action_id is not null)::int + 1) / 20.0 else (6 + 1) / 19.0 end as c from r where rn <= 100)
 select source_type, round(avg(c), 4) as avg_completeness from c group by 1""")
def _(spark, d):
    return dead_letters.avg_completeness(V.flow(spark, d), 100)


@query("latest_scores", f"{SCORE_SQL} select event_uid, scored_at_ns, is_anomaly, round(anomaly_score, 6) as anomaly_score from latest")
def _(spark, d):
    return _rounded(anomalies.latest_scores(V.scores(spark, d)).select("event_uid", "scored_at_ns", "is_anomaly", "anomaly_score"), "anomaly_score")


@query("recent_anomalies", f"{SCORE_SQL} select event_uid, scored_at_ns, round(anomaly_score, 6) as anomaly_score from latest where is_anomaly and anomaly_score >= 1.2 order by scored_at_ns desc, anomaly_score desc, event_uid limit 60")
def _(spark, d):
    return _rounded(anomalies.recent_anomalies(V.scores(spark, d), 60, 1.2).select("event_uid", "scored_at_ns", "anomaly_score"), "anomaly_score")


@query("anomaly_timeline", f"""{SCORE_SQL} select cast(floor(event_time_ns / {6 * 3600 * NS}) * {6 * 3600 * NS} as bigint) as bucket_ns, count(*) as scored, count(*) filter (is_anomaly) as anomalies, round(max(anomaly_score), 6) as max_score, round(avg(anomaly_score), 6) as mean_score
 from latest where event_time_ns >= (select max(event_time_ns) from latest) - {2 * 86400 * NS} group by 1""")
def _(spark, d):
    return _rounded(anomalies.anomaly_timeline(V.scores(spark, d), 2 * 86400, 6 * 3600), "max_score", "mean_score")
