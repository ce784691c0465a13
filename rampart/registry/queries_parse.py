"""Parsing, mapping and normalizing queries over log lines rendered from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rampart.catalog import bundled
from rampart.definitions import Activity, Definition, Field
from rampart.functions import coerce as C
from rampart.functions import ocsf
from rampart.functions.text import canonical_json, decode_text
from rampart.functions.times import NS, parse_ts_ns
from rampart.operators import engines, envelope, normalize as N, templates as T
from rampart.plans.normalize import accepted, normalize
from rampart.plans.reprocess import pipeline_metrics, roundtrip_report
from rampart.registry import query, views as V
from rampart.registry.views import EVENT_SQL
from rampart.sources.kafka import decode_raw_events, encode_raw_events
from rampart.sources.lines import explode_payloads, to_raw_events
from rampart.sources.zeek import parse_zeek_tsv

E = f"with {EVENT_SQL}"
_CENTS = "cast(round(value * 100) as bigint)"


def _lines(spark, d, text: Column) -> DataFrame:
    df = V.events(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return df.withColumn("text", text)


def _get(name: str) -> Column:
    return F.element_at("fields", name)


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])


@query("parse_kv", f"""{E} select event_id, cast(user_id as varchar) as usr, event_type || ' said "' || k || '"' as msg, '' as empty, 'last' as dup, cast(us as varchar) as us, null as bare from e""")
def _(spark, d):
    text = _cat('  usr=', "$user_id", ' bare msg="', "$event_type", ' said \\"', "$k", '\\"" empty= dup=first dup=last us=', "$us", "  ")
    out = engines.parse(_lines(spark, d, text), "kv")
    return out.select("event_id", *[_get(n).alias(n) for n in ("usr", "msg", "empty", "dup", "us", "bare")])


@query("parse_csv", f"""{E} select event_id, event_type || ', "' || k || '"' as a, null as b, cast(user_id as varchar) as c, case when k % 3 = 0 then cast(k as varchar) end as extra, case when k % 3 = 1 then 'True' end as truncated from e""")
def _(spark, d):
    tail = F.when(F.col("k") % 3 == 0, _cat(",z,", "$k")).when(F.col("k") % 3 == 1, F.lit("")).otherwise(F.lit(",z"))
    text = F.concat(_cat('"', "$event_type", ', ""', "$k", '""",,', "$user_id"), tail)
    out = engines.parse(_lines(spark, d, text), "csv", {"columns": ["a", "b", "c", "d"]})
    return out.select("event_id", *[_get(n).alias(n) for n in ("a", "b", "c")], _get("_extra.4").alias("extra"), _get("_truncated").alias("truncated"))


@query("parse_tsv", f"""{E} select event_id, cast(us as varchar) as ts, case when k % 4 <> 0 then event_type end as kind, case when k % 5 = 0 then '[]' else '["a","' || k || '"]' end as tags from e""")
def _(spark, d):
    kind = F.when(F.col("k") % 4 == 0, "-").otherwise(F.col("event_type"))
    tags = F.when(F.col("k") % 5 == 0, "(empty)").otherwise(_cat("a,", "$k"))
    out = engines.parse(_lines(spark, d, F.concat_ws("\t", "us", kind, tags)), "tsv", {"columns": ["ts", "kind", "tags"], "list_fields": ["tags"]})
    return out.select("event_id", *[_get(n).alias(n) for n in ("ts", "kind", "tags")])


@query("parse_zeek_tsv", f"""{E} select event_id, event_type as stream, case when event_id % 1000 < 500 then cast(user_id as varchar) else cast(k as varchar) end as a, case when event_id % 1000 < 500 then null else cast(user_id as varchar) end as b,
 case when event_id % 1000 < 500 then '["' || k || '"]' end as tags from e""")
def _(spark, d):
    # every event type is one file; its header changes within every thousand events
    df = V.events(spark, d)
    first = F.col("event_id") % 1000 < 500
    row = F.when(first, F.concat_ws("\t", "user_id", "k")).otherwise(F.concat_ws("|", "k", "user_id"))
    data = df.select("event_id", F.col("event_type").alias("stream"), (F.col("event_id") * 10 + 9).alias("line_no"), row.alias("line"))
    marks = df.select(F.floor(F.col("event_id") / 500).alias("block")).distinct().crossJoin(df.select(F.col("event_type").alias("stream")).distinct())  # headers only
    tab = F.col("block") % 2 == 0
    heads = marks.select("stream", "block", F.posexplode(F.when(tab, F.array(F.lit("#separator \\x09"), F.lit("#fields\ta\ttags"), F.lit("#types\tstring\tset[string]")))
                                                         .otherwise(F.array(F.lit("#separator |"), F.lit("#fields|a|b"), F.lit("#types|string|string")))).alias("i", "line"))
    heads = heads.select(F.lit(None).cast("bigint").alias("event_id"), "stream", (F.col("block") * 5000 + F.col("i")).alias("line_no"), "line")
    out = parse_zeek_tsv(data.unionByName(heads), ["stream"], ["line_no"])
    return out.select("event_id", "stream", *[_get(n).alias(n) for n in ("a", "b", "tags")])


@query("parse_json_flat", f"""{E} select event_id, cast(k as varchar) as k, event_type as kind, cast(user_id as varchar) as dotted, cast(k + 1 as varchar) as second, 'deep' as deep, 'True' as flag, '[]' as none from e""")
def _(spark, d):
    text = _cat('{"a":{"k":', "$k", ',"list":[', "$k", ',', (F.col("k") + 1).cast("string"), ',{"x":{"y":{"z":"deep"}}}],"none":[]},"kind":"', "$event_type", '","id.u":', "$user_id", ',"flag":true}')
    out = engines.parse(_lines(spark, d, text), "json")
    names = {"a.k": "k", "kind": "kind", "id.u": "dotted", "a.list.1": "second", "a.list.2.x.y.z": "deep", "flag": "flag", "a.none": "none"}
    return out.select("event_id", *[_get(n).alias(a) for n, a in names.items()])


@query("parse_json_props", f"""{E} select event_id, cast(k as varchar) as k, null as error from e""")
def _(spark, d):
    out = engines.parse(V.events(spark, d), "json", text="props")
    return out.select("event_id", _get("k").alias("k"), F.col("parse_error").alias("error"))


@query("parse_dissect", f"""{E} select event_id, case when k % 10 <> 0 then cast(user_id as varchar) end as usr, case when k % 10 <> 0 then event_type || '/' || k end as what, case when k % 10 <> 0 then 'a b' end as rest, case when k % 10 = 0 then 'ParseError' end as error from e""")
def _(spark, d):
    good = _cat("<", "$user_id", ">     ", "$event_type", " at ", "$k", " :: a b;")
    text = F.when(F.col("k") % 10 == 0, F.lit("no such shape")).otherwise(good)
    out = engines.parse(_lines(spark, d, text), "dissect", {"pattern": "<%{usr}>%{->} %{+what} at %{+what} :: %{rest};", "append_separator": "/"})
    return out.select("event_id", *[_get(n).alias(n) for n in ("usr", "what", "rest")], F.col("parse_error").alias("error"))


@query("parse_grok", f"""{E} select event_id, case when k % 10 <> 0 then '10.0.0.' || k end as ip, case when k % 10 <> 0 and k % 2 = 0 then cast(user_id as varchar) end as port, case when k % 10 <> 0 then case when k % 3 = 0 then '' else event_type end end as what,
 case when k % 10 = 0 then 'grok_no_match' end as error from e""")
def _(spark, d):
    port = F.when(F.col("k") % 2 == 0, _cat(":", "$user_id")).otherwise("")
    what = F.when(F.col("k") % 3 == 0, "").otherwise(F.col("event_type"))
    good = F.concat(_cat("x from 10.0.0.", "$k"), port, F.lit(' did "'), what, F.lit('" now'))
    out = engines.parse(_lines(spark, d, F.when(F.col("k") % 10 == 0, F.lit("nothing")).otherwise(good)), "grok", {"pattern": 'from %{IP:ip}(?::%{INT:port})? did "%{DATA:what}" now'})
    return out.select("event_id", *[_get(n).alias(n) for n in ("ip", "port", "what")], F.col("parse_error").alias("error"))


@query("parse_cef", f"""{E} select event_id, 'v|x' as vendor, cast(k % 10 as varchar) as severity, 'a b=c ' || event_type as msg, cast(user_id as varchar) as labelled, '10.0.0.' || k as src from e""")
def _(spark, d):
    text = _cat("<13>host CEF:0|v\\|x|prod|1|", "$k", "|name|", (F.col("k") % 10).cast("string"), "|msg=a b\\=c ", "$event_type", " cs1=", "$user_id", " cs1Label=Account src=10.0.0.", "$k")
    out = engines.parse(_lines(spark, d, text), "cef")
    return out.select("event_id", _get("deviceVendor").alias("vendor"), _get("severity").alias("severity"), _get("msg").alias("msg"), _get("Account").alias("labelled"), _get("src").alias("src"))


@query("parse_leef", f"""{E} select event_id, case when k % 2 = 0 then '1.0' else '2.0' end as version, cast(user_id as varchar) as usr, event_type || '=x' as what from e""")
def _(spark, d):
    one = _cat("LEEF:1.0|V|P|1|", "$k", "|usr=", "$user_id", "\twhat=", "$event_type", "=x")
    two = _cat("LEEF:2.0|V|P|1|", "$k", "|^|usr=", "$user_id", "^what=", "$event_type", "=x")
    out = engines.parse(_lines(spark, d, F.when(F.col("k") % 2 == 0, one).otherwise(two)), "leef")
    return out.select("event_id", _get("leefVersion").alias("version"), _get("usr").alias("usr"), _get("what").alias("what"))


@query("decode_raw", "select doc_id, text, doc_id % 4 < 3 as bom from documents")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    plain = F.encode("text", "UTF-8")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(
        F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(plain)
    out = envelope.decode_raw(docs.select("doc_id", raw.alias("raw")))
    return out.select("doc_id", "text", F.col("bom_stripped").alias("bom"))


_KINDS = ["syslog", "cef", "leef", "json", "tsv", "kv", "csv", "unknown"]


def _mixed(spark, d) -> DataFrame:
    shapes = [_cat("<", "$k", ">a=1 b=2 c=", "$k"), _cat("CEF:0|a|b|c|", "$k", "|e|f|"), _cat("LEEF:1.0|a|b|c|", "$k", "|x=1"), _cat('{"k":', "$k", "}"),
              F.concat_ws("\t", "user_id", "k", "us", "event_type"), _cat("a=1 b=", "$k", " c=", "$event_type"), F.concat_ws(",", *["k"] * 9), _cat("plain ", "$event_type", " {", "$k")]
    text = F.coalesce(*[F.when(F.col("event_id") % 8 == i, s) for i, s in enumerate(shapes)])
    return _lines(spark, d, text)


@query("sniff", f"""{E} select event_id, list_extract(['{"','".join(_KINDS)}'], event_id % 8 + 1) as format from e""")
def _(spark, d):
    return _mixed(spark, d).select("event_id", envelope.sniff(F.col("text")).alias("format"))


@query("sniff_layered", f"""{E} select event_id, list_extract(['{"','".join(_KINDS)}'], event_id % 8 + 1) as outer_format, case when event_id % 8 = 0 then 'kv' else list_extract(['{"','".join(_KINDS)}'], event_id % 8 + 1) end as inner_format from e""")
def _(spark, d):
    return envelope.sniff_layered(_mixed(spark, d)).select("event_id", "outer_format", "inner_format")


@query("strip_syslog", f"""{E}, s as (select *, k % 100 + 8 as pri, event_id % 4 as v from e) select event_id, case when v = 3 then null else cast(pri // 8 as varchar) end as facility, case when v = 3 then null else cast(pri % 8 as varchar) end as severity,
 case v when 0 then 'rfc5424' when 1 then 'rfc3164' when 2 then 'pri_only' end as format, case v when 0 then strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') when 1 then 'Jan  5 10:11:12' end as timestamp, case v when 0 then 'h' || user_id when 1 then 'h' || user_id end as hostname,
 case v when 1 then 'app' end as tag, case when v in (0, 1) then cast(k as varchar) end as procid, case v when 0 then event_type || '"]' end as param, 'message ' || event_type as message, true as whole from s""")
def _(spark, d):
    df = V.events(spark, d).withColumn("pri", F.col("k") % 100 + 8)
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = _cat("message ", "$event_type")
    new = F.concat(_cat("<", "$pri", ">1 "), stamp, _cat(" h", "$user_id", " - ", "$k", ' - [x@1 p="', "$event_type", '\\"\\]" q="1"] '), body)
    old = F.concat(_cat("<", "$pri", ">Jan  5 10:11:12 h", "$user_id", " app[", "$k", "]: "), body)
    v = F.col("event_id") % 4
    text = F.when(v == 0, new).when(v == 1, old).when(v == 2, F.concat(_cat("<", "$pri", ">"), body)).otherwise(body)
    out = envelope.strip_syslog(df.withColumn("text", text))
    at = lambda n: F.element_at("envelope", n)
    whole = F.concat(F.coalesce(at("header_raw"), F.lit("")), F.col("message")) == F.col("text")
    return out.select("event_id", *[at(n).alias(n) for n in ("facility", "severity", "format", "timestamp", "hostname", "tag", "procid")], at("structured_data.x@1.p").alias("param"), "message", whole.alias("whole"))


@query("parse_ts_ns", f"""{E} select event_id, case event_id % 5 when 0 then us * 1000 when 1 then (us // 1000000) * 1000000000 when 2 then (us // 1000) * 1000000 when 3 then (us // 1000000) * 1000000000 else (us // 1000000) * 1000000000 - 7200000000000 end as ns, null as bad from e""")
def _(spark, d):
    df = V.events(spark, d)
    ts = F.timestamp_micros("us")
    v = F.col("event_id") % 5
    text = (F.when(v == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(v == 1, F.expr("us div 1000000").cast("string")).when(v == 2, F.expr("us div 1000").cast("string"))
            .when(v == 3, F.concat_ws(" ", F.date_format(ts, "MMM"), F.date_format(ts, "d"), F.date_format(ts, "HH:mm:ss"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))))
    now = F.lit(1_735_000_000 * NS)  # late in the year of the events
    return df.select("event_id", parse_ts_ns(text, now_ns=now).alias("ns"), parse_ts_ns(F.concat(F.lit("x"), text), now_ns=now).alias("bad"))


# summer time of the zone: from the last Sunday of March to that of October (before 1996, September), at one o'clock UTC
@query("parse_ts_format", """with o as (select o_orderkey, o_orderdate as t, make_date(year(o_orderdate), 3, 31) as m, make_date(year(o_orderdate), case when year(o_orderdate) < 1996 then 9 else 10 end, case when year(o_orderdate) < 1996 then 30 else 31 end) as w from orders),
 b as (select o_orderkey, t, m - cast(dayofweek(m) as int) + interval 2 hour as starts, w - cast(dayofweek(w) as int) + interval 3 hour as ends from o)
 select o_orderkey, epoch_us(t) * 1000 as utc, (epoch_us(t) - case when t >= starts and t < ends then 7200000000 else 3600000000 end) * 1000 as zoned from b""")
def _(spark, d):
    orders = V.table(spark, d, "orders")
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")
    return orders.select("o_orderkey", parse_ts_ns(text, "%Y/%m/%d %H:%M:%S").alias("utc"), parse_ts_ns(text, "%Y/%m/%d %H:%M:%S", "Europe/Paris").alias("zoned"))


@query("coerce", f"""{E} select event_id, k as whole, case when {_CENTS} % 100 = 0 then {_CENTS} // 100 end as from_decimal, round(value, 2) as number, case event_type when 'click' then true when 'view' then false end as flag from e""")
def _(spark, d):
    df = _lines(spark, d, F.lit(""))
    word = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "off").otherwise(F.col("event_type"))
    decimal = F.format_string("%d.%02d", F.expr("cents div 100"), F.col("cents") % 100)
    return df.select("event_id", C.coerce(_cat(" ", "$k", " "), "int").alias("whole"), C.coerce(decimal, "int").alias("from_decimal"), C.coerce(decimal, "float").alias("number"), C.coerce(word, "bool").alias("flag"))


@query("canonical_json", f"""{E} select event_id, '{{"a":"' || user_id || '","b":"' || event_type || '"}}' as js from e""")
def _(spark, d):
    m = F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"), F.lit("c"), F.lit(None).cast("string"))
    return V.events(spark, d).select("event_id", canonical_json(m).alias("js"))


@query("merge_envelope", f"""{E} select event_id, cast(k as varchar) as k, 'h' || user_id as host from e""")
def _(spark, d):
    df = envelope.strip_syslog(_lines(spark, d, _cat("<13>Jan  5 10:11:12 h", "$user_id", " app: k=", "$k")))
    out = engines.parse(df, "kv", text="message").withColumn("fields", F.map_concat("fields", envelope.envelope_fields(F.col("envelope"))))
    return out.select("event_id", _get("k").alias("k"), _get("envelope.hostname").alias("host"))


# -- payloads and raw events ---------------------------------------------------------------


@query("explode_payloads_text", f"""{E} select event_id as payload_id, unnest([event_type, 'k ' || k]) as raw from e""")
def _(spark, d):
    body = _cat("$event_type", "\r\n\n  \nk ", "$k", "\n")
    return explode_payloads(V.events(spark, d).select(F.col("event_id").alias("payload_id"), body.alias("body")), "text").select("payload_id", "raw")


@query("explode_payloads_json", f"""{E}, x as (select event_id as payload_id, unnest(['{{"a":' || k || ',"b":"x"}}', cast(user_id as varchar)]) as raw, null as error from e where event_id % 3 = 0 union all
 select event_id, unnest(['{{"b":"x", "a":' || k || '}}', '[1]']), null from e where event_id % 3 = 1 union all select event_id, null, 'invalid JSON' from e where event_id % 3 = 2) select * from x""")
def _(spark, d):
    listed = _cat(' [{"b":"x", "a":', "$k", "}, ", "$user_id", "]")
    lines = _cat('{"b":"x", "a":', "$k", "}\n[1]\r\n")
    v = F.col("event_id") % 3
    body = F.when(v == 0, listed).when(v == 1, lines).otherwise(_cat('{"a":', "$k"))
    out = explode_payloads(V.events(spark, d).select(F.col("event_id").alias("payload_id"), body.alias("body")), "json")
    return out.select("payload_id", "raw", "error")


@query("explode_payloads_hec", f"""{E}, x as (select event_id as payload_id, event_type as raw, 'st' || k as sourcetype, null as error from e where event_id % 5 <> 0 union all select event_id, '{{"a":' || k || ',"b":[1]}}', null, null from e where event_id % 5 <> 0
 union all select event_id, null, null, 'refused' from e where event_id % 5 = 0) select * from x""")
def _(spark, d):
    good = _cat('{"event":"', "$event_type", '","sourcetype":"st', "$k", '"} {"event":{"b":[1],"a":', "$k", "}}")
    body = F.when(F.col("event_id") % 5 == 0, F.concat(good, F.lit('{"no":1}'))).otherwise(good)
    out = explode_payloads(V.events(spark, d).select(F.col("event_id").alias("payload_id"), body.alias("body")), "hec")
    return out.select("payload_id", "raw", "sourcetype", F.when(F.col("error").isNotNull(), "refused").alias("error"))


@query("to_raw_events", """select sha256(text) as raw_hash, octet_length(encode(text)) as raw_len, source as source_id, count(*) as n, true as distinct_ids from documents group by all""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("raw"), F.col("source").alias("source_id"), F.col("doc_id").alias("row_id"))
    raw = to_raw_events(docs, ingest_time_ns=1_704_067_200 * NS)
    out = raw.groupBy("raw_hash", "raw_len", "source_id").agg(F.count("*").alias("n"), (F.countDistinct("event_uid") == F.count("*")).alias("distinct_ids"))
    return out


@query("kafka_codec", "select lpad(cast(doc_id as varchar), 12, '0') as event_uid, sha256(text) as raw_hash, source as key, true as same from documents")
def _(spark, d):
    sent = encode_raw_events(V.bronze(spark, d))
    back = decode_raw_events(sent)
    return back.select("event_uid", "raw_hash", F.col("source_id").alias("key"), (F.sha2("raw", 256) == F.col("raw_hash")).alias("same"))


# -- definitions and normalizing ----------------------------------------------------------------


def _fortigate() -> Column:
    stamp = F.timestamp_micros("us")
    verdict = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "signup", "close").otherwise("accept")
    return F.concat(_cat('<189>date='), F.date_format(stamp, "yyyy-MM-dd"), F.lit(" time="), F.date_format(stamp, "HH:mm:ss"), _cat(
        ' devname="FW', "$user_id", '" logid="0000000013" type="traffic" level="notice" srcip=10.0.0.', (F.col("user_id") % 250 + 1).cast("string"), " srcport=", (F.col("k") + 1024).cast("string"),
        " dstip=203.0.113.", "$k", ' dstport=443 srcintf="lan" dstintf="wan" sessionid=', "$event_id", ' proto=6 action="', verdict, '" policyid=', "$k", " sentbyte=", "$cents", " rcvdbyte=", "$k", " sentpkt=3 rcvdpkt=2"))


def _vpc() -> Column:
    return _cat("2 123456789010 eni-0abc ", F.when(F.col("k") % 10 == 0, "-").otherwise(_cat("10.0.0.", (F.col("user_id") % 250 + 1).cast("string"))), " 8.8.4.", "$k", " 51234 53 17 14 ", "$cents", " ",
                F.expr("us div 1000000").cast("string"), " ", F.expr("us div 1000000").cast("string"), " REJECT OK")


def _zeek() -> Column:
    micros = F.format_string("%d.%06d", F.expr("us div 1000000"), F.col("us") % 1000000)
    return _cat('{"ts":', micros, ',"uid":"C', "$event_id", '","id.orig_h":"10.0.0.', (F.col("user_id") % 250 + 1).cast("string"), '","id.orig_p":', (F.col("k") + 1024).cast("string"),
                ',"id.resp_h":"2001:DB8:0:0:0:0:0:', "$k", '","id.resp_p":53,"proto":"udp","conn_state":"SF","orig_bytes":', "$cents", ',"resp_bytes":', "$k", ',"tags":["x",', "$k", "]}")


def raw_lines(spark, d) -> DataFrame:
    """Raw events: firewall, flow-log, sensor and unknown lines in turn."""
    v = F.col("event_id") % 4
    other = _cat("user ", "$user_id", " did ", "$event_type", " at ", "$k")
    df = _lines(spark, d, F.lit(""))
    df = df.withColumn("text", F.when(v == 0, _fortigate()).when(v == 1, _vpc()).when(v == 2, _zeek()).otherwise(other))
    raw = F.encode("text", "UTF-8")
    return df.select(F.col("event_id").cast("string").alias("event_uid"), raw.alias("raw"), F.sha2(raw, 256).alias("raw_hash"), F.octet_length(raw).alias("raw_len"), (F.col("us") * 1000 + 5 * NS).alias("ingest_time_ns"),
                     F.concat(F.lit("dev"), (F.col("user_id") % 7)).alias("source_id"), F.lit("file").alias("transport"), F.lit(None).cast("string").alias("peer"))


_NAMES = "list_extract(['fortigate_traffic', 'aws_vpc_flow', 'zeek_conn', 'unknown'], v + 1)"
NORMAL_SQL = f"""{E}, x as (select *, event_id % 4 as v, {_CENTS} as cents from e), n as (select cast(event_id as varchar) as event_uid, {_NAMES} as source_type, case when v = 1 and k % 10 = 0 then 'dead' when v = 3 then 'template_only' else 'ok' end as status, 4001 as class_uid,
 case v when 2 then us * 1000 when 3 then us * 1000 + 5000000000 else (us // 1000000) * 1000000000 end as "time", case when v = 3 or (v = 1 and k % 10 = 0) then null else '10.0.0.' || (user_id % 250 + 1) end as src_ip, case v when 1 then 51234 when 3 then null else k + 1024 end as src_port,
 case v when 0 then '203.0.113.' || k when 1 then '8.8.4.' || k when 2 then case when k = 0 then '2001:db8::' else '2001:db8::' || k end end as dst_ip, case v when 0 then 443 when 3 then null else 53 end as dst_port, case v when 0 then 'TCP' when 3 then null else 'udp' end as protocol,
 case v when 0 then case event_type when 'error' then 2 else 1 end when 1 then 2 when 2 then 1 end as action_id, case when v = 3 then null else 1 end as severity_id, case when v in (0, 2) then k end as bytes_in, case when v in (0, 2) then cents end as bytes_out,
 case v when 0 then 1.0 when 1 then 0.95 when 2 then 0.9 else 0.2 end as completeness, k, user_id, event_type, event_id from x)"""


@query("normalize", f"""{NORMAL_SQL} select event_uid, source_type, status, class_uid, "time", src_ip, src_port, dst_ip, dst_port, protocol, action_id, severity_id, bytes_in, bytes_out, case when status = 'ok' then completeness end as completeness,
 case when status = 'dead' then 'invalid_ip' end as reason from n""")
def _(spark, d):
    out = normalize(raw_lines(spark, d), bundled())
    c = ocsf.col
    return out.select("event_uid", "source_type", "status", "class_uid", "time", c("src_endpoint.ip").alias("src_ip"), c("src_endpoint.port").alias("src_port"), c("dst_endpoint.ip").alias("dst_ip"), c("dst_endpoint.port").alias("dst_port"),
                      c("connection_info.protocol_name").alias("protocol"), "action_id", "severity_id", c("traffic.bytes_in").alias("bytes_in"), c("traffic.bytes_out").alias("bytes_out"), F.when(F.col("status") == "ok", F.col("completeness")).alias("completeness"), "reason")


@query("match_source", f"{NORMAL_SQL} select event_uid, nullif(source_type, 'unknown') as source_type from n")
def _(spark, d):
    return N.match_source(raw_lines(spark, d).withColumn("text", decode_text(F.col("raw"))), bundled()).select("event_uid", "source_type")


@query("compile_detect", f"""{E} select event_id, k % 2 = 0 and (event_type = 'view' or user_id % 3 = 0) and k >= 10 as hit from e""")
def _(spark, d):
    rule = {"all": [{"regex": r"\bk=\d*[02468]\b"}, {"any": [{"contains": "t=view"}, {"starts_with": "0;"}]}, {"field_count": {"delimiter": ";", "min": 4, "max": 5}}]}
    df = _lines(spark, d, F.concat(_cat((F.col("user_id") % 3).cast("string"), "; k=", "$k", "; t=", "$event_type"), F.when(F.col("k") >= 10, ";x").otherwise("")))
    return df.select("event_id", N.compile_detect(rule, F.col("text"), lambda n: F.lit(None).cast("string")).alias("hit"))


def _toy() -> Definition:
    return Definition(
        name="toy", version="2", vendor="v", product="p", product_version="1", detect={"contains": "="}, engine="kv", class_uid=4002, category_uid=4,
        activity=Activity("m", {"view": 3, "click": 6}, 99), unmapped="keep_all", constants={"severity_id": 1, "action": "Seen"},
        fields=(Field("src_endpoint.port", ("p1", "p2"), "int"), Field("message", ("a", "b"), join="-"), Field("status_id", ("m",), values={"error": 2}, default=1),
                Field("action", ("act",)), Field("duration", ("d",), "float", required=True)),
    )


@query("map_fields", f"""{E} select event_id, case event_type when 'view' then 3 when 'click' then 6 else 99 end as activity_id, case when k % 2 = 0 then k else user_id end as port, case when k % 3 = 0 then cast(k as varchar) else k || '-' || event_type end as message,
 case event_type when 'error' then 2 else 1 end as status_id, 'Seen' as action, round(value, 2) as duration, case when k % 7 = 0 then 'required_unresolved' end as reason,
 '{{"act":"",' || case when k % 3 = 0 then '"b":"",' else '' end || case when k % 2 = 0 then '' else '"p1":"",' end || case when k % 2 = 0 then '"p2":"' || user_id || '",' else '' end || '"z":"' || k || '"}}' as unmapped from e where k % 7 <> 0
 union all select event_id, case event_type when 'view' then 3 when 'click' then 6 else 99 end, case when k % 2 = 0 then k else user_id end, case when k % 3 = 0 then cast(k as varchar) else k || '-' || event_type end, case event_type when 'error' then 2 else 1 end, 'Seen', null, 'required_unresolved',
 '{{"act":"",' || case when k % 3 = 0 then '"b":"",' else '' end || '"d":"",' || case when k % 2 = 0 then '' else '"p1":"",' end || case when k % 2 = 0 then '"p2":"' || user_id || '",' else '' end || '"z":"' || k || '"}}' from e where k % 7 = 0""")
def _(spark, d):
    number = F.format_string("%d.%02d", F.expr("cents div 100"), F.col("cents") % 100)
    text = F.concat(_cat("m=", "$event_type", " p1=", F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(""), " p2=", "$user_id", " a=", "$k", " b=", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("event_type")),
                         " act= d="), F.when(F.col("k") % 7 == 0, "").otherwise(number), _cat(" z=", "$k"))
    df = engines.parse(_lines(spark, d, text), "kv").withColumns({"event_uid": F.col("event_id"), "raw_hash": F.lit("h"), "ingest_time_ns": F.lit(0), "source_type": F.lit("toy")})
    out = N.map_fields(df, [_toy()])
    c = ocsf.col
    return out.select("event_id", "activity_id", c("src_endpoint.port").alias("port"), "message", "status_id", "action", "duration", F.col("mapping_error.reason").alias("reason"), F.col("unmapped_json").alias("unmapped"))


@query("unmapped", f"""{NORMAL_SQL} select event_uid, case source_type when 'fortigate_traffic' then cast(user_id as varchar) end as dev, case source_type when 'zeek_conn' then k end as tag, case source_type when 'fortigate_traffic' then 189 end as pri from n where status = 'ok'""")
def _(spark, d):
    out = accepted(normalize(raw_lines(spark, d), bundled()).filter("status = 'ok'"))
    v = F.try_parse_json("unmapped_json")
    at = lambda p, t: F.try_variant_get(v, p, t)
    return out.select("event_uid", F.regexp_extract(at("$.devname", "string"), r"FW(\d+)", 1).alias("dev"), at("$['tags.1']", "bigint").alias("tag"), at("$['envelope.pri']", "bigint").alias("pri"))


@query("finalize", f"""{E} select event_id, case k % 3 when 0 then 'Network Activity' when 1 then 'DNS Activity' else 'Authentication' end as class_name, case k % 3 when 0 then 400106 when 1 then 400306 else 300206 end as type_uid,
 case when k % 3 = 2 then null else 'Traffic' end as activity_name, case k % 3 when 0 then 'Network Activity: Traffic' when 1 then 'DNS Activity: Traffic' else 'Authentication' end as type_name, 'Network Activity' as category_name, case when k % 2 = 0 then 'High' else 'Informational' end as severity from e""")
def _(spark, d):
    k = F.col("k")
    df = V.events(spark, d).select("event_id", F.when(k % 3 == 0, 4001).when(k % 3 == 1, 4003).otherwise(3002).cast("bigint").alias("class_uid"), F.lit(6).cast("bigint").alias("activity_id"), F.lit(4).cast("bigint").alias("category_uid"),
                                   F.when(k % 2 == 0, 4).otherwise(1).cast("bigint").alias("severity_id"))
    return ocsf.finalize(df).select("event_id", "class_name", "type_uid", "activity_name", "type_name", "category_name", "severity")


@query("validate", f"""{E} select event_id, case when k % 5 = 0 then 'missing required attribute: time' when k % 5 = 1 then 'port out of range 0-65535: 70000' when k % 5 = 2 then 'invalid IP address: ''10.0.0.999''' when k % 5 = 3 then 'action_id 7 is not a valid action' else '' end as errors,
 case when k % 2 = 0 then 'severity_id is 0 (Unknown)' else '' end as warnings from e""")
def _(spark, d):
    df = V.record(spark, d)
    k = F.get_json_object("unmapped_json", "$.k").cast("bigint")
    df = df.withColumns({
        "class_uid": F.lit(4001).cast("bigint"), "type_uid": F.lit(400106).cast("bigint"), "time": F.when(k % 5 != 0, F.col("time")), "dst_endpoint.port": F.when(k % 5 == 1, 70000).otherwise(443).cast("bigint"),
        "dst_endpoint.ip": F.when(k % 5 == 2, "10.0.0.999").otherwise("10.0.0.9"), "action_id": F.when(k % 5 == 3, 7).otherwise(1).cast("bigint"), "severity_id": F.when(k % 2 == 0, 0).otherwise(1).cast("bigint"),
    })
    out = ocsf.validate(df)
    return out.select(F.col("event_uid").cast("bigint").alias("event_id"), F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query("completeness", f"""{E} select event_id, round(case when k % 4 = 3 then 13 / 19.0 else (8 + 8 + (event_type <> 'signup')::int) / 20.0 end, 6) as completeness from e""")
def _(spark, d):
    out = ocsf.finalize(V.record(spark, d))
    return out.select(F.col("event_uid").cast("bigint").alias("event_id"), F.round(ocsf.completeness(out), 6).alias("completeness"))


@query("http_activity", f"""{E} select event_id, case event_type when 'view' then 3 when 'click' then 6 when 'error' then 2 else 99 end as activity_id from e""")
def _(spark, d):
    method = F.when(F.col("event_type") == "view", " get").when(F.col("event_type") == "click", "POST").when(F.col("event_type") == "error", "Delete").otherwise(F.col("event_type"))
    return V.events(spark, d).select("event_id", ocsf.http_activity(method).alias("activity_id"))


@query("template_only", f"""{E} select event_id, us * 1000 + 5000000000 as "time", 4001 as class_uid, 'unknown' as source_type, 'Network Activity' as class_name, 'template_only' as parse_status from e""")
def _(spark, d):
    raw = raw_lines(spark, d)
    out = N.template_only(N.prepare(raw.withColumn("text", decode_text(F.col("raw")))))
    return out.select(F.col("event_uid").cast("bigint").alias("event_id"), "time", "class_uid", "source_type", "class_name", F.get_json_object("enrichments_json", "$.parse_status").alias("parse_status"))


@query("pipeline_metrics", f"""{NORMAL_SQL}, m as (select 'events_received' as metric, 'file' as label, count(*) as value from n union all select 'events_normalized', source_type || '/4001', count(*) from n where status <> 'dead' group by source_type
 union all select 'dead_letters', 'normalize/invalid_ip', count(*) from n where status = 'dead'
 union all select 'events_parsed', source_type, count(*) from n group by source_type union all select 'parse_share', '', 1.0
 union all select 'completeness_le', printf('%.1f', b / 10.0), count(*) filter (status <> 'dead' and completeness <= b / 10.0 + 1e-12) from n, range(11) t(b) group by b) select metric, label, cast(value as double) as value from m""")
def _(spark, d):
    # the bytes depend on how lines are rendered, which SQL does not repeat; tests/test_normalize.py checks them
    return pipeline_metrics(normalize(raw_lines(spark, d), bundled())).filter("metric <> 'bytes_received'")


@query("roundtrip_report", f"""{NORMAL_SQL}, t as (select count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'template_only') as other from n)
 select total, total as byte_lossless, total as reparse_stable, ok as normalized_originally, ok as renormalize_stable, dead as dead_letter_count, other as no_source_match_count, 100.0 as byte_lossless_rate, 100.0 as reparse_stable_rate, 100.0 as renormalize_stable_rate from t""")
def _(spark, d):
    return roundtrip_report(raw_lines(spark, d), bundled())


@query("common_keys", f"""{E}, f as (select event_id, unnest(case when k % 3 = 0 then ['a', 'b'] when k % 3 = 1 then ['a', 'c'] else ['a', 'b', 'd'] end) as key from e) select key, count(*) as "rows", round(count(*) / (select count(*) from e), 6) as presence from f group by key having count(*) >= 0.5 * (select count(*) from e)""")
def _(spark, d):
    k = F.col("k")
    text = F.when(k % 3 == 0, "a=1 b=2").when(k % 3 == 1, "a=1 c=2").otherwise("a=1 b=2 d=3")
    parsed = engines.parse(_lines(spark, d, text), "kv")
    return T.common_keys(parsed, 0.5, row="event_id").select("key", "rows", F.round("presence", 6).alias("presence"))


@query("majority_format", f"""{E} select 'dev' || (user_id % 7) as source_id, 'kv' as outer_format, 'kv' as inner_format, count(*) filter (k >= 30) as votes from e group by 1""")
def _(spark, d):
    df = _lines(spark, d, F.when(F.col("k") >= 30, _cat("a=1 b=2 c=", "$k")).otherwise(_cat("x ", "$k")))
    return T.majority_format(envelope.sniff_layered(df).withColumn("source_id", F.concat(F.lit("dev"), F.col("user_id") % 7)))
