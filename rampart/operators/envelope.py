"""Raw bytes to text, format sniffing and syslog envelope splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rampart.functions.text import capture, decode_text, group, has_bom, let, matched

# Syslog facility and severity names.
FACILITIES = [
    "kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "audit", "alert", "cron2", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
]
SEVERITIES = ["Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Informational", "Debug"]

# <PRI>version ts host app procid msgid tail
_RFC5424 = r"^<(\d{1,3})>(\d{1,3}) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([\s\S]*)\z"
# <PRI>Mmm d hh:mm:ss host [tag[pid]:] message
_RFC3164 = (
    r"^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) "
    r"(?:([^\s:\[]{1,32})(?:\[(\d{1,10})\])?:?[ ]?)?+([\s\S]*)\z"
)
_SD_VALUE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?'
_SD_ELEMENT = rf"\[[^ \]]*(?:[ ]+[^=]*={_SD_VALUE})*+\]?"


def decode_raw(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``text`` (working copy without a byte-order mark) and ``bom_stripped``."""
    return df.withColumn("text", decode_text(F.col(raw))).withColumn("bom_stripped", has_bom(F.col(raw)))


def split_syslog(text: Column) -> Column:
    """``struct(envelope MAP, message, header_raw)``; the envelope is null for a bare line.

    ``header_raw + message`` is always the original text.
    """
    pri = F.regexp_extract(text, r"^<(\d{1,3})>", 1)
    by_version = text.rlike(r"^<\d{1,3}>\d{1,3} ")
    new = F.when(by_version, capture(text, _RFC5424, 8)).otherwise(F.array().cast("array<string>"))

    def build(s: Column) -> Column:
        old = F.when(~matched(s["new"]), capture(text, _RFC3164, 6)).otherwise(F.array().cast("array<string>"))
        return let(F.struct(s["pri"].alias("pri"), s["new"].alias("new"), old.alias("old")), dress)

    def dress(s: Column) -> Column:
        p = s["pri"].try_cast("int")
        base = [
            ("pri", s["pri"].try_cast("int").cast("string")),
            ("pri_raw", F.concat(F.lit("<"), s["pri"], F.lit(">"))),
            ("facility", F.floor(p / 8).cast("string")),
            ("facility_name", F.coalesce(F.get(_names(FACILITIES), F.floor(p / 8).cast("int")), F.floor(p / 8).cast("string"))),
            ("severity", (p % 8).cast("string")),
            ("severity_name", F.get(_names(SEVERITIES), p % 8)),
        ]
        n, o = s["new"], s["old"]

        def rfc5424() -> Column:
            tail = group(n, 8)
            nil = tail.rlike(r"^-(?: |\z)")
            sd = F.when(nil, "-").when(tail.startswith("["), F.regexp_extract(tail, rf"^((?:{_SD_ELEMENT})+)", 1)).otherwise("")
            rest = F.regexp_replace(F.substring(tail, F.length(sd) + 1, F.length(tail)), r"^ ", "")
            message = F.when(sd == "", tail).otherwise(rest)
            pairs = list(base) + [("format", F.lit("rfc5424")), ("version", group(n, 2).try_cast("int").cast("string"))]
            for i, name in enumerate(["timestamp", "hostname", "app_name", "procid", "msgid"], start=3):
                pairs += [(name, F.nullif(group(n, i), F.lit("-"))), (f"{name}_raw", group(n, i))]
            pairs += [("structured_data_raw", sd), ("header_raw", _head(text, message))]
            plain = _entries(pairs)
            return _result(F.when(sd.startswith("["), F.map_concat(plain, _structured(sd))).otherwise(plain), message)

        def rfc3164() -> Column:
            tag = F.nullif(group(o, 4), F.lit(""))
            message = group(o, 6)
            pairs = base + [
                ("format", F.lit("rfc3164")), ("timestamp", group(o, 2)), ("timestamp_raw", group(o, 2)),
                ("hostname", group(o, 3)), ("tag", tag), ("app_name", tag),
                ("procid", F.nullif(group(o, 5), F.lit(""))), ("header_raw", _head(text, message)),
            ]
            return _result(_entries(pairs), message)

        message = F.regexp_replace(text, r"^<\d{1,3}>", "")
        bare = _result(_entries(base + [("format", F.lit("pri_only")), ("header_raw", _head(text, message))]), message)
        return F.when(matched(n), rfc5424()).when(matched(o), rfc3164()).otherwise(bare)

    parts = F.struct(pri.alias("pri"), new.alias("new"))
    none = _result(F.lit(None).cast("map<string,string>"), text)
    return F.when(pri == "", none).otherwise(let(parts, build))


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _head(text: Column, message: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(message))


def _entries(pairs: list[tuple[str, Column]]) -> Column:
    flat = [x for name, value in pairs for x in (F.lit(name), value)]
    return F.create_map(*flat)


def _result(envelope: Column, message: Column) -> Column:
    return F.struct(envelope.alias("envelope"), message.alias("message"))


def _structured(sd: Column) -> Column:
    """Structured-data elements as ``structured_data.<id>.<param>`` entries."""

    def element(e: Column) -> Column:
        key = F.concat(F.lit("structured_data."), F.regexp_extract(e, r"^\[([^ \]]*)", 1))
        param = lambda p: F.struct(
            F.concat(key, F.lit("."), F.regexp_replace(F.substring_index(p, "=", 1), "^ +", "")).alias("key"),
            F.regexp_replace(
                F.regexp_extract(p, r'="([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)', 1), r"\\([\s\S])", "$1"
            ).alias("value"),
        )
        params = F.transform(F.regexp_extract_all(e, F.lit(rf" +([^=]*={_SD_VALUE})"), F.lit(0)), param)
        return F.when(F.size(params) > 0, params).otherwise(F.array(F.struct(key.alias("key"), F.lit("{}").alias("value"))))

    elements = F.regexp_extract_all(sd, F.lit(_SD_ELEMENT), F.lit(0))
    return F.map_from_entries(F.flatten(F.transform(F.when(sd.startswith("["), elements).otherwise(F.array().cast("array<string>")), element)))


def strip_syslog(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``envelope`` and ``message``."""
    cut = df.withColumn("_cut", split_syslog(F.col(text)))
    return cut.withColumn("envelope", F.col("_cut.envelope")).withColumn("message", F.col("_cut.message")).drop("_cut")


def sniff(text: Column, prefix: int = 200) -> Column:
    """Format of one line; the first test that holds decides. A CEF or LEEF marker counts in the first ``prefix`` characters."""
    head = F.substring(text, 1, prefix)
    count = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    return (
        F.when(text.rlike(r"^<\d+>"), "syslog")
        .when(F.contains(head, F.lit("CEF:")), "cef")
        .when(F.contains(head, F.lit("LEEF:")), "leef")
        .when(text.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "json")
        .when(count("\t") >= 3, "tsv")
        .when(F.regexp_count(text, F.lit(r"[^\s=]=")) >= 3, "kv")
        .when(count(",") >= 8, "csv")
        .otherwise("unknown")
    )


def sniff_inner(outer: Column, message: Column, tag: Column) -> Column:
    """Format inside a syslog envelope; a tag that swallowed a ``CEF:`` marker is glued back."""
    glued = F.when(F.coalesce(tag, F.lit("")) != "", sniff(F.concat(tag, F.lit(":"), message)))
    inner = let(sniff(message), lambda f: F.when(f == "unknown", F.coalesce(glued, f)).otherwise(f))
    return F.when(outer == "syslog", inner).otherwise(outer)


def sniff_layered(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``outer_format``, ``inner_format``, ``envelope`` and ``message``."""
    cut = strip_syslog(df.withColumn("outer_format", sniff(F.col(text))), text)
    inner = sniff_inner(F.col("outer_format"), F.col("message"), F.element_at(F.col("envelope"), "tag"))
    return cut.withColumn("inner_format", inner)


def envelope_fields(envelope: Column) -> Column:
    """Envelope entries under ``envelope.<name>`` (empty map for a bare line)."""
    renamed = F.transform_keys(envelope, lambda k, v: F.concat(F.lit("envelope."), k))
    return F.coalesce(renamed, F.create_map().cast("map<string,string>"))
