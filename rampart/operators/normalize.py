"""Matching lines to source definitions and mapping their fields to flat OCSF records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rampart.definitions import Activity, Definition, Field, ordered
from rampart.functions import ocsf
from rampart.functions.memo import memo
from rampart.functions.coerce import SPARK_TYPES, coerce
from rampart.functions.text import canonical_json
from rampart.functions.times import parse_ts_ns
from rampart.operators import engines
from rampart.operators.envelope import envelope_fields, sniff_inner, sniff, split_syslog

SELF_DESCRIBING = ("json", "kv", "cef", "leef")
# envelope numbers stay numbers in unmapped JSON
_NUMERIC_ENVELOPE = r'"(envelope\.(?:pri|facility|severity|version))":"(\d+)"'


# -- matching ----------------------------------------------------------------------


def compile_detect(rule: dict, text: Column, parsed_field) -> Column:
    """One detect rule as a predicate; ``parsed_field(name)`` gives a sniffed field."""
    (key, value), = rule.items()
    if key == "contains":
        return F.contains(text, F.lit(value))
    if key == "starts_with":
        return text.startswith(value)
    if key == "regex":
        return text.rlike(value)
    if key in ("all", "any"):
        out = None
        for child in value:
            test = compile_detect(child, text, parsed_field)
            out = test if out is None else (out & test if key == "all" else out | test)
        return out
    if key == "field_equals":
        return F.coalesce(parsed_field(value["name"]) == F.lit(str(value["value"])), F.lit(False))
    delimiter = value["delimiter"]
    count = ((F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))) / len(delimiter)).cast("int") + 1
    tests = {"equals": lambda b: count == b, "min": lambda b: count >= b, "max": lambda b: count <= b}
    out = F.lit(True)
    for name, test in tests.items():
        out = out & test(value[name]) if value.get(name) is not None else out
    return out


def _sniffed_field(inner: Column, payload: Column, flat: Column | None):
    """A field of the self-describing parse; evaluated only where a predicate asks for it."""

    def at(name: str) -> Column:
        other = F.lit(None).cast("string")
        for fmt in ("kv", "cef", "leef"):
            other = F.when(inner == fmt, F.element_at(engines.ENGINES[fmt](payload, {})["fields"], name)).otherwise(other)
        json_value = F.element_at(engines.flatten_json(payload) if flat is None else flat, name)
        return F.when(inner == "json", engines.variant_text(json_value)).otherwise(other)

    return at


def match_column(defs: list[Definition], text: Column, parsed_field) -> Column:
    """Name of the first definition that claims the line, null when none does."""
    return F.coalesce(*[F.when(compile_detect(d.detect, text, parsed_field), d.name) for d in ordered(defs)], F.lit(None).cast("string"))


def prepare(df: DataFrame) -> DataFrame:
    """Add ``envelope``, ``message``, ``outer_format``, ``inner_format``, ``payload`` and ``json_flat``."""
    cut, outer, inner, flat = memo("prepare", [], lambda: (
        split_syslog(F.col("text")), sniff(F.col("text")),
        sniff_inner(F.col("outer_format"), F.col("message"), F.element_at(F.col("envelope"), "tag")), engines.flatten_json(F.col("payload")),
    ))
    out = df.withColumn("_cut", cut).withColumn("outer_format", outer)
    out = out.withColumn("envelope", F.col("_cut.envelope")).withColumn("message", F.col("_cut.message")).drop("_cut")
    out = out.withColumn("inner_format", inner)
    whole = F.col("inner_format").isin("cef", "leef")
    out = out.withColumn("payload", F.when(whole, F.col("text")).otherwise(F.col("message")))
    return out.withColumn("json_flat", F.when(F.col("inner_format") == "json", flat))


def match_source(df: DataFrame, defs: list[Definition]) -> DataFrame:
    """Add ``source_type`` to lines in ``text``; expects :func:`prepare` columns or adds them."""
    out = df if "json_flat" in df.columns else prepare(df)

    def build() -> Column:
        sniffed = _sniffed_field(F.col("inner_format"), F.col("payload"), F.col("json_flat"))
        return match_column(defs, F.col("text"), sniffed)

    return out.withColumn("source_type", memo("match", defs, build))


def sniffed_fields(df: DataFrame) -> Column:
    """Fields of the self-describing parse of each line, with its envelope; empty when there is none."""
    return memo("sniffed", [], _sniffed_columns)


def _sniffed_columns() -> Column:
    out = F.create_map().cast("map<string,string>")
    for fmt in ("kv", "cef", "leef"):
        out = F.when(F.col("inner_format") == fmt, engines.ENGINES[fmt](F.col("payload"), {})["fields"]).otherwise(out)
    out = F.when(F.col("inner_format") == "json", engines.json_texts(F.col("json_flat"))).otherwise(out)
    return F.map_concat(F.coalesce(out, F.create_map().cast("map<string,string>")), envelope_fields(F.col("envelope")))


# -- authoritative parse ---------------------------------------------------------------


def parse_matched(df: DataFrame, defs: list[Definition]) -> DataFrame:
    """Add ``fields`` and ``parse_error`` by each row's own definition (envelope fields merged in)."""
    parsed, merged = memo("parse", defs, lambda: _parse_columns(defs))
    return df.withColumn("_p", parsed).withColumn("fields", merged).withColumn("parse_error", F.col("_p.error")).drop("_p")


def _parse_columns(defs: list[Definition]) -> tuple[Column, Column]:
    text, message = F.col("text"), F.col("message")
    none = F.struct(F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("string").alias("error"))
    out = none
    for d in reversed(ordered(defs)):
        payload = message if d.envelope == "syslog" and d.engine not in ("cef", "leef") else text
        if d.engine == "json" and d.options in ({}, {"array_mode": "flatten"}):
            usable = (F.lit(True) if d.envelope == "syslog" else F.col("envelope").isNull()) & F.col("json_flat").isNotNull()
            good = F.struct(engines.json_texts(F.col("json_flat")).alias("fields"), F.lit(None).cast("string").alias("error"))
            result = F.when(usable, good).otherwise(engines.ENGINES["json"](payload, d.options))
        else:
            result = engines.ENGINES[d.engine](payload, d.options)
        out = F.when(F.col("source_type") == d.name, result).otherwise(out)
    with_env = [d.name for d in defs if d.envelope == "syslog"]
    merged = F.when(
        F.col("source_type").isin(with_env) & F.col("envelope").isNotNull(),
        F.map_concat(F.col("_p.fields"), envelope_fields(F.col("envelope"))),
    ).otherwise(F.col("_p.fields"))
    return out, merged


# -- mapping ---------------------------------------------------------------------------


def _present(name: str) -> Column:
    return F.nullif(F.element_at(F.col("fields"), name), F.lit(""))


def _raw(f: Field) -> Column:
    """Source text of a mapping: first present field, or all present ones joined."""
    values = [_present(s) for s in f.sources]
    if f.join is not None and len(values) > 1:
        return F.nullif(F.concat_ws(f.join, *values), F.lit(""))
    return F.coalesce(*values) if len(values) > 1 else values[0]


def _path_value(path: str, kind: str, defs: list[Definition]) -> Column:
    """The value of one target path over all definitions.

    Source texts are picked per definition first, so each typed reading (address, timestamp
    layout) appears once in the plan however many definitions share it.
    """
    fields = [(d, f) for d in defs for f in d.fields if f.path == path]
    readings: dict[tuple, dict[str, Field]] = {}
    fixed: dict[str, Column] = {}
    for d, f in fields:
        if f.values is not None:
            fixed[d.name] = F.coalesce(ocsf.lookup(f.values, _raw(f)).cast(kind), F.lit(f.default).cast(kind))
        else:
            readings.setdefault((f.type, f.format, f.tz), {})[d.name] = f
            if f.default is not None:
                fixed[d.name] = F.when(_raw(f).isNull(), F.lit(f.default).cast(kind))
    parts = []
    for (typ, fmt, tz), by_name in readings.items():
        text = _per_source(defs, lambda d: _raw(by_name[d.name]) if d.name in by_name else None, "string")
        parts.append(coerce(text, typ, fmt, tz, F.col("ingest_time_ns")).cast(kind))
    parts.append(_per_source(defs, lambda d: fixed.get(d.name), kind))
    parts.append(_per_source(defs, lambda d: F.lit(d.constants[path]).cast(kind) if path in d.constants else None, kind))
    return F.coalesce(*parts)


def path_types(defs: list[Definition]) -> dict[str, str]:
    """Spark type of every target path; a path with differing types becomes text."""
    kinds: dict[str, set[str]] = {}
    for d in defs:
        for path, value in d.constants.items():
            kinds.setdefault(path, set()).add("bigint" if isinstance(value, int) and not isinstance(value, bool) else "string")
        for f in d.fields:
            kinds.setdefault(f.path, set()).add(SPARK_TYPES[f.result_type])
    core = dict.fromkeys(["severity_id", "action_id", "status_id", "time", "src_endpoint.port", "dst_endpoint.port",
                          "connection_info.protocol_num", "connection_info.direction_id", "traffic.bytes",
                          "traffic.bytes_in", "traffic.bytes_out", "traffic.packets", "traffic.packets_in",
                          "traffic.packets_out"], "bigint")
    core |= dict.fromkeys(["src_endpoint.ip", "dst_endpoint.ip", "connection_info.protocol_name",
                           "connection_info.direction", "action", "disposition", "activity_name"], "string")
    return core | {p: next(iter(k)) if len(k) == 1 else "string" for p, k in kinds.items()}


def _activity(d: Definition) -> Column:
    if isinstance(d.activity, Activity):
        found = ocsf.lookup(d.activity.values, _present(d.activity.source))
        return F.coalesce(found, F.lit(d.activity.default)).cast("bigint")
    return F.lit(d.activity).cast("bigint")


def _per_source(defs: list[Definition], expression, kind: str) -> Column:
    """``CASE source_type WHEN .. END`` over the definitions for which ``expression`` is not None."""
    out = None
    for d in defs:
        value = expression(d)
        if value is not None:
            test = F.col("source_type") == d.name
            out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast(kind) if out is None else out.cast(kind)


def _mapping_error(d: Definition) -> Column:
    """First failed mapping in file order as ``struct(reason, target, value)``."""

    def failed(reason: str, f: Field) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(f.path).alias("target"), _raw(f).alias("value"))

    tests = []
    for f in d.fields:
        value = ocsf.col(f.path)
        if f.values is None and f.type != "str":
            tests.append(F.when(value.isNull() & _raw(f).isNotNull(), failed(f"invalid_{f.type}", f)))
        if f.required:
            tests.append(F.when(value.isNull(), failed("required_unresolved", f)))
    return F.coalesce(*tests) if tests else None


def unmapped_fields(d: Definition) -> Column:
    """Fields whose values no mapping used; null values are left out."""
    present = lambda k, v: v.isNotNull()
    if d.unmapped == "drop":
        return F.lit(None).cast("map<string,string>")
    always, choices = set(), []
    for f in d.fields:
        if len(f.sources) == 1 or f.join is not None:
            always.update(f.sources)  # used whenever present
        else:
            choices.append(F.coalesce(*[F.when(_present(s).isNotNull(), s) for s in f.sources]))
    if isinstance(d.activity, Activity):
        always.add(d.activity.source)
    kept = (lambda k: F.lit(True)) if d.unmapped == "keep_all" else (lambda k: k.isin(list(d.unmapped)))
    chosen = F.array(*choices) if choices else None

    def unused(k: Column, v: Column) -> Column:
        test = present(k, v) & kept(k) & ~(k.isin(sorted(always)) & (v != ""))
        return test if chosen is None else test & ~(F.coalesce(F.array_contains(chosen, k), F.lit(False)) & (v != ""))

    return F.map_filter(F.col("fields"), unused)


def _unmapped_json(json_names: list[str]) -> Column:
    plain = F.regexp_replace(canonical_json(F.col("unmapped")), _NUMERIC_ENVELOPE, '"$1":$2')
    plain = F.replace(plain, F.lit('"_truncated":"True"'), F.lit('"_truncated":true'))
    keys = F.col("unmapped")
    typed = F.map_filter(F.col("json_flat"), lambda k, v: F.map_contains_key(keys, k) & ~F.is_variant_null(v))
    rest = F.map_filter(keys, lambda k, v: k.startswith("envelope."))
    both = F.map_concat(typed, F.transform_values(rest, lambda k, v: v.cast("variant")))
    typed_json = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))
    return F.when(F.col("source_type").isin(json_names) & F.col("json_flat").isNotNull(), F.when(F.size(keys) > 0, typed_json)).otherwise(plain)


def map_fields(df: DataFrame, defs: list[Definition]) -> DataFrame:
    """Add the flat OCSF columns, ``unmapped``, ``unmapped_json`` and ``mapping_error``.

    Needs ``event_uid, raw_hash, ingest_time_ns, source_type, fields``; ``json_flat`` is
    used for typed leftovers when present.
    """
    defs = ordered(defs)
    json_names = [d.name for d in defs if d.engine == "json"] if "json_flat" in df.columns else []
    values, derived, leftovers = memo("map", defs, lambda: _map_columns(defs, json_names), tuple(json_names))
    return df.withColumns(values).withColumns(derived).withColumn("unmapped_json", leftovers)


def _map_columns(defs: list[Definition], json_names: list[str]) -> tuple[dict[str, Column], dict[str, Column], Column]:
    types = path_types(defs)
    ids = {"class_uid": lambda d: d.class_uid, "category_uid": lambda d: d.category_uid}
    columns = {name: _per_source(defs, lambda d, get=get: F.lit(get(d)), "bigint") for name, get in ids.items()}
    columns["activity_id"] = _per_source(defs, _activity, "bigint")
    for path, kind in types.items():
        if path in columns or path == "type_uid":
            continue
        columns[path] = _path_value(path, kind, defs)
    error = _per_source(defs, _mapping_error, "struct<reason:string,target:string,value:string>")
    derived = {
        "mapping_error": error,
        "unmapped": _per_source(defs, unmapped_fields, "map<string,string>"),
        "mapping_version": _per_source(defs, lambda d: F.lit(d.version), "string"),
        "metadata.uid": F.col("event_uid"),
        "metadata.log_hash": F.col("raw_hash"),
        "metadata.version": F.lit(ocsf.VERSION),
    }
    plain = F.regexp_replace(canonical_json(F.col("unmapped")), _NUMERIC_ENVELOPE, '"$1":$2')
    return columns, derived, _unmapped_json(json_names) if json_names else plain


# -- lines nobody claims -----------------------------------------------------------------


def template_only(df: DataFrame, source_type: Column | None = None) -> DataFrame:
    """Skeleton records of unmatched lines: class 4001, envelope or ingest time, all fields unmapped."""
    stamp = F.element_at(F.col("envelope"), "timestamp")
    time = F.coalesce(parse_ts_ns(stamp, now_ns=F.col("ingest_time_ns")), F.col("ingest_time_ns"))
    fields = sniffed_fields(df)
    return ocsf.finalize(df.withColumns({
        "class_uid": F.lit(4001).cast("bigint"), "category_uid": F.lit(4).cast("bigint"), "time": time,
        "metadata.uid": F.col("event_uid"), "metadata.log_hash": F.col("raw_hash"), "metadata.version": F.lit(ocsf.VERSION),
        "unmapped": F.map_filter(fields, lambda k, v: v.isNotNull()), "unmapped_json": canonical_json(fields),
        "source_type": F.lit("unknown") if source_type is None else source_type, "mapping_version": F.lit("none"),
        "enrichments_json": F.lit('{"parse_status":"template_only"}'),
    }))
