"""Between nested OCSF records, flat dotted columns and the silver layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rampart.functions.ocsf import col, has, optional
from rampart.functions.text import canonical_json
from rampart.schemas import SILVER_CORE

INTERNAL = ["ingest_time_ns", "mapping_version", "source_id", "transport", "peer", "raw_len", "unmapped", "completeness",
            "inner_format", "network_context", "threat_intel", "geoip", "attack"]


def flatten_ocsf(df: DataFrame, column: str = "ocsf") -> DataFrame:
    """Replace a nested struct by dotted columns; lists become JSON text, ``unmapped`` and
    ``enrichments`` become ``*_json`` text."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind.fields:
            here = [*path, f.name]
            ref = F.col(".".join(f"`{p}`" for p in [column, *here]))
            name = ".".join(here)
            if name in ("unmapped", "enrichments"):
                text = ref if isinstance(f.dataType, T.StringType) else canonical_json(ref) if isinstance(f.dataType, T.MapType) else F.to_json(ref)
                out.append(text.alias(f"{name}_json"))
            elif isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.when(F.size(ref) > 0, F.to_json(ref)).alias(name))
            else:
                out.append(ref.alias(name))

    walk(df.schema[column].dataType, [])
    rest = [c for c in df.columns if c != column]
    return df.select(*[col(c) for c in rest], *out)


def core_columns(df: DataFrame) -> dict[str, Column]:
    """The 17 fixed silver columns from their well-known paths."""
    protocol = F.coalesce(F.nullif(optional(df, "connection_info.protocol_name"), F.lit("")),
                          optional(df, "connection_info.protocol_num", "bigint").cast("string"))
    paths = {"src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip",
             "dst_port": "dst_endpoint.port", "bytes_in": "traffic.bytes_in", "bytes_out": "traffic.bytes_out"}
    out = {}
    for name, kind in SILVER_CORE.items():
        path = paths.get(name, name)
        source = protocol if name == "protocol" else optional(df, path, kind)
        out[name] = source.try_cast(kind) if kind == "bigint" and dict(df.dtypes).get(path) == "string" else source.cast(kind)
    return out


def to_silver(df: DataFrame) -> DataFrame:
    """Flat records to silver rows: core columns first, then every other dotted column."""
    core = core_columns(df)
    json_columns = [c for c in ("unmapped_json", "enrichments_json") if has(df, c)]
    extra = [c for c in df.columns if c not in core and c not in json_columns and c not in INTERNAL and c != "date"]
    carried = ["ingest_time_ns"] if has(df, "ingest_time_ns") else []
    plain = lambda c: F.to_json(col(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else col(c)
    return df.select(
        *[c.alias(n) for n, c in core.items()], *[plain(c).alias(c) for c in extra],
        optional(df, "unmapped_json").alias("unmapped_json"), optional(df, "enrichments_json").alias("enrichments_json"),
        *[F.col(c) for c in carried],
    )


def unflatten(df: DataFrame, column: str = "record") -> DataFrame:
    """One nested struct per silver row from its dotted columns; ``*_json`` columns become variants
    and the partition column ``date`` is left out. Structs without any value are null."""
    tree: dict = {}
    for name in df.columns:
        if name == "date":
            continue
        node = tree
        *parents, leaf = [name.removesuffix("_json")] if name in ("unmapped_json", "enrichments_json") else name.split(".")
        for p in parents:
            child = node.get(p)
            node[p] = child = child if isinstance(child, dict) else {}
            node = child
        if not isinstance(node.get(leaf), dict):
            node[leaf] = name

    def build(node: dict) -> tuple[Column, Column]:
        parts, any_set = [], F.lit(False)
        for key, value in node.items():
            if isinstance(value, dict):
                child, present = build(value)
                child = F.when(present, child)
            else:
                child = F.try_parse_json(col(value)) if value in ("unmapped_json", "enrichments_json") else col(value)
                present = col(value).isNotNull()
            parts.append(child.alias(key))
            any_set = any_set | present
        return F.struct(*parts), any_set

    return df.withColumn(column, build(tree)[0])
