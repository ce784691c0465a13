"""Address, domain and hash lookups against reference tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rampart.functions.ip import canonical_ip, ip_bits, is_private
from rampart.functions.text import let, strip
from rampart.session import BROADCAST_ROWS, at_most, broadcast_if_small

# Tables of at most this many ranges become literals of the expression.
LITERAL_RANGES = 64
# Up to this many prefix lengths a size-checked table is broadcast and probed once per length.
PROBED_LENGTHS = 12


def with_prefixes(cidrs: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Add ``_bits`` (network digits cut to the prefix), ``_len`` and drop unreadable ranges.

    A missing prefix means a single host; host bits are ignored. Of equal ranges the
    one that sorts last stays.
    """
    base, length = F.substring_index(F.col(cidr), "/", 1), F.get(F.split(F.col(cidr), "/"), F.lit(1)).try_cast("int")
    out = cidrs.withColumn("_full", ip_bits(strip(base))).filter(F.col("_full").isNotNull())
    out = out.withColumn("_len", F.coalesce(length, F.length("_full"))).filter(F.col("_len").between(0, F.length("_full")))
    out = out.withColumn("_bits", F.substring(F.col("_full"), F.lit(1), F.col("_len")))
    return out.withColumn("_width", F.length("_full")).drop("_full")


def _range_table(cidrs: DataFrame, values: list[str], cidr: str) -> DataFrame:
    best = F.max_by(F.struct(*values), F.struct(F.col(cidr), *values))
    return with_prefixes(cidrs, cidr).groupBy("_width", "_len", "_bits").agg(best.alias("_v"))


def range_probe(cidrs: DataFrame, values: list[str], cidr: str = "cidr") -> Callable[[Column], Column] | None:
    """For a table of few ranges: a function from an address column to the struct of ``values`` of its
    longest range (null without one). None when the table is larger."""
    few = _range_table(cidrs, values, cidr).limit(LITERAL_RANGES + 1).collect()
    if len(few) > LITERAL_RANGES:
        return None
    few.sort(key=lambda r: -r["_len"])
    types = {v: cidrs.schema[v].dataType for v in values}
    results = F.array(*[F.struct(*[F.lit(r["_v"][v]).cast(types[v]).alias(v) for v in values]) for r in few])

    def probe(ip: Column) -> Column:
        def first(bits: Column) -> Column:
            tests = [F.when((F.length(bits) == r["_width"]) & bits.startswith(r["_bits"]), F.lit(i)) for i, r in enumerate(few)]
            return F.coalesce(*tests, F.lit(None).cast("int"))

        nothing = F.lit(None).cast("struct<" + ",".join(f"`{v}`:{t.simpleString()}" for v, t in types.items()) + ">")
        return F.get(results, let(ip_bits(ip), first)) if few else nothing

    return probe


def cidr_lookup_join(df: DataFrame, ip_col: str, cidrs: DataFrame, values: list[str], prefix: str = "", cidr: str = "cidr") -> DataFrame:
    """Each row with the ``values`` of the longest range holding its address (IPv4 and IPv6), else nulls.

    A few ranges become literals of one expression. Otherwise a range test is an equality on
    the first digits of the address, so it is an equi join per prefix length: a table proven small
    is broadcast and probed length by length without moving the events, a larger one meets the
    distinct addresses only and the result joins back on the address with adaptive skew handling.
    """
    names = [f"{prefix}{v}" for v in values]
    probe = range_probe(cidrs, values, cidr)
    if probe is not None:
        hit = df.withColumn("_v", probe(F.col(ip_col)))
        return hit.withColumns({n: F.col(f"_v.`{v}`") for n, v in zip(names, values)}).drop("_v")
    table = _range_table(cidrs, values, cidr)
    lengths = sorted((r["_width"], r["_len"]) for r in table.select("_width", "_len").distinct().collect())  # <= 162 rows
    if len(lengths) <= PROBED_LENGTHS and at_most(table, BROADCAST_ROWS):
        return _probe_inline(df, ip_col, table, lengths, values, names)
    ips = df.select(F.col(ip_col).alias("_ip")).filter(F.col("_ip").isNotNull()).distinct()
    keyed = ips.withColumn("_full", ip_bits(F.col("_ip"))).filter(F.col("_full").isNotNull())
    options = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in lengths])
    tried = keyed.withColumn("_o", F.explode(F.filter(options, lambda o: o["w"] == F.length("_full")))).select(
        "_ip", F.col("_o.w").alias("_width"), F.col("_o.n").alias("_len"), F.substring(F.col("_full"), F.lit(1), F.col("_o.n")).alias("_bits")
    )
    hits = tried.join(broadcast_if_small(table), ["_width", "_len", "_bits"]).groupBy("_ip").agg(F.max_by("_v", "_len").alias("_v"))
    joined = df.join(hits, df[ip_col] == hits["_ip"], "left")
    return joined.withColumns({n: F.col(f"_v.`{v}`") for n, v in zip(names, values)}).drop("_ip", "_v")


def _probe_inline(df: DataFrame, ip_col: str, table: DataFrame, lengths: list[tuple[int, int]], values, names) -> DataFrame:
    out = df.withColumn("_full", ip_bits(F.col(ip_col)))
    found = []
    for i, (width, length) in enumerate(sorted(lengths, key=lambda x: -x[1])):
        part = table.filter((F.col("_width") == width) & (F.col("_len") == length)).select(F.col("_bits").alias(f"_b{i}"), F.col("_v").alias(f"_v{i}"))
        key = F.when(F.length("_full") == width, F.substring("_full", 1, length))
        out = out.join(F.broadcast(part), key == F.col(f"_b{i}"), "left").drop(f"_b{i}")
        found.append(F.col(f"_v{i}"))
    out = out.withColumn("_v", F.coalesce(*found))
    return out.withColumns({n: F.col(f"_v.`{v}`") for n, v in zip(names, values)}).drop("_full", "_v", *[f"_v{i}" for i in range(len(lengths))])


# -- indicators ---------------------------------------------------------------------------

HIT = "struct<indicator:string,ioc_type:string,ioc_source:string,confidence:string>"


def ioc_counts(iocs: DataFrame) -> dict[str, int]:
    """Indicators per kind (four rows), to decide once which are broadcast."""
    return {r["ioc_type"]: r["count"] for r in iocs.groupBy("ioc_type").count().collect()}


def _sized(df: DataFrame, kind: str, sizes: dict[str, int] | None) -> DataFrame:
    if sizes is None:
        return broadcast_if_small(df)
    return F.broadcast(df) if sizes.get(kind, 0) <= BROADCAST_ROWS else df


def _hits(iocs: DataFrame, kind: str) -> DataFrame:
    """One row per indicator of a kind; of repeated ones the last by source order stays."""
    rows = iocs.filter(F.col("ioc_type") == kind)
    hit = F.struct(F.col("indicator"), F.col("ioc_type"), F.col("ioc_source"), F.col("confidence"))
    order = F.struct(F.col("file") if "file" in iocs.columns else F.col("ioc_source"), F.col("ioc_source"), F.col("confidence"))
    return rows.groupBy(F.col("indicator").alias("_key")).agg(F.max_by(hit, order).alias("_hit"))


def ioc_ip_join(df: DataFrame, ip_col: str, iocs: DataFrame, out: str = "hit", sizes: dict[str, int] | None = None) -> DataFrame:
    """Exact address match first, then the longest matching range."""
    exact = _hits(iocs, "ip").withColumnRenamed("_hit", "_exact")
    df = df.withColumn("_c", canonical_ip(F.col(ip_col)))
    df = df.join(_sized(exact, "ip", sizes), F.col("_c") == F.col("_key"), "left").drop("_key")
    ranges = iocs.filter(F.col("ioc_type") == "cidr").withColumn("cidr", F.col("indicator"))
    columns = ["indicator", "ioc_type", "ioc_source", "confidence"]
    df = cidr_lookup_join(df, "_c", ranges, columns, prefix="_r_")
    ranged = F.when(F.col("_r_indicator").isNotNull(), F.struct(*[F.col(f"_r_{c}").alias(c) for c in columns]))
    return df.withColumn(out, F.coalesce(F.col("_exact"), ranged)).drop("_c", "_exact", *[f"_r_{c}" for c in columns])


def domain_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first, without the bare top-level domain
    (a single-label host is tested as it stands)."""
    labels = F.split(F.rtrim(F.lower(strip(host)), F.lit(".")), r"\.")
    steps = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(steps, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ioc_domain_join(df: DataFrame, host_col: str, iocs: DataFrame, out: str = "hit") -> DataFrame:
    """Exact host match, then each parent domain; the deepest match wins.

    Distinct hosts are expanded to their suffixes and met with the indicators; events join back by host.
    """
    return join_hosts(df, {host_col: out}, iocs)


def join_hosts(df: DataFrame, columns: dict[str, str], iocs: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Domain matches of several host columns (host column -> hit column) from one pass over their distinct hosts."""
    every = F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))))
    hosts = df.select(every.alias("_host")).distinct()
    tried = hosts.select("_host", F.posexplode(domain_suffixes(F.col("_host"))).alias("_depth", "_suffix"))
    domains = _sized(_hits(iocs, "domain"), "domain", sizes)
    found = tried.join(domains, F.col("_suffix") == F.col("_key")).groupBy("_host").agg(F.min_by("_hit", "_depth").alias("_found"))
    small = at_most(found, BROADCAST_ROWS)  # only hosts that matched come back
    for host_col, out in columns.items():
        named = found.select(F.col("_host").alias(f"_host_{out}"), F.col("_found").alias(out))
        df = df.join(F.broadcast(named) if small else named, F.col(f"`{host_col}`") == F.col(f"_host_{out}"), "left").drop(f"_host_{out}")
    return df


def ioc_hash_join(df: DataFrame, hash_col: str, iocs: DataFrame, out: str = "hit", sizes: dict[str, int] | None = None) -> DataFrame:
    """Case-insensitive digest match."""
    found = _hits(iocs, "hash").withColumnRenamed("_hit", out)
    return df.join(_sized(found, "hash", sizes), F.lower(strip(F.col(hash_col))) == F.col("_key"), "left").drop("_key")


def geo_join(df: DataFrame, ip_col: str, geo: DataFrame, asn: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """City and network fields for public addresses from tables of ranges."""
    public = F.when(~is_private(F.col(ip_col)), F.col(ip_col))
    df = df.withColumn("_pub", public)
    df = cidr_lookup_join(df, "_pub", geo, [c for c in geo.columns if c != "cidr"], prefix)
    if asn is not None:
        df = cidr_lookup_join(df, "_pub", asn, [c for c in asn.columns if c != "cidr"], prefix)
    return df.drop("_pub")


def zone_join(df: DataFrame, ip_col: str, zones: DataFrame, prefix: str = "") -> DataFrame:
    """``zone`` and ``criticality`` of each address."""
    return cidr_lookup_join(df, ip_col, zones, ["zone", "criticality"], prefix)
