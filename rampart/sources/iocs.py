"""Indicator files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rampart.functions.ip import canonical_ip, ip_bits
from rampart.functions.text import strip

IOC_TYPES = ("ip", "domain", "hash", "cidr")


def canonical_network(c: Column) -> Column:
    """A range in canonical form with host bits cleared; null when it is no range."""
    base, length = F.substring_index(c, "/", 1), F.get(F.split(c, "/"), F.lit(1)).try_cast("int")
    bits = ip_bits(base)
    width = F.length(bits)
    size = F.coalesce(length, F.when(F.size(F.split(c, "/")) == 1, width))
    network = F.rpad(F.substring(bits, F.lit(1), size), 128, "0")
    v4 = F.array_join(F.array(*[F.conv(F.substring(network, 8 * i + 1, 8), 2, 10) for i in range(4)]), ".")
    v6 = F.array_join(F.array(*[F.lower(F.conv(F.substring(network, 16 * i + 1, 16), 2, 16)) for i in range(8)]), ":")
    text = F.when(width == 32, v4).when(width == 128, canonical_ip(v6))
    return F.when(size.between(0, width), F.concat(text, F.lit("/"), size.cast("string")))


def normalise_indicator(kind: Column, item: Column) -> Column:
    """Canonical indicator text; null for a malformed address or range."""
    text = strip(item)
    return (
        F.when(kind == "ip", canonical_ip(text)).when(kind == "cidr", canonical_network(text))
        .otherwise(F.rtrim(F.lower(text), F.lit(".")))
    )


def read_iocs(spark: SparkSession, folder: str) -> DataFrame:
    """``indicator, ioc_type, ioc_source, confidence, file`` of all ``*.json`` files of a folder.

    A file with an unknown type, a missing part or one malformed indicator is refused as a whole.
    """
    schema = "type string, source string, confidence string, indicators array<string>"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    files = files.select("*", F.col("_metadata.file_path").alias("file"))
    whole = files.filter(F.col("type").isin(*IOC_TYPES) & F.col("source").isNotNull() & F.col("indicators").isNotNull())
    clean = whole.withColumn("_n", F.transform("indicators", lambda i: normalise_indicator(F.col("type"), i)))
    good = clean.filter(~F.exists("_n", lambda i: i.isNull()))
    return good.select(F.explode("_n").alias("indicator"), F.col("type").alias("ioc_type"), F.col("source").alias("ioc_source"),
                       F.coalesce("confidence", F.lit("unknown")).alias("confidence"), "file")
