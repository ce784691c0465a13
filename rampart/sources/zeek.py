"""Zeek TSV files with their ``#`` directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rampart.operators.engines import zeek_cell
from rampart.session import broadcast_if_small, checkpoint


def _directive(name: str) -> Column:
    """Value of one directive line (cut at the separator in force, TAB unless declared)."""
    return F.when(F.col("line").rlike(rf"^#+{name}[^a-z_]"), F.regexp_replace("line", rf"^#+{name}.", ""))


def _separator() -> Column:
    token = F.trim(F.regexp_replace("line", r"^#separator", ""))
    code = F.regexp_extract(F.lower(token), r"^(?:\\x|0x)([0-9a-f]{2})\z", 1)
    value = F.when(F.lower(token).isin("\\t", "\\x09", "0x09"), "\t").when(code != "", F.char(F.conv(code, 16, 10).cast("int"))).otherwise(F.nullif(token, F.lit("")))
    return F.when(F.col("line").startswith("#separator"), value)


def header_states(lines: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """The schema in force after each directive line: ``stream.., order.., separator, set_separator,
    empty_field, unset_field, names, list_names``. Only directive lines (a few per file) are windowed."""
    heads = lines.filter(F.col("line").startswith("#")).withColumn("line", F.regexp_replace("line", r"[\r\n]+\z", ""))
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    heads = heads.withColumn("separator", F.coalesce(last(_separator()), F.lit("\t")))
    for name, default in (("set_separator", ","), ("empty_field", "(empty)"), ("unset_field", "-")):
        heads = heads.withColumn(name, F.coalesce(last(F.nullif(_directive(name), F.lit(""))), F.lit(default)))
    for name, source in (("names", "fields"), ("kinds", "types")):
        cells = F.split(_directive(source), F.concat(F.lit(r"\Q"), F.col("separator"), F.lit(r"\E")), -1)
        heads = heads.withColumn(name, last(cells))
    lists = F.transform(F.filter(F.arrays_zip("names", "kinds"), lambda x: x["kinds"].rlike(r"^(?:set|vector|table)\[")), lambda x: x["names"])
    heads = heads.withColumn("list_names", F.when(F.size("names") == F.size("kinds"), lists).otherwise(F.array().cast("array<string>")))
    bad = (F.size("names") != F.size("kinds")) & F.col("kinds").isNotNull() & F.col("names").isNotNull()
    return heads.withColumn("_bad", F.coalesce(bad, F.lit(False))).select(*stream, *order, "separator", "set_separator", "empty_field", "unset_field", "names", "list_names", "_bad")


def with_last_header(lines: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """Add ``_head``: the order columns of the last directive line at or before each line of its stream, null before the first.

    Lines are range-partitioned; inside a partition the last one is carried from line to line, and what earlier partitions end
    with comes from a table of a row per stream and partition. So a stream of any length, with any number of headers, is one
    pass of many tasks.
    """
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    fixed = checkpoint(lines.repartitionByRange(parts, *stream, *order).withColumn("_p", F.spark_partition_id()))
    here = F.when(F.col("line").startswith("#"), F.struct(*order))
    ends = fixed.groupBy(*stream, "_p").agg(F.max(here).alias("_end"))
    earlier = Window.partitionBy(*stream).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*stream, "_p", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*stream, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = fixed.withColumn("_inside", F.last(here, ignorenulls=True).over(inside)).join(broadcast_if_small(carried), [*stream, "_p"])
    return placed.withColumn("_head", F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_p")


def parse_zeek_tsv(lines: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """Data rows of Zeek files in ``line`` with ``fields`` and ``parse_error``; directive rows are left out.

    ``stream`` names the columns of one file, ``order`` its line order, which is total. Each data row takes the state after the
    last directive before it.
    """
    heads = header_states(lines, stream, order).withColumn("_head", F.struct(*order)).drop(*order)
    data = with_last_header(lines, stream, order).filter(~F.col("line").startswith("#"))
    joined = data.join(broadcast_if_small(heads), [*stream, "_head"], "left")
    cells = F.split(F.regexp_replace("line", r"[\r\n]+\z", ""), F.concat(F.lit(r"\Q"), F.col("separator"), F.lit(r"\E")), -1)
    extra = F.transform(F.when(F.size(cells) > F.size("names"), F.sequence(F.size("names"), F.size(cells) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("_extra."), i.cast("string")))
    keys = F.slice(F.concat("names", extra), F.lit(1), F.least(F.size(cells), F.size("names") + F.size(extra)))
    zipped = F.map_from_arrays(keys, F.slice(cells, F.lit(1), F.size(keys)))
    clean = F.transform_values(zipped, lambda k, v: zeek_cell(v, F.array_contains("list_names", k), F.col("unset_field"), F.col("empty_field"), F.col("set_separator")))
    error = F.when(F.col("_bad"), "Zeek #fields and #types column counts differ").when(F.col("names").isNull(), "no #fields header seen")
    out = joined.withColumn("parse_error", error).withColumn("fields", F.when(error.isNull(), clean))
    return out.select(*lines.columns, "fields", "parse_error")
