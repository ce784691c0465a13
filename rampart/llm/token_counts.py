"""Token counts by an exact length histogram: documents by encoded length, with suffix sums for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Shared

#: Lengths that share a bucket; sums run inside buckets and over buckets.
BUCKET = 1024


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, exact over all rows: length, n_docs; docs_longer (rows of a greater length);
    tokens_at_most (tokens of rows up to this length); total_truncated (tokens if every row is cut at this length);
    rank (rows up to this length: the q-quantile is the first length of rank >= q * all); all_docs and all_tokens.

    A null length counts as 0. No rows give no rows.
    """
    spark = lengths.sparkSession
    shared = Shared(spark, "lengths")
    counted = lengths.groupBy(F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    counted = shared.save(counted.withColumn("bucket", F.floor(F.col("length") / BUCKET)), "counts")
    # sums of the buckets above, joined by bucket; then sums of the greater lengths inside the bucket
    buckets = counted.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("b_tokens"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select(
        "bucket", F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(whole).alias("all_docs"), F.sum("b_tokens").over(whole).alias("all_tokens"))
    longer = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    joined = counted.join(buckets, "bucket").select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum(F.col("length") * F.col("n_docs")).over(longer), F.lit(0))).alias("tokens_longer"))
    return joined.select(
        "length", "n_docs", "docs_longer", (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("total_truncated"),
        (F.col("all_docs") - F.col("docs_longer")).alias("rank"), "all_docs", "all_tokens")


def truncated_total(found: DataFrame, limit: int) -> int:
    """Tokens of all rows cut at ``limit``, for any limit, from the histogram."""
    at = found.filter(F.col("length") <= limit).orderBy(F.desc("length")).select("tokens_at_most", "docs_longer").first()
    if at is not None:
        return at["tokens_at_most"] + limit * at["docs_longer"]
    any_row = found.select("all_docs").first()
    return limit * any_row["all_docs"] if any_row else 0


def quantile(found: DataFrame, q: float) -> int | None:
    """The least length that at least the share ``q`` of all rows does not exceed; none without rows."""
    at = found.filter(F.col("rank") >= F.ceil(F.lit(q) * F.col("all_docs"))).orderBy("length").select("length").first()
    return at["length"] if at else None
