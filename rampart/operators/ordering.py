"""Row positions and exact quantiles without sending a whole table or group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rampart.session import broadcast_if_small, checkpoint


def global_position(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row within ``group`` in ``order``.

    Rows are range-partitioned and sorted, cut from lineage, and numbered per partition by
    their row id; the counts per (group, partition) are the only table that is accumulated.
    A group may span any number of partitions, so a hot one costs no more than others.
    ``order`` must be a total order within the group.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    fixed = checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = fixed.groupBy(*group, part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # one row per (group, partition it touches): groups + partitions rows at most
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*group, "_p", "_first", "_offset")
    joined = fixed.withColumn("_p", part).join(broadcast_if_small(offsets), [*group, "_p"])
    return joined.withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")).drop("_p", "_first", "_offset", "_id")


def _ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, value, n, _start, _end, _total``: each different value of each column with the ranks ``_start`` to before ``_end``
    that it takes; nulls and NaN are left out.

    Equal values are counted first, then ranked by range partition, so the work is a distributed sort
    of distinct values and no column passes through one task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(pairs.alias("_p")).select("_p.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    fixed = checkpoint(counted.repartitionByRange(parts, "feature", "value").withColumn("_p", F.spark_partition_id()))
    per_part = fixed.groupBy("feature", "_p").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy("feature").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    offsets = per_part.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(whole)})
    inside = Window.partitionBy("feature", "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = fixed.join(broadcast_if_small(offsets.drop("_n")), ["feature", "_p"]).withColumn("_end", F.sum("n").over(inside) + F.col("_before"))
    return ranked.withColumn("_start", F.col("_end") - F.col("n"))


def order_statistics(df: DataFrame, columns: list[str], grid: int = 20_000) -> DataFrame:
    """``feature, k, value``: the sorted values of each column, thinned to ``grid`` evenly spaced
    order statistics; nulls and NaN are left out."""
    ranked = _ranked(df, columns).withColumn("_points", F.least(F.lit(grid).cast("bigint"), F.col("_total")))
    # grid point k sits at rank round(k * (total - 1) / (points - 1)); keep those inside [start, end)
    step = F.when(F.col("_points") > 1, (F.col("_total") - 1) / (F.col("_points") - 1)).otherwise(F.lit(1.0))
    low = F.greatest(F.floor((F.col("_start") - 1) / step), F.lit(0))
    high = F.least(F.ceil((F.col("_end") + 1) / step), F.col("_points") - 1)
    spread = ranked.withColumns({"_step": step}).withColumn("k", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    rank = F.bround(F.col("k") * F.col("_step"), 0)
    return spread.filter((rank >= F.col("_start")) & (rank < F.col("_end"))).select("feature", "k", "value")


def middle_values(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """Per column with values, how many there are and the two of them (or one twice) around the middle rank, all columns in one pass."""
    ranked = _ranked(df, columns)
    holds = lambda rank: (rank >= F.col("_start")) & (rank < F.col("_end"))
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    found = ranked.filter(holds(low) | holds(high)).groupBy("feature").agg(
        F.max("_total").alias("n"), F.max(F.when(holds(low), F.col("value"))).alias("low"), F.max(F.when(holds(high), F.col("value"))).alias("high"))
    return {r["feature"]: (r["n"], r["low"], r["high"]) for r in found.collect()}  # a row per column


def exact_quantile(df: DataFrame, column: str, q: float, bins: int = 4096, small: int = 20_000) -> float | None:
    """The linearly interpolated quantile of a column, exactly.

    Each pass counts values per bin of the current interval and keeps the bin that holds the
    wanted ranks; only the last few values are read by the driver (at most ``small`` distinct ones).
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    first = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not first["n"]:
        return None
    target = q * (first["n"] - 1)
    ranks = [int(target), min(int(target) + 1, first["n"] - 1)]
    found = [_value_at(values, r, first["lo"], first["hi"], first["n"], bins, small) for r in ranks]
    return found[0] + (found[1] - found[0]) * (target - ranks[0])


def _value_at(values: DataFrame, rank: int, lo: float, hi: float, n: int, bins: int, small: int) -> float:
    inside = values
    while lo < hi:
        distinct = inside.groupBy("v").agg(F.count("*").alias("c")).limit(small + 1)
        if n <= small or distinct.count() <= small:
            for row in inside.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():
                if rank < row["c"]:
                    return row["v"]
                rank -= row["c"]
        width = (hi - lo) / bins
        place = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(place.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for row in counts:
            if rank < row["c"]:
                lo, hi, n = row["lo"], row["hi"], row["c"]
                break
            rank -= row["c"]
        inside = inside.filter(F.col("v").between(lo, hi))
    return lo
