"""Connected components of a table of links, by hooking and shortcutting joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Shared


def components(links: DataFrame, shared: Shared, name: str) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns a, b) but the roots themselves; root is the least node of its component.

    Each round hooks every node onto its least smaller neighbour, shortens the trees to stars and
    replaces nodes by their roots; links inside a component vanish, so the table shrinks from round to
    round. Nothing is collected. No links give an empty table.
    """
    pairs = shared.save(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), f"{name}-pairs-0")
    found, step = None, 0
    while not pairs.isEmpty():
        step += 1
        parent = shared.save(pairs.groupBy("hi").agg(F.min("lo").alias("lo")), f"{name}-parent-{step}-0")
        for jump in range(1, 64):
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("above"))
            parent = shared.save(parent.join(up, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved")), f"{name}-parent-{step}-{jump}")
            moved = not parent.filter("moved").isEmpty()
            parent = parent.select("hi", "lo")
            if not moved:
                break
        roots = parent.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        if found is None:
            found = roots
        else:
            longer = found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = shared.save(longer.unionByName(roots), f"{name}-found-{step}")
        a, b = roots.select(F.col("node").alias("hi"), F.col("root").alias("hi_root")), roots.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        moved_up = pairs.join(a, "hi").join(b, "lo", "left").select(F.col("hi_root").alias("a"), F.coalesce("lo_root", "lo").alias("b")).filter("a <> b")
        pairs = shared.save(moved_up.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}-pairs-{step}")
    return found if found is not None else pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
