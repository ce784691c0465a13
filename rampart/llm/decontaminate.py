"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a window and ignores the others, so a window still hits when an ignored
word was substituted. Hashes of the picked words of every benchmark window meet those of every
document window; around a hit, document and item are compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Shared, broadcast_if_bounded, free_name, quoted, quoted_name, text_key


@dataclass(frozen=True)
class SeedParams:
    """``masks``: 1 picks a word, 0 ignores it. An overlap is the stretch of the hit's diagonal with the largest
    score, an equal pair of words counting 1 and an unequal one -1; from ``min_score`` on it is a leak.

    ``block_seeds`` bounds what is broadcast at a time: seeds of 24 bytes, the words they come from and the ids of items. Larger
    benchmarks are taken in blocks, each against all documents in a job of its own. A document is searched in pieces of
    ``piece_words`` words (of the longest item's, if that has more), so what a task holds of one does not grow with its length.
    """

    masks: tuple[str, ...] = ("11011011", "110010111", "1010011011")
    min_score: int = 8
    block_seeds: int = 1_000_000
    piece_words: int = 1000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _picked(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i, c in enumerate(mask) if c == "1"))


def _pieces(frame: DataFrame, longest: int, params: SeedParams) -> DataFrame:
    """Pieces of every row's ``words``: the word number ``since`` of their first, the positions ``first`` to ``last`` that are theirs alone,
    and ``words`` with so many on both sides that an item of ``longest`` words that hits in the piece lies inside."""
    shortest, reach = min(map(len, params.masks)), max(longest, *map(len, params.masks))
    step = max(params.piece_words, reach)

    def piece(start: Column) -> Column:
        since = F.greatest(start - reach, F.lit(0))
        last = F.least(start + (step - 1), F.size("words") - shortest)
        return F.struct(since.alias("since"), (start - since).alias("first"), (last - since).alias("last"), F.slice("words", since + 1, start - since + (step + reach)).alias("words"))

    starts = F.when(F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest, F.lit(step)))  # a filter would split the texts twice
    return frame.select("id", "key", F.inline(F.transform(starts, piece)))


def _seeds(frame: DataFrame, params: SeedParams, whole: bool) -> DataFrame:
    """Rows of ``frame`` (with ``words``) for every position ``at`` from ``first`` to ``last`` and mask, with ``seed``."""
    at = frame.select("*", F.explode(F.sequence("first", "last")).alias("at"))
    hashes = []
    for mask in params.masks:
        seed = _picked(F.col("words"), F.col("at"), mask)
        hashes.append(F.when(F.col("at") + len(mask) <= F.size("words"), seed) if whole else seed)
    return at.select("*", F.explode(F.array(*hashes)).alias("seed"))


def _goes_on(words: Column, at: Column, item: Column, item_at: Column, params: SeedParams) -> Column:
    """Whether the windows one word earlier hit as well. They are on the same diagonal, which has its first hit to be judged by."""
    hits = F.lit(False)
    for mask in params.masks:
        same = (at > 0) & (item_at > 0) & (at - 1 + len(mask) <= F.size(words)) & (item_at - 1 + len(mask) <= F.size(item))
        for i, c in enumerate(mask):
            if c == "1":
                same = same & (F.get(words, at - 1 + i) == F.get(item, item_at - 1 + i))
        hits = hits | same
    return hits


def _diagonal(hits: DataFrame) -> DataFrame:
    """Of every hit the words of both sides where item word i stands at document word i + shift, and where they start."""
    shift = F.col("at") - F.col("item_at")
    doc_from, item_from = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    length = F.least(F.size("words") - doc_from, F.size("item_words") - item_from)
    return hits.select("id", "key", "which", (F.col("since") + doc_from).alias("doc_from"), item_from.alias("item_from"),
                       F.slice("words", doc_from + 1, length).alias("doc_side"), F.slice("item_words", item_from + 1, length).alias("item_side"))


def _overlap(doc_side: Column, item_side: Column, doc_from: Column, item_from: Column) -> Column:
    """Best stretch of a diagonal: score, start in the document and in the item, words, equal words."""
    equal = F.zip_with(doc_side, item_side, lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(-1)))
    zero = F.struct(*(F.lit(0).alias(c) for c in ("i", "run", "since", "best", "first", "last")))

    def step(s: Column, v: Column) -> Column:
        run = F.greatest(s["run"], F.lit(0)) + v
        since = F.when(s["run"] > 0, s["since"]).otherwise(s["i"])
        better = run > s["best"]
        return F.struct((s["i"] + 1).alias("i"), run.alias("run"), since.alias("since"), F.greatest(run, s["best"]).alias("best"),
                        F.when(better, since).otherwise(s["first"]).alias("first"), F.when(better, s["i"] + 1).otherwise(s["last"]).alias("last"))

    def out(s: Column) -> Column:
        n = s["last"] - s["first"]
        return F.struct(s["best"].alias("score"), (doc_from + s["first"]).alias("doc_start"), (item_from + s["first"]).alias("item_start"), n.alias("n_words"), ((n + s["best"]) / 2).cast("int").alias("n_equal"))

    return F.aggregate(equal, zero, step, out)


def overlaps(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams(), id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, ``key`` (of the text), item id, score, doc_start, item_start, n_words, n_equal: the best overlap of each leaking document and item.

    Positions are word numbers from 0. Null texts have no words and no row; items with fewer words than the shortest
    mask can have no hit. Rows equal in id and text give one row; so do repeated items.
    """
    shortest = min(map(len, params.masks))
    rows = docs.select(quoted(docs, id_col).alias("id"), quoted(docs, text).cast("string").alias("text")).filter("text is not null")
    items = benchmark.select(quoted(benchmark, item_col).alias("item"), words_of(quoted(benchmark, item_text).cast("string")).alias("item_words")).filter(F.size("item_words") >= shortest).distinct()
    words, longest, ids = items.groupBy("item_words").agg(F.count("*").alias("n")).agg(F.sum(F.size("item_words")), F.max(F.size("item_words")), F.sum("n")).first()
    blocks = max(1, -(-max((words or 0) * len(params.masks), ids or 0) // params.block_seeds))
    doc_seeds = _seeds(_pieces(rows.select("id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words")), longest or 0, params), params, whole=False)
    shared = Shared(docs.sparkSession, "overlaps") if blocks > 1 else None
    found = None
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_words"), F.lit(blocks)) == block)
        part = part.select("item", F.xxhash64("item_words").alias("which"), "item_words")
        texts = part.select("which", "item_words").distinct()
        own = _seeds(texts.select("which", F.col("item_words").alias("words"), F.lit(0).alias("first"), (F.size("item_words") - shortest).alias("last")), params, whole=True).filter("seed is not null").select("which", F.col("at").alias("item_at"), "seed")
        hits = doc_seeds.join(F.broadcast(own), "seed").join(F.broadcast(texts), "which")
        hits = hits.filter(~_goes_on(F.col("words"), F.col("at"), F.col("item_words"), F.col("item_at"), params))  # a long copy is compared once, not at every word
        sides = _diagonal(hits)  # what a task holds of a document's hits before they are compared: no more of its words than those beside an item
        judged = sides.select("id", "key", "which", F.explode(F.array(_overlap(*map(F.col, ("doc_side", "item_side", "doc_from", "item_from"))))).alias("o"))
        best = judged.filter(F.col("o.score") >= params.min_score).join(F.broadcast(part.select("which", "item")), "which")
        one = best.groupBy("id", "key", "item").agg(F.max("o").alias("o"))
        one = shared.save(one, f"block-{block}") if shared else one
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").alias(id_col), "key", F.col("item").alias(item_col if item_col != id_col else f"{item_col}_of_item"), "o.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams(), id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that overlap no benchmark item. Rows with a null text stay.

    Leaking (id, text key) pairs, 40 bytes each, are broadcast up to ``broadcast_rows`` of them, else joined by a shuffle.
    """
    shared = Shared(docs.sparkSession, "leaks")
    leaks = shared.save(overlaps(docs, benchmark, params, id_col, text, item_col, item_text).select(F.col(id_col).alias("leak_id"), F.col("key").alias("leak_key")).distinct(), "leaks")
    own_id, own_key = free_name(docs, "rp_leak_id"), free_name(docs, "rp_leak_key")
    leaks = broadcast_if_bounded(leaks.select(F.col("leak_id").alias(own_id), F.col("leak_key").alias(own_key)), broadcast_rows)
    return docs.join(leaks, (text_key(quoted(docs, text).cast("string")) == quoted_name(own_key)) & quoted(docs, id_col).eqNullSafe(quoted_name(own_id)), "left_anti")
