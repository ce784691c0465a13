"""Near copies by DartMinHash.

Every occurrence of a shingle is a unit cell of the weight axis, with a Poisson process of darts along
the rank axis. The darts of a cell follow from its hash alone, so two texts that share a cell share its
darts. A text keeps, for each of its coordinates, the dart of the least rank; two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates are joined,
and candidates are verified on the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared, by_chars, free_name, quoted, quoted_name, slices, small_batches, text_key
from .components import components

_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Ends of the rank intervals in which a cell's darts are drawn.
_ENDS = [0.0, 2.0**-16, 2.0**-12, 2.0**-8, 2.0**-4, *(2.0**i for i in range(0, 60))]


@dataclass(frozen=True)
class DartParams:
    """``bands`` x ``rows`` coordinates. A pair of similarity s meets in a band with probability
    1 - (1 - s^rows)^bands: 0.9996 at 0.8. Members of different classes are first compared by ``fine`` one-bit
    coordinates: ``agreement`` of them must agree, 3.3 standard deviations below the mean of a pair of similarity 0.8."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    fine: int = 2048
    agreement: float = 0.878

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(texts: list, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of every shingle of the texts: ``span`` words, lower case.

    A text of fewer words has one shingle of all its words; a null or wordless text has none.
    """
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    hashes = mix(pd.util.hash_array(distinct, categorize=False))[codes]
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    key = hashes.copy()
    for step in range(1, span):
        later = np.zeros(len(key), np.uint64)
        later[:-step or None] = hashes[step:]
        inside = place + step < n[owner]
        key = mix(key + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64) + np.where(inside, later, np.uint64(0)))
    whole = (place + span <= n[owner]) | (place == 0)
    owner, key = owner[whole], key[whole]
    order = np.argsort(mix(key ^ mix(owner.astype(np.uint64) + np.uint64(1))))  # puts equal shingles of a text side by side
    owner, key = owner[order], key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion of uniform numbers."""
    top = int(mean + 12 * mean**0.5 + 20)
    k = np.arange(1, top)
    cdf = np.cumsum(np.exp(np.concatenate(([0.0], np.cumsum(np.log(mean / k)))) - mean))
    return np.searchsorted(cdf, u, side="right")


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """For each weighted set its ``k`` kept darts (64-bit); sets without elements keep zeros.

    ``owner`` is the set's number, ``weight`` any positive number: weight w is ceil(w) unit cells of its
    element, the last one holding the darts whose weight coordinate lies below the rest.
    """
    weight = np.asarray(weight, dtype=np.float64)
    cells = np.ceil(weight).astype(np.int64)
    layer = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix(np.repeat(element, cells) + _GOLD * layer.astype(np.uint64))
    part = np.minimum(1.0, np.repeat(weight, cells) - layer)
    of = np.repeat(owner, cells)
    total = np.bincount(owner, weights=weight, minlength=texts)
    kept, filled = np.zeros(texts * k, np.uint64), np.repeat(total == 0, k)
    low, high = np.zeros(texts), np.divide((np.log(k) + 2) * k, total, out=np.zeros(texts), where=total > 0)
    while len(of):
        found, ranks, slots = [], [], []
        for i, (a, b) in enumerate(zip(_ENDS, _ENDS[1:])):
            use = np.flatnonzero((high[of] > a) & (low[of] < b))
            if not len(use):
                continue
            seed = mix(cell[use] ^ mix(np.array([i + 1], np.uint64)))
            count = _poisson(_unit(seed), b - a)
            many = np.flatnonzero(count)
            count, use, seed = count[many], use[many], seed[many]
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(np.repeat(seed, count) + _GOLD * (number + 1).astype(np.uint64))
            at = np.repeat(use, count)
            rank = a + (b - a) * _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))
            whose = of[at]
            hit = (rank < high[whose]) & (rank >= low[whose]) & (_unit(mix(dart ^ np.uint64(0x14057B7EF767814F))) < part[at])
            dart, rank, whose = dart[hit], rank[hit], whose[hit]
            slot = whose * k + (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            open_ = ~filled[slot]
            found.append(dart[open_]), ranks.append(rank[open_]), slots.append(slot[open_])
        if found:
            dart, rank, slot = np.concatenate(found), np.concatenate(ranks), np.concatenate(slots)
            order = np.argsort(-rank, kind="stable")
            kept[slot[order]] = dart[order]  # the last one written has the least rank
            filled[slot] = True
        short = ~filled.reshape(texts, k).all(axis=1)
        stay = short[of]
        of, cell, part = of[stay], cell[stay], part[stay]
        low, high = np.where(short, high, 0), np.where(short, 2 * high, 0)  # a coordinate is empty: look further out
    return kept.reshape(texts, k)


def sketch_texts(texts: list, params: DartParams, chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures of the texts, and whether each has any word, for ranges of about ``chars`` characters."""
    for start, end in by_chars(texts, chars):
        owner, element, count = shingles(texts[start:end], params.shingle)
        has = np.zeros(end - start, dtype=bool)
        has[owner] = True
        yield signatures(owner, element, count, end - start, params.coordinates), has


def _sketches(params: DartParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, start = batch.column(2).to_pylist(), 0
            for kept, has in sketch_texts(texts, params):
                n = len(kept)
                band = kept.reshape(n, params.bands, params.rows)
                key = np.zeros((n, params.bands), np.uint64)
                for r in range(params.rows):
                    key = mix(key * _GOLD + band[:, :, r])
                part = batch.slice(start, n)
                start += n
                empty = ~has
                bands = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), params.bands, mask=pa.array(empty)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands], names=["id", "key", "bands"])

    return run


def _fine_sketches(params: DartParams):
    """One bit of each of ``fine`` coordinates, packed in 64-bit words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, start = batch.column(1).to_pylist(), 0
            for first, last in by_chars(texts, 200_000):
                owner, element, count = shingles(texts[first:last], params.shingle)
                kept = signatures(owner, element, count, last - first, params.fine)
                words = np.packbits((mix(kept) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                part = batch.slice(start, last - first)
                start += last - first
                bits = pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), words.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), bits], names=["key", "bits"])

    return run


def _counted(text: str, span: int) -> tuple[np.ndarray, np.ndarray]:
    _, element, count = shingles([text], span)
    order = np.argsort(element)
    return element[order], count[order]


def _weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    whole = x[1].sum() + y[1].sum() - both
    return float(both / whole) if whole else 0.0


def weighted_jaccard(a: str, b: str, span: int) -> float:
    """Sum of the least over sum of the largest counts of the two texts' shingles."""
    return _weighted_jaccard(_counted(a, span), _counted(b, span))


def _verified(params: DartParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, None
        for batch in (part for whole in batches for part in slices(whole)):
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                if a != hub:  # a hub comes many times in a row
                    hub, of_hub = a, _counted(a, params.shingle)
                ok.append(_weighted_jaccard(of_hub, _counted(b, params.shingle)) >= params.similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_copies(docs: DataFrame, shared: Shared, params: DartParams = DartParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (of a text), ``rep`` (its least id), ``rows`` (its rows), ``root`` (least key of its class): one row per distinct text.

    Null texts are in no class and in no row of the result; equal texts are one text, so also empty
    ones. Links between texts are exact: only candidates with a weighted Jaccard similarity of the
    word shingles of at least ``similarity`` stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(docs, id_col).alias("id"), text_key(quoted(docs, text).cast("string")).alias("key"), quoted(docs, text).cast("string").alias("text")).filter("text is not null")
    small_batches(docs.sparkSession)
    sketched = rows.mapInArrow(_sketches(params), f"id {kind}, key binary, bands array<long>")
    texts = shared.save(sketched.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands")), "texts")
    members = texts.filter("bands is not null").select("key", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnsRenamed({"band": "of_band", "value": "of_value"})
    joined = shared.save(members.join(sizes, (F.col("band") == F.col("of_band")) & (F.col("value") == F.col("of_value"))).select("band", "value", "key", "n"), "members")
    # the hub of a bucket is the text with the most company in all its buckets: of a group of variants, the one they stem from
    company = joined.groupBy("key").agg(F.sum("n").alias("company"))
    ranked = shared.save(joined.join(company.withColumnRenamed("key", "its"), F.col("key") == F.col("its")).select("band", "value", "key", "company"), "ranked")
    hubs = ranked.groupBy("band", "value").agg(F.max(F.struct("company", "key")).alias("hub")).select(F.col("band").alias("of_band"), F.col("value").alias("of_value"), F.col("hub.key").alias("hub"))
    stars = ranked.join(hubs, (F.col("band") == F.col("of_band")) & (F.col("value") == F.col("of_value"))).filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = _links(docs, shared, params, id_col, text, texts, stars, "stars")
    roots = components(links, shared, "stars")
    # buckets whose members are still of several classes: pairs across classes that agree enough are verified too
    labelled = shared.save(joined.join(roots.select(F.col("node").alias("its"), "root"), F.col("key") == F.col("its"), "left").select("band", "value", "key", F.coalesce("root", "key").alias("root")), "labelled")
    mixed = labelled.groupBy("band", "value").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(F.col("band").alias("of_band"), F.col("value").alias("of_value"))
    rest = shared.save(labelled.join(mixed, (F.col("band") == F.col("of_band")) & (F.col("value") == F.col("of_value")), "left_semi"), "rest")
    if not rest.isEmpty():
        held = _texts_of(docs, shared, id_col, text, texts, rest.select("key").distinct(), "rest-texts")
        bits = shared.save(held.mapInArrow(_fine_sketches(params), "key binary, bits array<long>"), "bits")
        marked = rest.join(bits.withColumnRenamed("key", "its"), F.col("key") == F.col("its")).drop("its")
        x, y = (marked.select("band", "value", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "bits"))) for side in "xy")
        differ = sum(F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(params.fine // 64))
        across = x.join(y, ["band", "value"]).filter((F.col("root_x") < F.col("root_y")) & (differ <= int((1 - params.agreement) * params.fine)))
        more = _links(docs, shared, params, id_col, text, texts, across.select(F.col("key_x").alias("a"), F.col("key_y").alias("b")).distinct(), "across", held)
        if not more.isEmpty():
            roots = _regrouped(roots, more, shared)
    return texts.select("key", "rep", "rows").join(roots.select(F.col("node").alias("its"), "root"), F.col("key") == F.col("its"), "left").select("key", "rep", "rows", F.coalesce("root", "key").alias("root"))


def _regrouped(roots: DataFrame, more: DataFrame, shared: Shared) -> DataFrame:
    """``roots`` after ``more`` links: the classes are joined, not the texts."""
    a, b = (roots.select(F.col("node").alias(f"node_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
    ends = more.join(a, F.col("a") == F.col("node_a"), "left").join(b, F.col("b") == F.col("node_b"), "left")
    above = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), shared, "more")
    moved = roots.join(above.select(F.col("node").alias("its"), F.col("root").alias("above")), F.col("root") == F.col("its"), "left").select("node", F.coalesce("above", "root").alias("root"))
    return moved.unionByName(above.join(roots.select("node"), "node", "left_anti"))


def _texts_of(docs: DataFrame, shared: Shared, id_col: str, text: str, texts: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``key``, ``text`` of the texts with these keys. Only they are moved, one row of each."""
    needed = keys.join(texts.select(F.col("key").alias("its"), F.col("rep").alias("wanted")), F.col("key") == F.col("its")).select("its", "wanted")
    have = docs.select(quoted(docs, id_col).alias("rep"), text_key(quoted(docs, text).cast("string")).alias("key"), quoted(docs, text).cast("string").alias("text")).filter("text is not null")
    found = have.join(needed, (F.col("key") == F.col("its")) & F.col("rep").eqNullSafe(F.col("wanted")), "left_semi")
    return shared.save(found.groupBy("key").agg(F.first("text").alias("text")), name)


def _links(docs: DataFrame, shared: Shared, params: DartParams, id_col: str, text: str, texts: DataFrame, pairs: DataFrame, name: str, held: DataFrame | None = None) -> DataFrame:
    """The pairs whose texts are similar enough."""
    pairs = shared.save(pairs, f"{name}-candidates")
    if held is None:
        held = _texts_of(docs, shared, id_col, text, texts, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), f"{name}-texts")
    with_b = pairs.join(held.select(F.col("key").alias("its"), F.col("text").alias("text_b")), F.col("b") == F.col("its")).drop("its")
    both = with_b.join(held.select(F.col("key").alias("its"), F.col("text").alias("text_a")), F.col("a") == F.col("its"))
    return shared.save(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(params), "a binary, b binary"), f"{name}-links")


def _classes(found: DataFrame, shared: Shared) -> DataFrame:
    """``found`` with ``class_id``, the least id of the class, and ``size``, its rows."""
    found = shared.save(found, "classes")
    least = found.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("rows").alias("size"), F.count(F.lit(1)).alias("n_texts"))
    return found.join(least.select(F.col("root").alias("of"), "class_id", "size", "n_texts"), F.col("root") == F.col("of")).drop("of")


def classes(docs: DataFrame, params: DartParams = DartParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``class_id``, the least id of the class of near copies it is in.

    A row whose text is null, or has no near copy, is a class of its own. Ids that are null are passed over
    for the least one; a class with null ids only has a null ``class_id``. Repeated rows stay.
    """
    shared = Shared(docs.sparkSession, "darts")
    found = _classes(near_copies(docs, shared, params, id_col, text), shared)
    several = shared.save(found.filter("size > 1").select(F.col("key").alias("its"), "class_id"), "several")
    rows = docs.select(quoted(docs, id_col).alias("id"), text_key(quoted(docs, text).cast("string")).alias("key"))
    return rows.join(several, F.col("key") == F.col("its"), "left").select(F.col("id").alias(id_col), F.when(F.col("its").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame, params: DartParams = DartParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each class: that of the least id.

    A null id is the least of all. Of rows equal in id and text one stays. Rows whose text is null stay.
    """
    shared = Shared(docs.sparkSession, "darts")
    found = shared.save(near_copies(docs, shared, params, id_col, text), "classes")
    ids = docs.select(quoted(docs, id_col).alias("id"), text_key(quoted(docs, text).cast("string")).alias("key"))
    nulls = ids.filter("id is null and key is not null").select("key").distinct().withColumn("no_id", F.lit(True))
    known = found.join(nulls, "key", "left").select("root", F.struct(F.when(F.col("no_id"), None).otherwise(F.col("rep")).alias("id"), "key").alias("first"))
    first = known.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.key")
    repeated = ids.filter("key is not null").groupBy("id", "key").count().filter("count > 1").select("id", "key", F.lit(True).alias("repeated"))
    first = shared.save(first.alias("f").join(repeated.alias("r"), (F.col("f.key") == F.col("r.key")) & F.col("f.id").eqNullSafe(F.col("r.id")), "left").select(F.col("f.id").alias("rp_id"), F.col("f.key").alias("rp_key"), F.coalesce("r.repeated", F.lit(False)).alias("rp_repeated")), "first")
    key, mark, own_id, own_key = (free_name(docs, c) for c in ("rp_text_key", "rp_is_repeated", "rp_first_id", "rp_first_key"))
    keyed = docs.withColumn(key, text_key(quoted(docs, text).cast("string")))
    chosen = first.select(F.col("rp_id").alias(own_id), F.col("rp_key").alias(own_key), F.col("rp_repeated").alias(mark))
    kept = keyed.join(chosen, (quoted_name(key) == quoted_name(own_key)) & quoted_name(id_col).eqNullSafe(quoted_name(own_id)))
    once = kept.filter(~quoted_name(mark))
    again = kept.filter(quoted_name(mark)).dropDuplicates([id_col, key])
    untouched = docs.filter(quoted(docs, text).isNull())
    columns = [quoted_name(c) for c in docs.columns]
    return once.unionByName(again).select(*columns).unionByName(untouched)
