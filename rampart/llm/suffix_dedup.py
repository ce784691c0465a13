"""Repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts earlier. Such strings are suffixes cut at
``length`` bytes. Tasks sort suffixes of a block of text: prefix polynomial hashes say whether two stretches are equal,
binary search over them finds how far two suffixes agree, so a comparison in the mergesort takes a logarithmic number of
steps; the sorted order is then verified on the bytes, and a block whose hashes collide is sorted again with another base. Of
equal suffixes of a block only the earliest goes on, so a passage of a third of all rows has one row per block in the shuffle.

Not every suffix is sorted. Each window of ``length`` bytes has an anchor, the least hashed ``GRAM`` bytes inside, and neighbouring
windows with the same anchor are one run, sorted as one suffix. Equal windows have equal anchors, so only runs whose anchor
has other bytes around it elsewhere hold windows that are shared in part. Those are cut, by their distance from the
anchor, into short runs, whose windows have most of their bytes in common, and what is still shared in part into single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Shared, by_sizes, per_worker, quoted

#: Bytes of an anchor.
GRAM = 36
#: Bytes of text that are sorted together; longer texts are cut into overlapping segments.
BLOCK = 2_000_000
#: How closely runs are looked at in turn: whole runs, windows within 8 bytes of each other, single windows.
STEPS = (0, 8, 1)
RANGE = ("id", "tag", "low", "high")
#: Odd bases of the prefix hashes, tried in turn.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class DedupParams:
    """``length``: bytes that a repeated string must have, more than ``GRAM``."""

    length: int = 100


class Collision(Exception):
    """Different stretches with equal hashes."""


class Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                row = np.full(n + 1, factor, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))


class Suffixes:
    """Suffixes of ``raw``, compared by prefix hashes."""

    def __init__(self, raw: bytes, base: int = BASES[0]):
        self.raw, self.bytes = raw, np.frombuffer(raw, np.uint8)
        powers = per_worker(f"powers {base}", "", lambda: Powers(base))
        powers.reach(max(len(raw), BLOCK if len(raw) > BLOCK // 8 else 0))
        self.down = powers.down
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers.up[:len(raw)], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.prefix[starts + lengths] - self.prefix[starts]) * self.down[starts]

    def grams(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` bytes, mixed so that their order is that of chance."""
        found = self.hashes(starts, length)
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(29)
        return found

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``x`` and ``y`` share, up to ``most``: binary search over equal hashes."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            equal = self.hashes(x, middle) == self.hashes(y, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def compare(self, x: np.ndarray, x_length: np.ndarray, y: np.ndarray, y_length: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``x`` of its length comes before, with or after the one at ``y``."""
        most = np.minimum(x_length, y_length)
        shared = self.common(x, y, most)
        inside = shared < most
        at = np.where(inside, shared, 0)
        by_byte = self.bytes[x + at].astype(np.int64) - self.bytes[y + at]
        return np.sign(np.where(inside, by_byte, x_length - y_length))

    def sort(self, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and for each place in it whether the suffix equals the one before.

        Suffixes are dealt by the hash of their first bytes, which equal ones share, and each hand is sorted by merging runs
        of doubling width, all hands at a time. Equal suffixes keep their order.
        """
        hand = self.grams(starts, int(min(GRAM, lengths.min(initial=GRAM))))
        order = np.argsort(hand, kind="stable")
        dealt = hand[order]
        first = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]]) if len(dealt) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(dealt)])
        width = 1
        while True:
            more = size > width
            first, size = first[more], size[more]
            if not len(first):
                break
            self._merge(order, starts, lengths, first, size, width)
            width *= 2
        same = np.zeros(len(order), bool)
        raw = self.raw
        for i in (np.flatnonzero(dealt[1:] == dealt[:-1]) + 1).tolist():
            x, y = order[i - 1], order[i]
            before, here = raw[starts[x]:starts[x] + lengths[x]], raw[starts[y]:starts[y] + lengths[y]]
            if before > here:
                raise Collision
            same[i] = before == here
        return order, same

    def _merge(self, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> None:
        """One round: neighbouring sorted runs of ``width`` inside each hand become one."""
        pairs = (size - width + 2 * width - 1) // (2 * width)
        left = np.repeat(first, pairs) + 2 * width * _spread(np.zeros_like(pairs), pairs)
        right = left + width
        end = np.minimum(right + width, np.repeat(first + size, pairs))

        def against(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y = order[i], order[j]
            return self.compare(starts[x], lengths[x], starts[y], lengths[y])

        apart = against(right - 1, right) > 0  # the others are in order as they stand
        left, right, end = left[apart], right[apart], end[apart]
        if not len(left):
            return
        merged, places = [], []
        for own, own_end, other, other_end, ties in ((left, right, right, end, 0), (right, end, left, right, 1)):
            sizes = own_end - own
            item = _spread(own, sizes)
            low, high = np.repeat(other, sizes), np.repeat(other_end, sizes)
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                passed = against(middle, item[open_]) < ties  # those of the other run that come first
                low[open_] = np.where(passed, middle + 1, low[open_])
                high[open_] = np.where(passed, high[open_], middle)
            merged.append(order[item])
            places.append(item - np.repeat(own, sizes) + np.repeat(left, sizes) + low - begin)
        order[np.concatenate(places)] = np.concatenate(merged)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def runs_of(text: Suffixes, windows: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and key of each run of ``windows`` (ascending starts of strings of ``length`` bytes).

    A run has one anchor, whose hash is the key; with a ``step``, also one distance from the anchor over ``step``, and the
    key is the hash of what all windows at these distances share.
    """
    places = np.arange(len(text.raw) - GRAM + 1)
    grams = text.grams(places, GRAM)
    least = (grams >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)  # of equal hashes the first place
    width, wanted = 1, length - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    band = (anchor - windows) // step if step else np.zeros_like(anchor)
    changes = (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1]) | (windows[1:] != windows[:-1] + 1)
    new = np.flatnonzero(np.r_[True, changes])
    last = np.r_[new[1:], len(windows)] - 1
    key = text.grams(anchor[new] - band[new] * step, length - step + 1) if step else grams[anchor[new]]
    return windows[new], windows[last], key


def _digests(raw: bytes, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    digest = hashlib.blake2b
    made = b"".join([digest(raw[a:a + n], digest_size=size).digest() for a, n in zip(starts.tolist(), lengths.tolist())])
    return np.frombuffer(made, np.int64).reshape(len(starts), size // 8)


def sort_block(segments: list[bytes], length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (with a ``step`` short ones, down to windows) of segments in corpus order: segment, first and last window in it, two keys, and whether an equal one comes earlier in the block."""
    raw = b"".join(segments)
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = _spread(begins, np.maximum(sizes - length + 1, 0))
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    for base in BASES:
        text = Suffixes(raw, base)
        # anchors come of the first base always: they must be the same in every block
        low, high, key = (windows, windows, None) if step == 1 else runs_of(text if base == BASES[0] else Suffixes(raw), windows, length, step)
        lengths = high - low + length
        try:
            order, same = text.sort(low, lengths)
        except Collision:
            continue
        break
    else:
        raise RuntimeError("prefix hashes collide with every base")
    again = np.zeros(len(low), bool)
    again[order[same]] = True
    keys = np.zeros((len(low), 2), np.int64)
    new = np.flatnonzero(~again)
    if step == 1:
        keys[new] = _digests(raw, low[new], lengths[new], 16)
    else:
        keys[:, 0] = key.view(np.int64)
        keys[new, 1] = _digests(raw, low[new], lengths[new], 8)[:, 0]
    segment = np.searchsorted(begins, low, side="right") - 1
    return segment, low - begins[segment], high - begins[segment], keys[:, 0], keys[:, 1], again


def _joined(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (ascending, inclusive) with those that touch inside a group made one."""
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] > high[:-1] + 1)]) if len(low) else np.zeros(0, np.int64)
    return low[new], np.maximum.reduceat(high, new) if len(new) else high, group[new]


def touching(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _sorted_rows(ids: list, tags: list) -> list[int]:
    """Rows in the order of the corpus, each (id, tag) once: rows that repeat both are one document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], tags[i]) if ids[i] is not None else (False, 0, tags[i]))
    return [i for k, i in enumerate(order) if not k or (ids[i], tags[i]) != (ids[order[k - 1]], tags[order[k - 1]])]


def suffixes(rows: DataFrame, length: int, step: int) -> DataFrame:
    """id, tag, low, high, key1, key2, seen of the runs of ``rows`` (id, tag, text, size), or, with a ``step``, of the short runs in their ``ranges``.

    ``seen`` rows equal an earlier one of their block; their keys are dealt by place.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = _sorted_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            sizes = batch.column(3).to_pylist()
            owners, offsets, segments, held = [], [], [], 0
            for row in order:
                if sizes[row] < length:
                    continue
                data = batch.column(2)[row].as_buffer().to_pybytes()
                ranges = touching((r["low"], r["high"]) for r in batch.column(4)[row].as_py()) if step else [(0, len(data) - length)]
                for low, high in ranges:
                    for at in range(low, high + 1, BLOCK):
                        piece = data[at:min(at + BLOCK - 1, high) + length]
                        if held and held + len(piece) > BLOCK:
                            yield made(batch, owners, offsets, segments)
                            owners, offsets, segments, held = [], [], [], 0
                        owners.append(row)
                        offsets.append(at)
                        segments.append(piece)
                        held += len(piece)
            if segments:
                yield made(batch, owners, offsets, segments)

    def made(batch: pa.RecordBatch, owners: list[int], offsets: list[int], segments: list[bytes]) -> pa.RecordBatch:
        segment, low, high, key1, key2, again = sort_block(segments, length, step)
        owner, offset = np.array(owners)[segment], np.array(offsets)[segment]
        low, high = low + offset, high + offset
        seen_low, seen_high, seen_owner = _joined(low[again], high[again], owner[again])
        owner, low, high = np.r_[owner[~again], seen_owner], np.r_[low[~again], seen_low], np.r_[high[~again], seen_high]
        spread = (seen_low + 1) * 0x5851F42D4C957F2D ^ seen_owner
        key1, key2 = np.r_[key1[~again], spread], np.r_[key2[~again], spread]
        seen = np.arange(len(owner)) >= len(owner) - len(seen_low)
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(key1), pa.array(key2), pa.array(seen)],
            names=["id", "tag", "low", "high", "key1", "key2", "seen"])

    return rows.mapInArrow(run, f"id {kind}, tag long, low int, high int, key1 long, key2 long, seen boolean")


def _ranked(found: DataFrame) -> DataFrame:
    """``found`` with ``seen`` also where an equal row comes earlier in the corpus. A group has a row per block at most."""
    place = F.struct("id", "tag", "low")
    earliest = F.first(place).over(Window.partitionBy("seen", "key1", "key2").orderBy("id", "tag", "low"))
    return found.withColumn("seen", F.col("seen") | ~place.eqNullSafe(earliest))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: DedupParams = DedupParams()) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as id, tag, text, size, and of each (id, tag) with repeated strings the ranges of their starts."""
    shared = Shared(docs.sparkSession, "suffixes", tidy=True)
    whole = F.coalesce(quoted(docs, text).cast("string"), F.lit(""))
    rows = docs.select(quoted(docs, id_col).alias("id"), whole.alias("text"))
    # rows that share an id are told apart by their texts
    shares = rows.groupBy("id").count().filter("count > 1").limit(1).count() > 0
    rows = rows.select("id", (F.xxhash64("text") if shares else F.lit(0).cast("long")).alias("tag"), F.encode("text", "UTF-8").alias("text"), F.octet_length("text").alias("size"))

    seen, left = [], rows
    for step in STEPS:
        name = f"step {step}"
        found = _ranked(suffixes(left, params.length, step))
        if step == 1:  # equal windows are equal in all their bytes
            seen.append(shared.save(found.filter("seen").select(*RANGE), f"{name} seen"))
            break
        runs = shared.save(found.drop("key2"), name)
        # keys with different bytes around them: their first occurrences are looked at more closely
        several = runs.filter("not seen").groupBy("key1").count().filter("count > 1").select("key1")
        mixed = runs.filter("not seen").join(several, "key1", "left_semi")
        ranges = shared.save(mixed.groupBy("id", "tag").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), f"{name} mixed")  # of one text each
        seen.append(shared.save(runs.filter("seen").select(*RANGE), f"{name} seen"))
        shared.drop(name)
        left = _with_ranges(rows, ranges, "inner")
    every = seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return rows, shared.save(every, "every")


def _with_ranges(rows: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    named = ranges.withColumnsRenamed({"id": "id_", "tag": "tag_"})
    return rows.join(named, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), how).select("id", "tag", "text", "size", "ranges")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: DedupParams = DedupParams()) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, spans (start, end of the maximal removed runs of bytes), kept (the remaining bytes).

    Texts are taken as UTF-8 bytes, a null one as empty; earlier means a smaller id (null first), then an earlier start. Rows that
    repeat id and text are one document and get equal results; rows of one id and different texts come in the order of a hash of
    the text. Texts shorter than ``length`` lose nothing; no rows give none. What is kept may end inside a character.
    """
    rows, every = repeats(docs, id_col, text, params)
    length, kind = params.length, rows.schema["id"].dataType.simpleString()
    joined = _with_ranges(rows, every, "left").select("id", "text", "size", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in by_sizes(batch.column(2).to_pylist(), BLOCK):
                part = batch.slice(start, end - start)
                removed, spans, kept = [], [], []
                for data, ranges in zip(part.column(1), part.column(3)):
                    data = data.as_py()
                    found = [] if not ranges.is_valid else remove(ranges.values, length)
                    at, left = 0, []
                    for a, b in found:
                        left.append(data[at:a])
                        at = b
                    left.append(data[at:])
                    spans.append([{"start": a, "end": b} for a, b in found])
                    removed.append(sum(b - a for a, b in found))
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    made = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, end: int>>, kept binary")
    return made.withColumnRenamed("id", id_col)


def remove(ranges: pa.StructArray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings with these starts cover."""
    low, high = (ranges.field(name).to_numpy().astype(np.int64) for name in ("low", "high"))
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order] + length)
    new = np.flatnonzero(np.r_[True, low[1:] > reach[:-1]])
    return list(zip(low[new].tolist(), reach[np.r_[new[1:], len(low)] - 1].tolist()))
