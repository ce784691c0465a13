"""Fill-in-the-middle by content-defined chunk memoization.

A rolling hash cuts texts into chunks where their content says so, so that passages shared by documents give the
same chunks. What counting needs of a chunk is its boundary summary: the units it has on its own, and whether
it begins and ends inside a run of letters. A worker keeps the summaries of chunks it has met, found by
the chunk itself, so no two different chunks are ever taken for each other. The counts of a document are the sums over its
chunks, less one wherever a run of letters goes over a border; the cuts are looked up in these sums, and
only the chunk that holds a cut is read again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_sizes, per_worker, quoted

#: A unit: a run of letters, or any other code point.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
MARKS = ("<P>", "<S>", "<M>")

#: Code points that the rolling hash sees; a border stands where its top ``BORDER_BITS`` bits are zero.
WINDOW, BORDER_BITS = 32, 7
#: Borders nearer than this to the one before are passed over; chunks are no longer than ``LONGEST`` code points.
SHORTEST, LONGEST = 48, 2048
#: Characters of chunks that a worker keeps summaries of, in each of two generations; memory only, no result depends on it.
KEPT_CHARS = 12_000_000


@dataclass(frozen=True)
class FimParams:
    """``seed`` goes into the hash that decides; of 100 rows by chance, ``plain`` stay plain and ``spm`` of the others lead with the suffix."""

    seed: str = "1"
    plain: int = 10
    spm: int = 20


def borders(points: np.ndarray) -> list[int]:
    """Ends of the chunks of a text of these code points, by content: each end depends on the ``WINDOW`` points before it and on the border before."""
    n = len(points)
    if n <= SHORTEST:
        return [n] if n else []
    # doubling: after k rounds, the hash of the last 2**k points
    rolled = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    width = 1
    factor = 0xD6E8FEB86659FD93
    while width < WINDOW:
        longer = rolled.copy()
        longer[width:] += rolled[:-width] * np.uint64(factor)
        rolled, width, factor = longer, 2 * width, factor * factor % (1 << 64)
    found = np.flatnonzero(rolled[SHORTEST - 1:n - 1] >> np.uint64(64 - BORDER_BITS) == 0) + SHORTEST
    ends, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST or end == n:
            if end > last:
                ends.append(end)
            last = end
    return ends


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


class Summaries:
    """Boundary summaries by chunk: units, begins inside letters, ends inside letters."""

    def __init__(self):
        self.new: dict[str, tuple[int, bool, bool]] = {}
        self.old: dict[str, tuple[int, bool, bool]] = {}
        self.held = 0

    def of(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk) or (len(UNIT.findall(chunk)), _letter(chunk[0]), _letter(chunk[-1]))
            if self.held > KEPT_CHARS:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[chunk] = found
            self.held += len(chunk)
        return found


class Document:
    """A text as chunks with running unit counts."""

    def __init__(self, text: str, known: Summaries):
        self.text = text
        self.ends = borders(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        self.starts = [0, *self.ends[:-1]]
        found = [known.of(text[a:b]) for a, b in zip(self.starts, self.ends)]
        # a chunk that goes on with the letters of the one before brings one unit less
        self.joined = [i > 0 and here[1] and found[i - 1][2] for i, here in enumerate(found)]
        self.counts = list(accumulate(here[0] - went_on for here, went_on in zip(found, self.joined)))

    @property
    def units(self) -> int:
        return self.counts[-1] if self.counts else 0

    def place(self, k: int) -> int:
        """Where the first ``k`` units end, in code points."""
        if k <= 0:
            return 0
        if k >= self.units:
            return len(self.text)
        # the first unit after the cut begins where the k-th ends; its chunk is the first with more than k units
        low, high = 0, len(self.counts) - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.counts[middle] > k else (middle + 1, high)
        before = self.counts[low - 1] if low else 0
        start = self.starts[low]
        skip = k - before + self.joined[low]
        for i, unit in enumerate(UNIT.finditer(self.text, start, self.ends[low])):
            if i == skip:
                return unit.start()
        raise AssertionError("a chunk with a summary of other content")


def rebuild(output: str, form: str) -> str:
    """The text from what was made of it."""
    if form == "plain":
        return output
    first, second = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
    at = output.index(second, 3)
    last = output.index("<M>", at + 3)
    a, b, middle = output[3:at], output[at + 3:last], output[last + 3:]
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def transform_text(text: str, row: object, params: FimParams, known: Summaries) -> tuple[int, str, int | None, int | None, str]:
    """units, form, code points of prefix and middle (none if plain), output."""
    document = Document(text, known)
    n = document.units
    drawn = hashlib.sha256(f"{params.seed}:{'' if row is None else row}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= 100 - params.plain or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = document.place(low), document.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < params.spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: FimParams = FimParams()) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain),
    output, and ``restored``, the text rebuilt from output and form.

    A null or empty text is plain and empty. A null id draws as an empty number. Rows that repeat an id and a text give equal
    rows; no rows give none. A text is taken whole, whatever its length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("chunks", "fill_in_middle", Summaries)
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            for start, end in by_sizes(sizes, 4_000_000):
                part = batch.slice(start, end - start)
                texts = part.column(1).to_pylist()
                made = [transform_text(t, i, params, known) for t, i in zip(texts, part.column(3).to_pylist())]
                n, form, prefix, middle, output = (list(c) for c in zip(*made))
                restored = [rebuild(o, f) for o, f in zip(output, form)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()), pa.array(restored, pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    whole = F.coalesce(quoted(docs, text).cast("string"), F.lit(""))
    rows = docs.select(quoted(docs, id_col).alias("id"), whole.alias("text"), F.length(whole).alias("size"), quoted(docs, id_col).cast("string").alias("number"))
    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    return made.withColumnRenamed("id", id_col)
