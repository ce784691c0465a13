"""Byte-level BPE by a lazily determinised transducer.

A sequence of tokens is the encoding of its bytes exactly if every token encodes to itself and every two
neighbours stay apart when merged. So the encoding of a prefix is fixed by its last token, and while bytes
come in, only the cuts matter at which a longer token may still begin. A state holds those open cuts, each
with its place in the trie of tokens and the tokens not emitted yet; what all open
cuts have in common is emitted. A transition is made when it is met for the second time; a short piece
that needs one met only once is searched for the one sequence that fits.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import per_worker, quoted, slices, small_batches

#: The states, the pieces of two generations and the pairs of tokens known to stay apart are forgotten beyond these numbers, which bounds memory and changes no result.
MOST_STATES = 40_000
MOST_PIECES = 200_000
MOST_PAIRS = 300_000
#: Bytes of a piece that may be searched instead of making transitions that are met once.
SHORT_PIECE = 48
UNMET = object()


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, blank, rank on each line): the vocabulary, of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_plainly(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging, for the short byte strings that the compiler asks about."""
    get, never = ranks.get, 1 << 60
    parts = [data[i:i + 1] for i in range(len(data))]
    pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < never:
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
    return [ranks[p] for p in parts]


class Transducer:
    """``encode`` of a piece runs its bytes through the states.

    The last token emitted is a register and no part of a state: only the cut at which nothing is pending follows it, so a
    transition asks at most one question of it, whether it stays apart from the token that ends at this byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {v: k for k, v in ranks.items()}
        self._apart: dict[int, bool] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = rank
        self._reset()

    def _reset(self) -> None:
        # a state: open cuts, oldest first, as (trie node since the cut, tokens not emitted up to it)
        self.states: list[tuple] = [((0, ()),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        # by state and byte: token asked about or -1, (next state, tokens emitted) if it fits or nothing is asked, the same if not
        self.steps: list[dict[int, list]] = [{}]

    def encode_plainly(self, data: bytes) -> list[int]:
        return merge_plainly(data, self.ranks)

    def _make_step(self, state: int, byte: int) -> list:
        node, pending = self.states[state][0]
        nxt = self.children[node].get(byte)
        asked = -1 if pending or nxt is None else self.token[nxt]
        step = self.steps[state][byte] = [asked, None, None] if asked >= 0 else [-1, self._follow(state, byte, False), None]
        return step

    def _follow(self, state: int, byte: int, first_fits: bool) -> tuple[int, tuple[int, ...]]:
        """The next state and what is emitted; ``first_fits`` is the answer for the cut at which nothing is pending."""
        children, tokens = self.children, self.token
        cuts, here = [], None
        for node, pending in self.states[state]:
            nxt = children[node].get(byte)
            if nxt is None:
                continue
            if here is None and (token := tokens[nxt]) >= 0 and (self._fits(pending[-1], token) if pending else first_fits):
                here = (0, (*pending, token))
            if children[nxt]:
                cuts.append((nxt, pending))
        if here is None:
            raise ValueError(f"byte {byte} is in no token")
        cuts.append(here)
        common = cuts[0][1]
        for _, pending in cuts:
            n = 0
            for x, y in zip(common, pending):
                if x != y:
                    break
                n += 1
            common = common[:n]
        skip = len(common)
        key = tuple([(node, pending[skip:]) for node, pending in cuts])
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return number, common

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` encodes to itself and stays apart from the token before it, if there is one."""
        key = (before + 1) << 32 | token
        fits = self._apart.get(key)
        if fits is None:
            words = self.words
            if before < 0:
                fits = self.encode_plainly(words[token]) == [token]
            else:
                fits = self._fits(-1, token) and self.encode_plainly(words[before] + words[token]) == [before, token]
            if len(self._apart) >= MOST_PAIRS:
                self._apart.clear()
            self._apart[key] = fits
        return fits

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self._reset()
        state, last, out, steps, apart = 0, -1, [], self.steps, self._apart
        for byte in piece:
            step = steps[state].get(byte, UNMET)
            if step is UNMET:
                steps[state][byte] = None
                if len(piece) <= SHORT_PIECE:
                    return self._search(piece)
                step = None
            if step is None:
                step = self._make_step(state, byte)
            asked = step[0]
            if asked < 0:
                state, emitted = step[1]
            else:
                fits = apart.get((last + 1) << 32 | asked)
                if fits is None:
                    fits = self._fits(last, asked)
                way = 1 if fits else 2
                then = step[way]
                if then is None:
                    then = step[way] = self._follow(state, byte, fits)
                state, emitted = then
            if emitted:
                out.extend(emitted)
                last = emitted[-1]
        out.extend(self.states[state][-1][1])  # the last cut is the end of the piece
        return out

    def _search(self, piece: bytes) -> list[int]:
        """The tokens of a piece by trying the longest first and going back where none fits; since only one sequence fits throughout, any way to it will do."""
        children, tokens, apart = self.children, self.token, self._apart
        size, at, last, path, dead = len(piece), 0, -1, [], set()
        while at < size:
            options, node, end = [], 0, at
            while end < size and (node := children[node].get(piece[end])) is not None:
                end += 1
                if tokens[node] >= 0:
                    options.append((end, tokens[node]))
            while True:
                while options:
                    end, token = options.pop()
                    fits = apart.get((last + 1) << 32 | token)
                    if (self._fits(last, token) if fits is None else fits) and (not dead or (end, token) not in dead):
                        break
                else:
                    if not path:
                        raise ValueError(f"{piece!r} has bytes that are in no token")
                    dead.add((at, last))
                    at, last, options = path.pop()
                    continue
                break
            path.append((at, last, options))
            at, last = end, token
        return [step[1] for step in path[1:]] + [last]


#: Code points up to which a pattern's classes are spelled out for the standard library's faster engine.
NARROW = 0x3000


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern. Texts of code points below ``NARROW`` are split by the same pattern with its classes spelled out as ranges."""
    wide = regex.compile(pattern).findall
    found: dict[str, str] = {}

    def spelled(name: str) -> str:
        if name not in found:
            member, ranges, start = regex.compile(name).match, [], None
            for c in range(NARROW + 1):
                inside = c < NARROW and member(chr(c)) is not None
                if inside and start is None:
                    start = c
                elif not inside and start is not None:
                    ranges.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                    start = None
            found[name] = "".join(ranges)
        return found[name]

    out, in_class = [], False
    for part in re.finditer(r"\\[pP]\{\w+\}|\\.|[\[\]]|[^\\\[\]]+", pattern, re.DOTALL):
        name = part[0]
        if name[0] == "\\" and name[1] in "pPsSwWdD":
            name = spelled(name) if in_class else f"[{spelled(name)}]"
        elif name in "[]":
            in_class = name == "["
        out.append(name)
    try:
        narrow = re.compile("".join(out)).findall
    except re.error:  # a construct that only the other engine has
        return wide
    beyond = re.compile(f"[^\\u0000-\\u{NARROW - 1:04x}]").search
    return lambda text: narrow(text) if beyond(text) is None else wide(text)


class Encoder:
    """Texts to ids packed as little-endian unsigned 32-bit numbers; pieces are matches of ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = splitter(pattern)
        self.transducer = Transducer(ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.transducer.encode(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.known) >= MOST_PIECES:
            self.older, self.known = self.known, {}
        self.known[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        pieces = self.split(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self._ids(piece) if ids is None else ids for piece, ids in zip(pieces, found)]
        return b"".join(found)


#: UTF-8 by state: what a byte may be and how many more must follow. State 0 is between characters.
_FIRST = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)]
_NEXT = {1: (0x80, 0xBF, 0), 2: (0xA0, 0xBF, 1), 3: (0x80, 0xBF, 1), 4: (0x80, 0x9F, 1), 5: (0x90, 0xBF, 3), 6: (0x80, 0xBF, 3), 7: (0x80, 0x8F, 3)}


def utf8_step(state: int, byte: int) -> int:
    """The next state, or -1 if the byte cannot stand there."""
    if state == 0:
        return next((s for low, high, s in _FIRST if low <= byte <= high), -1)
    low, high, then = _NEXT[state]
    return then if low <= byte <= high else -1


class Decoder:
    """Streams ids to text. What a token does in a UTF-8 state is computed once: the text it completes, and the bytes it leaves open."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {v: k for k, v in ranks.items()}
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def _take(self, held: bytes, token: int) -> tuple[str, bytes]:
        data, out, start, state, i = held + self.tokens[token], [], 0, 0, 0
        while i < len(data):
            state = utf8_step(state, data[i])
            if state < 0:  # broken: the bytes so far give one replacement character, and this one may begin a new one
                again = i > start
                out.append("\ufffd")
                i += 0 if again else 1
                start, state = i, 0
                continue
            i += 1
            if state == 0:
                out.append(data[start:i].decode("utf-8"))
                start = i
        return "".join(out), data[start:]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held, known = b"", self.known
        for token in ids:
            key = (held, token)
            step = known.get(key)
            if step is None:
                if len(known) > MOST_STATES:
                    known.clear()
                step = known[key] = self._take(held, token)
            held = step[1]
            if step[0]:
                yield step[0]
        if held:
            yield "\ufffd"

    def __call__(self, ids: bytes) -> str:
        return "".join(self.stream(struct.unpack(f"<{len(ids) // 4}I", ids)))


class _Vocabulary:
    """A broadcast vocabulary and a name for it; its size is that of the rank file."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self) -> object:
        return self.sent.value


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens and ``ids`` (packed, little-endian unsigned 32-bit) of every row; a null text is an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = _Vocabulary(docs.sparkSession, (ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("tokenizer", f"{shared.id} encoder", lambda: Encoder(*shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    rows = docs.select(quoted(docs, id_col).alias("id"), F.coalesce(quoted(docs, text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ids; null for null. Bytes that are no UTF-8 become replacement characters."""
    shared = _Vocabulary(encoded.sparkSession, ranks)
    columns = [F.col(c) for c in encoded.columns if c != decoded]
    frame = encoded.select(*columns)
    at = frame.columns.index(ids)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker("tokenizer", f"{shared.id} decoder", lambda: Decoder(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [None if x is None else decoder(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, decoded])

    return frame.mapInArrow(run, f"{types}, `{decoded}` string")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text: str = "text", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """``encode`` and ``decode`` of every row in one pass and one worker: id, n_tokens, ids and the text decoded from the ids.

    ``keep`` leaves the tokenizer in the worker for its next task; without it, other steps of a job have that memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = _Vocabulary(docs.sparkSession, (ranks, pattern))
    small_batches(docs.sparkSession)

    def build() -> tuple[Encoder, Decoder]:
        return Encoder(*shared.value), Decoder(shared.value[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = per_worker("tokenizer", shared.id, build) if keep else build()
        for batch in batches:
            for part in slices(batch, 200):
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(decoder, ids), pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"])

    rows = docs.select(quoted(docs, id_col).alias("id"), F.coalesce(quoted(docs, text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnsRenamed({"id": id_col, "decoded": decoded})
