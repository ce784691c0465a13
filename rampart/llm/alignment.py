"""Alignment of two tokenizers, each distinct text once.

Documents are shuffled by their full text, so equal texts meet; a distinct text is encoded by both tokenizers and
aligned once. The byte offsets where tokens of both end cut a text into groups; a token of A and one of B are linked
if they share a group. Pairs of ids are counted over the corpus with the multiplicity of their text, and the measures of a
text are joined to the doc_ids that hold it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared, broadcast_if_bounded, by_sizes, per_worker, quoted, text_key

#: Ids of A and of B are below this number, which makes a pair one long.
IDS = 1 << 24
#: Tokens aligned at a time, and links of one group written out at a time.
AT_ONCE = 200_000


@dataclass(frozen=True)
class AlignParams:
    """``broadcast_pairs``: at most so many of the most frequent id pairs reach every executor (24 bytes each, hashed); the others are joined by a shuffle.

    ``hot_share``: a text with more than one in so many of all rows, of which there are fewer than this number, reaches the rows by broadcast.
    """

    broadcast_pairs: int = 200_000
    hot_share: int = 1000


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how byte-level tokenizers of this format split a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_encoder(description: bytes) -> tuple[dict[str, int], Callable[[list[str]], list[list[int]]]]:
    """Entries and ids of a tokenizer description, and ids of texts without special tokens.

    Where the description is plain byte-level BPE whose merges stand in the order of their ids, the same ids
    come faster from the library that works on ranks; else from the description's own.
    """
    spec = json.loads(description)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    vocabulary = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
    plain = (
        model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["content"] not in model["vocab"] or t["special"] for t in spec["added_tokens"])
        and merged == list(range(256, 256 + len(merged))) and set(model["vocab"].values()) >= set(range(256)))
    if plain:
        import tiktoken

        letters, special = byte_level(), {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in entry): number for entry, number in model["vocab"].items() if number not in special}
        library = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return vocabulary, lambda texts: list(map(library.encode_ordinary, texts))
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    own = Tokenizer.from_buffer(description)
    own.encode_special_tokens = True
    return vocabulary, lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


class Tokenizers:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        import sentencepiece

        vocabulary, self.encode_a = byte_encoder(byte_bpe)
        letters = byte_level()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.texts = GroupTexts(len(self.a_bytes), len(self.b_bytes))

    def _piece(self, number: int) -> bytes:
        entry = self.b.id_to_piece(number)
        if self.b.is_byte(number) and (code := re.fullmatch("<0x([0-9A-Fa-f]{2})>", entry)):
            return bytes.fromhex(code[1])
        return entry.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B of each text; none where the tokens' bytes are not those of a blank and the text."""
        found_b = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(texts, self.encode_a([" " + t for t in texts]), found_b):
            whole = b" " + text.encode()
            if text and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                yield a, b
            else:
                yield [], []


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class GroupTexts:
    """``a1,a2|b1;a3|b2``: the ids of each group, put together from entries that are written once."""

    def __init__(self, ids_a: int, ids_b: int):
        self.ids_a = ids_a
        self.entries = [f"{i}{mark}" for n in (ids_a, ids_b) for i in range(n) for mark in ",|;"]

    def codes(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """Entries in order; A's last of a group closes with ``|``, B's with ``;``."""
        codes = np.zeros(len(a) + len(b), np.int64)
        ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[ends_a - 1], marks_b[ends_b - 1] = 1, 2
        codes[np.arange(len(a)) + np.repeat(ends_b - in_b, in_a)] = 3 * a + marks_a
        codes[np.arange(len(b)) + np.repeat(ends_a, in_b)] = 3 * (self.ids_a + b) + marks_b
        return codes

    def write(self, codes: np.ndarray) -> str:
        return "".join(map(self.entries.__getitem__, codes.tolist()))[:-1]


def align(encoded: list[tuple[list[int], list[int]]], a_length: np.ndarray, b_length: np.ndarray, texts: GroupTexts) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
    """Of each text, given as ids of A and of B with equal bytes: groups, links, groups as text, id pairs (a * IDS + b) in order, links of each."""
    for start, end in by_sizes([len(a) + len(b) for a, b in encoded], AT_ONCE):
        some = encoded[start:end]
        n_a, n_b = np.array([len(a) for a, _ in some]), np.array([len(b) for _, b in some])
        a = np.fromiter((i for x, _ in some for i in x), np.int64, n_a.sum())
        b = np.fromiter((i for _, x in some for i in x), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(a_length[a]), np.cumsum(b_length[b])
        _, cuts_a, cuts_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        cuts_a, cuts_b = cuts_a + 1, cuts_b + 1  # tokens up to the end of each group; a text's end is one of them
        in_a, in_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        codes = texts.codes(a, b, in_a, in_b)
        groups_to = np.searchsorted(cuts_a, last_a, side="right")
        doc_of_group = np.repeat(np.arange(len(some)), np.diff(groups_to, prepend=0))
        links = np.bincount(doc_of_group, in_a * in_b, len(some)).astype(np.int64)
        pairs, owners, weights = [], [], []
        for first, last in by_sizes((in_a * in_b).tolist(), AT_ONCE):
            from_a, from_b = cuts_a[first:last] - in_a[first:last], cuts_b[first:last] - in_b[first:last]
            if last == first + 1 and int(in_a[first]) * int(in_b[first]) > AT_ONCE:  # one long group: by distinct ids
                xs, x_times = np.unique(a[from_a[0]:cuts_a[first]], return_counts=True)
                ys, y_times = np.unique(b[from_b[0]:cuts_b[first]], return_counts=True)
                pairs.append((xs[:, None] * IDS + ys).ravel())
                weights.append((x_times[:, None] * y_times).ravel())
                owners.append(np.full(len(pairs[-1]), doc_of_group[first]))
                continue
            sides = _spread(from_a, in_a[first:last])  # each A token of each group ...
            width = np.repeat(in_b[first:last], in_a[first:last])
            others = _spread(np.repeat(from_b, in_a[first:last]), width)  # ... with each B token of the group
            pairs.append(np.repeat(a[sides], width) * IDS + b[others])
            owners.append(np.repeat(np.repeat(doc_of_group[first:last], in_a[first:last]), width))
            weights.append(np.ones(len(others), np.int64))
        pair, owner, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, owners, weights))
        order = np.lexsort((pair, owner))
        pair, owner, weight = pair[order], owner[order], weight[order]
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]) if len(pair) else np.zeros(0, np.int64)
        times = np.add.reduceat(weight, new) if len(new) else weight
        pair, owner = pair[new], owner[new]
        to = np.searchsorted(owner, np.arange(len(some)), side="right")
        group_at = pair_at = code_at = 0
        for i in range(len(some)):
            code_to = last_a[i] + last_b[i]
            yield int(groups_to[i] - group_at), int(links[i]), texts.write(codes[code_at:code_to]), pair[pair_at:to[i]], times[pair_at:to[i]]
            group_at, pair_at, code_at = groups_to[i], to[i], code_to


def align_texts(texts: DataFrame, byte_bpe: bytes, pieces: bytes) -> DataFrame:
    """key, rows, n_a, n_b, n_groups, n_links, groups and ``links`` (array of pair, times) of every row of ``texts`` (key, text, rows)."""
    sent = texts.sparkSession.sparkContext.broadcast((byte_bpe, pieces))  # two vocabulary files of fixed size
    name = hashlib.sha256(byte_bpe + pieces).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = per_worker("tokenizer", f"{name} aligned", lambda: Tokenizers(*sent.value))
        for batch in batches:
            for start, end in by_sizes(batch.column(3).to_pylist(), 400_000):
                part = batch.slice(start, end - start)
                encoded = list(both.encode(part.column(1).to_pylist()))
                n_groups, n_links, groups, pairs, times = zip(*align(encoded, both.a_length, both.b_length, both.texts))
                to = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
                links = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], names=["pair", "times"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(a) for a, _ in encoded], pa.int64()), pa.array([len(b) for _, b in encoded], pa.int64()),
                     pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(to), links)],
                    names=["key", "rows", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return texts.select("key", "text", "rows", F.octet_length("text").alias("size")).mapInArrow(
        run, "key binary, rows long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, times: long>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs: rows whose text links the pair."""
    return aligned.select("rows", F.explode("links").alias("link")).groupBy(F.col("link.pair").alias("pair")).agg(F.sum("rows").alias("n_docs"))


def with_best(counted: DataFrame) -> DataFrame:
    """``counted`` with ``best``, 1 if no pair of the same A id has more rows."""
    a = F.shiftright("pair", IDS.bit_length() - 1)
    most = broadcast_if_bounded(counted.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most")), 1_000_000)  # a row per entry of A
    return counted.withColumn("a", a).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best"))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of 2 ** (1/4) such that at most ``most`` pairs have so many rows or more."""
    step = F.floor(4 * F.log2(F.col("n_docs").cast("double")))
    left = most
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 252 rows at most: n_docs is a long
        left -= row["count"]
        if left < 0:
            return row["step"] + 1
    return 0


def measures(docs: DataFrame, byte_bpe: bytes, pieces: bytes, id_col: str = "doc_id", text: str = "text", params: AlignParams = AlignParams()) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of the groups that ``align_texts`` gives).

    Null and empty texts, and texts that a tokenizer does not give back, have no tokens: zeros, and an empty digest. Every
    row counts, repeated ones and those of null id too; no rows give none. A text of any length is one value of one task.
    """
    shared = Shared(docs.sparkSession, "alignment")
    rows = docs.select(quoted(docs, id_col).alias("id"), F.coalesce(quoted(docs, text).cast("string"), F.lit("")).alias("text"))
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("rows")).withColumn("key", text_key(F.col("text")))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = shared.save(align_texts(texts, byte_bpe, pieces).withColumn("groups_sha256", digest).drop("groups"), "aligned")

    counted = shared.save(pair_counts(aligned), "counted")
    counts = shared.save(with_best(counted), "counts")
    step = _frequent_from(counts, params.broadcast_pairs)
    frequent = F.floor(4 * F.log2(F.col("n_docs").cast("double"))) >= step
    common, rare = counts.filter(frequent), counts.filter(~frequent)
    # most links are of frequent pairs and are summed where they stand; the others meet their counts by a shuffle
    links = aligned.select("key", F.explode("links").alias("link")).select("key", "link.pair", "link.times")
    sums = _summed(links.join(F.broadcast(common), "pair"))
    if step > 0:
        others = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair")
        sums = sums.unionByName(_summed(others)).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    per_text = aligned.drop("links").join(sums, "key", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
    per_text = shared.save(per_text, "texts")

    # fewer than hot_share texts hold more than that share of the rows each: they reach the rows, the rest meet theirs by a shuffle
    total = per_text.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * params.hot_share > total
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    keyed = rows.select("id", text_key(F.col("text")).alias("key"))
    hot_texts = per_text.filter(hot)
    many = keyed.join(F.broadcast(hot_texts), "key").select(*columns)
    few = keyed.join(F.broadcast(hot_texts.select("key")), "key", "left_anti").join(per_text.filter(~hot), "key").select(*columns)
    return many.unionByName(few).withColumnRenamed("id", id_col)


def _summed(links: DataFrame) -> DataFrame:
    """n_best and count_sum of each text over these links."""
    return links.groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
