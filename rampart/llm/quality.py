"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared, by Jensen-Shannon
distance, with those of each language of the corpus. References are counted over all documents. A language with
too little text has none, and its documents are not judged by distances.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Shared, by_chars, free_name, quoted, slices, small_batches

#: White space of the word rule; the rest of a text is words.
SPACES = " \t\n\x0b\x0c\r"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Character classes of the histogram. Digits are in none of them: numbers are content, not noise.
CLASSES = ("lower", "upper", "symbol", "stop", "wide")
_CLASS_OF_BYTE = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _bytes in enumerate((range(97, 123), range(65, 91), b"#*$%&|<>!@^~_=+\\{}[]/`", b".,;:?'\"()-", range(0xC0, 0x100))):
    _CLASS_OF_BYTE[list(_bytes)] = _i  # the last: first bytes of characters beyond ASCII
_MARKS = b".,;:?!'\"()-"
#: Bounds of memory: languages whose words are one matrix, texts and characters judged at a time, words counted by a task.
BLOCK, ROWS, CHARS, HELD = 32, 1000, 4_000_000, 200_000


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Distances are Jensen-Shannon, base 2, so between 0 and 1.

    ``common_words`` words per language make the word histogram, all other words are one bin more. Words of any length
    count; ``word_bytes`` can leave longer ones out. A language is a value of ``lang``. It has a reference from ``reference_words`` words on (and
    ``language_share`` of all words; 0 asks for none). The class histogram is judged from ``class_chars`` word characters, the word histogram from
    ``word_words`` words; both limits widen for short texts, by slack / sqrt(length), the noise of a small sample.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 100
    word_bytes: int = 2**31 - 1
    language_share: float = 0.0
    reference_words: int = 1000
    class_chars: int = 100
    max_class_distance: float = 0.20
    class_slack: float = 1.0
    word_words: int = 30
    max_word_distance: float = 0.30
    word_slack: float = 1.3


def class_counts(data: bytes) -> np.ndarray:
    """Counts of ``CLASSES`` among the characters of a UTF-8 text."""
    return np.bincount(_CLASS_OF_BYTE[np.frombuffer(data, dtype=np.uint8)], minlength=len(CLASSES) + 1)[:-1]


def folded_words(text: str) -> list[bytes]:
    """The words of the word histogram: lower case, without punctuation."""
    return text.lower().encode("utf-8").translate(None, _MARKS).split()


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """How many words lie in a window of ``span`` words that occurs at least twice."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = hashes[:n].copy()
    for step in range(1, span):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[step:step + n]
    key.sort()
    if (key[1:] != key[:-1]).all():  # equal windows have equal hashes, so none is repeated
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    key = codes[:n]
    for step in range(1, span):  # pairs of small numbers, renumbered: exact, no hashing
        key = np.unique(key * len(numbers) + codes[step:step + n], return_inverse=True)[1]
    twice = (np.bincount(key) > 1)[key]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    change[:n] += twice
    change[span:span + n] -= twice
    return int((np.cumsum(change) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return (len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def distances(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row's histogram from ``reference``; rows must not be empty."""
    p = rows / rows.sum(axis=1, keepdims=True)
    q = (reference / reference.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


def _language_counts(word_bytes: int):
    """Per task: classes (class 0..), all words (-2) and each word (-1) by language, added up so that few rows are shuffled; handed on now and then, to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        n_words: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(k, i, b"", int(n)) for k, c in classes.items() for i, n in enumerate(c)] + [(k, -2, b"", n) for k, n in n_words.items()]
            rows += [(k, -1, w, n) for k, c in words.items() for w, n in c.items()]
            classes.clear(), words.clear(), n_words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.int64()))], names=["lang", "class", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                if lang is None or not text:
                    continue
                found = folded_words(text)
                classes[lang] = classes.get(lang, 0) + class_counts(text.encode("utf-8"))
                n_words[lang] += len(found)
                known = words.setdefault(lang, Counter())
                before = len(known)
                known.update([w for w in found if len(w) <= word_bytes])
                held += len(known) - before + (10 if not before else 0)  # a language costs about as much as ten words
                if held > HELD:
                    yield out()
                    held = 0
        if classes:
            yield out()

    return run


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> list[tuple[str, list[int], dict[bytes, int], int]]:
    """(language, class counts, common words with counts, all words) per language with a reference, over all documents.

    Words are ranked in slices of each language, then among the best of the slices, so no task ranks a whole
    vocabulary. The driver collects 5 classes and ``common_words`` words for each reference.
    """
    counted = docs.select(quoted(docs, lang).cast("string"), quoted(docs, text).cast("string")).mapInArrow(_language_counts(rules.word_bytes), "lang string, class int, word binary, n long")
    shared = Shared(docs.sparkSession, "quality")
    counts = shared.save(counted.groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "counts")
    totals = counts.filter("class = -2")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    enough = totals.filter(F.col("n") >= max(rules.reference_words, rules.language_share * whole)).select("lang", F.col("n").alias("words"))
    langs = {r["lang"]: r["words"] for r in enough.collect()}
    of = counts.join(F.broadcast(enough), "lang")
    classes: dict[str, list[int]] = {name: [0] * len(CLASSES) for name in langs}
    for r in of.filter("class >= 0").collect():
        classes[r["lang"]][r["class"]] = r["n"]
    best = of.filter("class = -1 and length(word) > 0").select("lang", "word", "n", F.pmod(F.xxhash64("word"), F.lit(32)).alias("slice"))
    for keys in (["lang", "slice"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words)
    words: dict[str, dict[bytes, int]] = {name: {} for name in langs}
    for r in sorted(best.select("lang", "rank", "word", "n").collect(), key=lambda r: r["rank"]):
        words[r["lang"]][bytes(r["word"])] = r["n"]
    shared.drop("counts")
    return [(name, classes[name], words[name], langs[name]) for name in sorted(langs)]


def _language(docs: DataFrame, lang: str) -> Column:
    """The language of each row; null where the frame has no such column."""
    return quoted(docs, lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")


def judge(docs: DataFrame, refs: list, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The base counts and the verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance.

    A null text is an empty one: no words, so ``base_failed``. A distance is null where its guard leaves the
    text unjudged (too short, or of a language that has no reference); such a text passes that rule. The smallest
    distance over all languages counts, so a null ``lang``, or one taken for another, does no harm; but a language whose
    common words are so few of its words that any unknown ones lie near it judges, by words, only its own
    documents and those of a null ``lang``. Repeated rows are judged each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(docs, id_col).alias("id"), F.coalesce(quoted(docs, text).cast("string"), F.lit("")).alias("text"), _language(docs, lang).alias("lang"))
    return rows.mapInArrow(
        _judging(refs, rules),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double",
    ).withColumnRenamed("id", id_col)


def _judging(refs: list, rules: QualityRules):
    class_refs = [np.array(c, dtype=float) for _, c, _, _ in refs if sum(c)]
    classed, worded = {x[0] for x in refs if sum(x[1])}, {x[0] for x in refs if x[2]}
    places: dict[bytes, int] = {}
    word_refs = []
    for name, _, words, n in refs:
        if words:
            known = np.array(list(words.values()), dtype=float)
            reference = np.append(known, max(0.0, n - known.sum()))
            unknown = np.append(np.zeros(len(known)), 1.0)[None, :]
            own = name if distances(unknown, reference)[0] <= rules.max_word_distance else None
            word_refs.append((np.array([places.setdefault(w, len(places)) for w in words]), reference, own))
    other = len(places)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]

    def by_words(codes: list[np.ndarray], langs: list) -> np.ndarray:
        """Least word distance of texts, given as places of their words; the references are taken in blocks."""
        sizes = np.array([len(c) for c in codes])
        found, row, every = np.full(len(codes), np.inf), np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes)
        for start in range(0, len(word_refs), BLOCK):
            block = word_refs[start:start + BLOCK]
            columns = np.unique(np.concatenate([c for c, _, _ in block]))
            local = np.full(other + 1, len(columns))
            local[columns] = np.arange(len(columns))
            width = len(columns) + 1
            rows = np.bincount(row * width + local[every], minlength=len(codes) * width).reshape(-1, width)
            for c, reference, own in block:
                judges = np.array([own is None or lang is None or lang == own for lang in langs], dtype=bool)
                if judges.any():
                    known = rows[judges][:, local[c]]
                    found[judges] = np.minimum(found[judges], distances(np.column_stack([known, sizes[judges] - known.sum(axis=1)]), reference))
        return found

    def judged(texts: list, langs: list) -> list:
        base = np.zeros((len(texts), 5), dtype=np.int64)
        class_rows = np.zeros((len(texts), len(CLASSES)))
        codes: dict[int, np.ndarray] = {}
        for i, (text, lang) in enumerate(zip(texts, langs)):
            if not text:
                continue
            data = text.encode("utf-8")
            words = data.split()
            base[i] = len(words), *base_counts(text, words)
            class_rows[i] = class_counts(data)
            if word_refs and len(words) >= rules.word_words and (lang is None or lang in worded):
                codes[i] = np.array([places.get(w, other) for w in folded_words(text)] or [other], dtype=np.int64)
        n, total = base[:, 0], class_rows.sum(axis=1)
        failed = (n < rules.min_words) | (100 * base[:, 4] > rules.max_repeat_percent * n)
        by_class, by_word = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        has_class = (total >= rules.class_chars) & np.array([lang is None or lang in classed for lang in langs], dtype=bool)
        if class_refs and has_class.any():
            by_class[has_class] = np.min([distances(class_rows[has_class], r) for r in class_refs], axis=0)
        if codes:
            by_word[list(codes)] = by_words(list(codes.values()), [langs[i] for i in codes])
        with np.errstate(divide="ignore", invalid="ignore"):  # a nan is no judgement
            bad = (by_class > rules.max_class_distance + rules.class_slack / np.sqrt(total)) | (by_word > rules.max_word_distance + rules.word_slack / np.sqrt(n))
        return [pa.array(base[:, i]) for i in range(5)] + [pa.array(failed), pa.array(~failed & ~bad), pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts, langs = part.column(1).to_pylist(), part.column(2).to_pylist()
                for start, end in by_chars(texts, CHARS):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(start, end - start), *judged(texts[start:end], langs[start:end])], names=["id", *names])

    return run


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep."""
    decide = _judging(references(docs, text, lang, rules), rules)
    small_batches(docs.sparkSession)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows), part.column(width), part.column(width + 1)], names=["id", "text", "lang"])
                kept = pa.concat_arrays([judged.column("kept") for judged in decide(iter([own]))])
                yield pa.RecordBatch.from_arrays(part.columns[:width], schema=pa.schema(list(part.schema)[:width])).filter(kept)

    judged_text, judged_lang = free_name(docs, "rp_judged_text"), free_name(docs, "rp_judged_lang")
    columns = [quoted(docs, c) for c in docs.columns]
    return docs.select(*columns, quoted(docs, text).cast("string").alias(judged_text), _language(docs, lang).alias(judged_lang)).mapInArrow(run, docs.schema)
