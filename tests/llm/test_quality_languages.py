"""Quality rules where languages are rare, or have too little text for a reference."""

import random
from collections import Counter

import pyarrow as pa
from rampart.llm import quality


def prose(rng, letters, common, n):
    """``n`` words, half of them from ``common``, the others unknown ones of ``letters``."""
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(8)) for _ in range(n))


def vocabulary(rng, letters, size=60, length=3):
    return ["".join(rng.choice(letters) for _ in range(length)) for _ in range(size)]


LATIN, GREEK, CYRILLIC = "abcdefghijklmnop", "αβγδεζηθικλμ", "абвгдежзиклм"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")


def kept(spark, rows):
    docs = frame(spark, rows)
    flags = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.references(docs)).collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, k in flags.items() if k}
    return [flags[i] for i in range(len(rows))]


def test_a_rare_language_has_its_own_reference(spark):
    rng = random.Random(1)
    en, el = vocabulary(rng, LATIN), vocabulary(rng, GREEK, length=2)
    rows = [(prose(rng, LATIN, en, 3000), "en") for _ in range(200)] + [(prose(rng, GREEK, el, 400), "el") for _ in range(6)]  # 0.4 % of all words
    junk = " ".join("".join(rng.choice(LATIN + "#|<>$%") for _ in range(8)) for _ in range(400))
    assert kept(spark, rows + [(junk, "en")]) == [True] * 206 + [False]


def test_a_language_with_little_text_is_not_judged_by_others(spark):
    rng = random.Random(2)
    en, el = vocabulary(rng, LATIN), vocabulary(rng, GREEK, length=2)
    rows = [(prose(rng, LATIN, en, 500), "en") for _ in range(50)] + [(prose(rng, GREEK, el, 400), "el")]
    docs = frame(spark, rows)
    refs = quality.references(docs)
    assert [r[0] for r in refs] == ["en"]
    last = quality.judge(docs, refs).filter("doc_id = 50").first()
    assert last["kept"] and last["class_distance"] is None and last["word_distance"] is None


def test_references_in_blocks_give_the_least_distance_of_all(monkeypatch):
    rng = random.Random(3)
    refs, texts = [], []
    for k in range(7):
        common = vocabulary(rng, LATIN, length=4)
        texts.append(prose(rng, LATIN, common, 600))
        refs.append((f"x{k}", [3000, 10, 1, 50, 0], {w.encode(): 5 for w in common}, 600))
    monkeypatch.setattr(quality, "BLOCK", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.nulls(7, pa.string())], names=["id", "text", "lang"])
    far = lambda some: [d for part in quality._judging(some, quality.QualityRules())(iter([batch])) for d in part.column("word_distance").to_pylist()]
    assert far(refs) == [min(x) for x in zip(*(far([r]) for r in refs))]


def test_most_common_words_by_slices_are_those_of_all(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(5000)], k=4000)), "en") for _ in range(5)]
    (_, _, got, n), = quality.references(frame(spark, rows))
    every = Counter(w for t, _ in rows for w in quality.folded_words(t))
    assert n == 20_000 and list(got.items()) == sorted(every.items(), key=lambda x: (-x[1], x[0]))[:100]


def test_junk_is_not_saved_by_languages_of_long_words(spark):
    rng = random.Random(5)
    en, ru = vocabulary(rng, LATIN), vocabulary(rng, CYRILLIC) + ["и", "не"]
    rows = [(prose(rng, LATIN, en, 900), "en") for _ in range(20)] + [(prose(rng, CYRILLIC, ru, 900), "ru") for _ in range(20)]
    junk = " ".join("".join(rng.choice(CYRILLIC) for _ in range(7)) for _ in range(900))
    assert kept(spark, rows + [(junk, "ru"), (junk, "en")]) == [True] * 40 + [False] * 2


def test_a_language_without_common_words_judges_only_its_own(spark):
    rng = random.Random(6)
    en = vocabulary(rng, LATIN)
    unknown = lambda: " ".join("".join(rng.choice(LATIN) for _ in range(9)) for _ in range(900))
    rows = [(prose(rng, LATIN, en, 900), "en") for _ in range(20)] + [(unknown(), "zz") for _ in range(5)]
    assert kept(spark, rows + [(unknown(), None), (unknown(), "en")]) == [True] * 26 + [False]
