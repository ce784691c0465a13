import hashlib
import random

import duckdb
import numpy as np
import pytest

from cases import awkward, documents
from rampart.llm import queries, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def by_hand(rows, length=100):
    """Every string of ``length`` bytes in a set, document by document."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            piece = hash(data[p:p + length]), data[p:p + 8]
            if piece in seen:
                gone[p:p + length] = True
            seen.add(piece)
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(frame, id_col="doc_id", text="text", **params):
    found = suffix_dedup.deduplicate(frame, id_col, text, suffix_dedup.DedupParams(**params)).collect()
    for r in found:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) and r["n_spans"] == len(r["spans"]) and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    return [(r[id_col], (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in found]


def test_query_against_a_set_of_all_strings(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = queries.QUERIES["op12_suffix_dedup"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == by_hand(rows)


def mixture(seed):
    """Texts pasted of common stretches of all lengths around 100 bytes, runs of one and of two letters, and edits."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghij é☃") for _ in range(n)) for n in (30, 60, 90, 98, 99, 100, 101, 103, 130, 160, 200, 400)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            piece = rng.choice(stock)
            a = rng.randrange(len(piece) // 3)
            parts.append(rng.choice([piece, piece[a:], piece[:-a or None], "".join(rng.choice("klm ") for _ in range(rng.randint(0, 40)))]))
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 700), (201, "a" * 99), (202, "a" * 100 + "b"), (203, "ab" * 400), (204, "ab" * 50 + "a"), (205, stock[-1] * 5), (206, ""), (207, None), (208, "é" * 300), (209, stock[-1])]
    return rows


@pytest.mark.parametrize("block", [700, 2_000_000])
def test_mixtures_in_small_and_large_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = mixture(block)
    random.Random(1).shuffle(rows)
    for parts in (1, 5):
        assert dict(removed(documents(spark, rows).repartition(parts))) == by_hand(rows)


def test_repeated_rows_are_one_document(spark):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(300))
    other = text[:150] + "x" * 60 + text[150:]
    rows = [(1, text)] * 3 + [(2, text), (2, text), (3, other), (3, "short"), (None, other), (4, None)]
    got = removed(documents(spark, rows).repartition(3))
    want = by_hand([(0, other), (1, text), (2, text)])
    assert {x[1] for x in got if x[0] == 1} == {want[1]} and {x[1] for x in got if x[0] == 2} == {want[2]} and [x[1] for x in got if x[0] is None] == [want[0]]
    assert len(got) == len(rows) and sorted(x[1][1] for x in got if x[0] == 3) == [0, len(other)]


def test_long_text_clashing_columns_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50_000)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, long), (2, long[1000:1500] + "-" + long[150_000:150_100]), (3, long[120_000:])]
    frame = awkward(spark, rows, ("number", "body"))
    assert dict(removed(frame, "number", "body")) == by_hand(rows)
    assert removed(frame.filter("false"), "number", "body") == []
    assert dict(removed(frame, "number", "body", length=40)) == by_hand(rows, 40)


def test_sort_is_that_of_the_bytes_and_collisions_are_found(monkeypatch):
    rng = random.Random(7)
    raw = "".join(rng.choice(["ab", "a", "abcabc" * 8, "x"]) for _ in range(3000)).encode()
    starts = np.arange(0, len(raw) - 120)
    lengths = np.array([rng.randint(100, 120) for _ in starts])
    order, same = suffix_dedup.Suffixes(raw).sort(starts, lengths)
    cut = [raw[a:a + n] for a, n in zip(starts, lengths)]
    gram = [c[:suffix_dedup.GRAM] for c in cut]
    for i in range(1, len(order)):
        x, y = order[i - 1], order[i]
        assert same[i] == (cut[x] == cut[y])
        if gram[x] == gram[y]:
            assert cut[x] < cut[y] or (cut[x] == cut[y] and x < y)
    assert (~same).sum() == len(set(cut))
    honest = suffix_dedup.Suffixes.hashes
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashes", lambda self, a, n: honest(self, a, n) >> np.uint64(60))
    with pytest.raises(suffix_dedup.Collision):
        suffix_dedup.Suffixes(raw).sort(starts, lengths)
