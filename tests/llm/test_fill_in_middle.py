import hashlib
import random
import re

from cases import PROSE, awkward, documents
from rampart.llm import fill_in_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def by_hand(row, text):
    """Units, form, code points of prefix and middle, output."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if row is None else row}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def odd_texts():
    rng = random.Random(9)
    texts = ["", None, "a", " ", "<P", "a<P>b", "x<S>", "<M>", "<", "<<P", "été œuvre 🙂🙂", "\n\n\r\n\t", "a" * 9000, " " * 9000, "ab1" * 4000, PROSE, PROSE]
    for n in (47, 48, 49, 95, 2047, 2048, 2049, 30_000):
        texts.append("".join(rng.choice(["x", "yZ", " ", "9", "é", "<", "P>"]) for _ in range(n)))
    shared = "".join(rng.choice("abc de") for _ in range(5000))
    texts += [shared[i:] + "tail" * i for i in range(12)]
    return texts


def test_every_cut_of_odd_texts_and_the_way_back(spark):
    rows = [(i * 31 + k, t) for i, t in enumerate(odd_texts()) for k in range(6)] + [(None, PROSE), (5, PROSE), (5, PROSE)]
    got = fill_in_middle.transform(documents(spark, rows).repartition(4)).collect()
    have = sorted(((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got), key=repr)
    assert have == sorted(((i, by_hand(i, t)) for i, t in rows), key=repr)
    assert sorted((r["doc_id"], r["restored"]) for r in got if r["doc_id"] is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_counts_and_places_of_every_prefix():
    known = fill_in_middle.Summaries()
    for text in odd_texts():
        units = UNIT.findall(text or "")
        document = fill_in_middle.Document(text or "", known)
        assert document.units == len(units) and (not text or document.ends[-1] == len(text))
        ends = [0]
        for u in units:
            ends.append(ends[-1] + len(u))
        for k in {0, 1, len(units) // 2, len(units) - 1, len(units)} | set(range(0, len(units), max(1, len(units) // 40))):
            if 0 <= k <= len(units):
                assert document.place(k) == ends[k]


def test_shared_passages_share_chunks_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "KEPT_CHARS", 3000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    cut = lambda text: {c for a, b in zip([0, *fill_in_middle.Document(text, fill_in_middle.Summaries()).ends], fill_in_middle.Document(text, fill_in_middle.Summaries()).ends) for c in [text[a:b]]}
    both = cut("one beginning " + passage) & cut("another, longer beginning of the text " + passage)
    assert sum(map(len, both)) > 0.8 * len(passage)
    known = fill_in_middle.Summaries()
    for _ in range(30):
        fill_in_middle.Document("".join(rng.choice("abc ") for _ in range(3000)), known)
    assert known.held < 3000 + 2 * fill_in_middle.LONGEST and sum(map(len, known.old)) < 3000 + 2 * fill_in_middle.LONGEST


def test_clashing_columns_and_no_rows(spark):
    frame = awkward(spark, [(1, PROSE), (2, None)], ("number", "body"))
    got = {r["number"]: r["restored"] for r in fill_in_middle.transform(frame, "number", "body").collect()}
    assert got == {1: PROSE, 2: ""}
    assert fill_in_middle.transform(frame.filter("false"), "number", "body").count() == 0
