import hashlib
import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cases import PROSE, awkward, documents
from rampart.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(rows):
    """Every document alone, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_level()

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, ids_a)) != whole or b"".join(map(b_bytes, ids_b)) != whole:
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b, at = [], [], 0
        for x in ids_a:
            at += len(a_bytes(x))
            ends_a.append(at)
        at = 0
        for x in ids_b:
            at += len(b_bytes(x))
            ends_b.append(at)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links = [], []
        left_a, left_b = list(zip(ends_a, ids_a))[::-1], list(zip(ends_b, ids_b))[::-1]
        for cut in cuts:
            in_a, in_b = [], []
            for left, inside in ((left_a, in_a), (left_b, in_b)):
                while left and left[-1][0] <= cut:
                    inside.append(left.pop()[1])
            groups.append((in_a, in_b))
            links += [(x, y) for x in in_a for y in in_b]
        counts.update(set(links))
        docs.append((i, ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, ids_a, ids_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def measured(frame, **params):
    found = alignment.measures(frame, Path(A).read_bytes(), Path(B).read_bytes(), params=alignment.AlignParams(**params))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query_against_every_document_alone(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = queries.QUERIES["op11_alignment"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_odd_texts_repeated_rows_and_rare_pairs(spark):
    rng = random.Random(3)
    odd = ["", None, " ", "  two  blanks ", "\n\ttabs\r\n", "<|endoftext|> and </s> <unk> <0x41>", "▁ low line", "ﬁ ligature ½", "日本語 текст ελ 🙂🙂", " 　", "a" * 5000, "ab" * 3000, "\U0001f600" * 700, "x\u0000y"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, PROSE) for i in range(30)] + [(100, PROSE), (None, PROSE), (None, None)]
    rows += [(200 + i, " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(50))) for i in range(20)]
    want = by_hand(rows)
    frame = documents(spark, rows)
    assert measured(frame) == want
    assert measured(frame, broadcast_pairs=40, hot_share=4) == want  # most pairs by a shuffle, and one hot text
    assert measured(frame, broadcast_pairs=0) == want


def test_empty_table_and_clashing_columns(spark):
    frame = awkward(spark, [(1, "some text"), (2, None)], ("number", "body"))
    got = alignment.measures(frame, Path(A).read_bytes(), Path(B).read_bytes(), "number", "body")
    assert sorted((r["number"], r["n_a"] > 0, r["groups_sha256"] != "") for r in got.collect()) == [(1, True, True), (2, False, False)]
    assert alignment.measures(frame.filter("false"), Path(A).read_bytes(), Path(B).read_bytes(), "number", "body").count() == 0


def test_byte_letters_are_those_of_the_tokenizer():
    a = Tokenizer.from_file(A)
    for text in (" Zażółć gęślą jaźń", "日本\t\n\x00\x7f\xa0\xad"):
        written = "".join(a.encode(text, add_special_tokens=False).tokens)
        assert bytes(alignment.byte_level()[c] for c in written) == text.encode()


def test_both_ways_to_the_first_tokenizer_agree():
    description = Path(A).read_bytes()
    own = Tokenizer.from_buffer(description)
    own.encode_special_tokens = True
    vocabulary, plain = alignment.byte_encoder(description)
    other = json.loads(description)
    other["pre_tokenizer"]["add_prefix_space"] = True  # no longer the plain form
    texts = [" a{0}1{0} {0}{0}  {0}x'{0} <|endoftext|>".format(chr(c)) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert plain(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert alignment.byte_encoder(json.dumps(other).encode())[1](texts[:300]) == plain([t if t[0] == " " else " " + t for t in texts[:300]])
    assert vocabulary == own.get_vocab(with_added_tokens=True)


def test_one_long_group_is_linked_by_distinct_ids(monkeypatch):
    a, a_length, b_length = [1, 2, 1] * 300, np.zeros(10, np.int64), np.zeros(10, np.int64)
    a_length[1], a_length[2] = 3, 2
    b_length[9], b_length[6] = a_length[a].sum() - 1, 1  # ends meet only at the end
    for most in (100, 1_000_000):
        monkeypatch.setattr(alignment, "AT_ONCE", most)
        groups, links, text, pairs, times = next(alignment.align([(a, [9, 6])], a_length, b_length, alignment.GroupTexts(10, 10)))
        assert groups == 1 and links == 2 * len(a) and text == ",".join(map(str, a)) + "|9,6"
        assert {divmod(p, alignment.IDS): t for p, t in zip(pairs.tolist(), times.tolist())} == {(1, 9): 600, (1, 6): 600, (2, 9): 300, (2, 6): 300}
