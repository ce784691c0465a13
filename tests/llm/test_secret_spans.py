"""Added spans against a brute-force scoring, what stands beside base spans, and the time that many matches take."""

import random
import re
import string
import time

import duckdb

from cases import documents
from rampart.llm import queries, secret_scan
from test_texts import FOLDER, SECRETS, spans_by_hand

LIKELY = "sk_live_9aBx72KqPz01LmQw"


def added_by_hand(text, table, params=secret_scan.SecretParams()):
    """Runs of what base spans leave, scored character by character; base spans of these texts don't overlap."""
    left = list(text)
    for a, _, b in spans_by_hand(text):
        left[a:b] = " " * (b - a)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", "".join(left)):
        if len(m[0]) >= params.least:
            at = [0, *(secret_scan.ALPHABET.index(c) + 1 for c in m[0])]
            ratio = sum(table[a * (len(secret_scan.ALPHABET) + 1) + b] for a, b in zip(at, at[1:])) / len(m[0])
            if ratio >= params.threshold:
                out.append((m.start(), 3, m.end()))
    return out


def labelled(spark):
    """Documents of identifiers with one random token each."""
    rng, words = random.Random(5), ["get", "user", "name", "request", "table", "value", "field", "long", "the"]
    names = lambda: " ".join("_".join(rng.choice(words) for _ in range(4)) for _ in range(30))
    return documents(spark, [(i, names() + ' token = "' + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) + '"') for i in range(60)])


def test_all_spans_by_hand(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = [t for t, in duckdb.connect().execute(f"select text from '{FOLDER}/documents.parquet'").fetchall()]
    odd = [f"é {noise(30)} token={noise(12)} 😀 {noise(24)}-{'0123456789abcdef' * 2} the_name_of_a_long_field {noise(40)}/{noise(3)}", f"{noise(22)}\nAKIA{'Z9' * 12}\n{noise(22)}"]
    rows = list(enumerate([*SECRETS, *odd, *texts]))
    frame = documents(spark, rows)
    table = secret_scan.model(labelled(spark))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan(frame, table).collect()}
    want = {i: sorted(spans_by_hand(t or "") + added_by_hand(t or "", table)) for i, t in rows}
    assert got == want and sum(k == 3 for s in got.values() for _, k, _ in s) >= 5


def test_the_registered_query_is_the_scan_of_all_documents(spark):
    docs = duckdb.connect().execute(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    table = secret_scan.model(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op8_secrets"](spark, FOLDER).collect()}
    for i, text in docs:
        spans = sorted(spans_by_hand(text or "") + added_by_hand(text or "", table))
        assert got.pop(i) == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert not got


def test_what_stands_beside_a_base_span_is_scored(spark):
    table = secret_scan.model(labelled(spark))
    hexes = "0123456789abcdef01234567"
    frame = documents(spark, [(0, f"key {LIKELY}-{hexes} end"), (1, f"get_user_name_request_table-{hexes}")])
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame, table).collect()}
    assert got == {0: "key [SECRET][SECRET] end", 1: "get_user_name_request_table-[SECRET]"}


def test_time_grows_with_the_matches(spark):
    table = [0.0] * 69 * 69

    def run(n):
        text = " ".join(f"{i:024x}" for i in range(n))
        frame = documents(spark, [(0, text)]).cache()
        frame.count()
        start = time.monotonic()
        spans = [tuple(s) for s in secret_scan.scan(frame, table).first()["spans"]]
        assert spans == [(25 * i, 2, 25 * i + 24) for i in range(n)]
        return time.monotonic() - start

    run(2000)
    few, many = run(8000), run(64000)
    assert many < 2 + 24 * few  # eight times the matches; a square would take 64 times as long
