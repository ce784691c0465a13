import random
from collections import Counter

import duckdb
import numpy as np

from cases import PROSE, awkward
from rampart.llm import dart_minhash, decontaminate, queries
from rampart.llm.common import Shared
from rampart.llm.components import components

FOLDER = "/root/testdata/sf0.001"
PARAMS = dart_minhash.DartParams()


def words(rng, n):
    return ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def classes_by_hand(rows):
    """All pairs of different texts, and union-find."""
    texts = sorted({t for _, t in rows if t is not None})
    least = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[t] = min(i, least.get(t, i))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if min(len(texts[i]), len(texts[j])) > 0.6 * max(len(texts[i]), len(texts[j])) and dart_minhash.weighted_jaccard(texts[i], texts[j], 5) >= 0.8:
                root[find(i)] = find(j)
    of = {}
    for k, t in enumerate(texts):
        if t in least:
            of[find(k)] = min(least[t], of.get(find(k), least[t]))
    place = {t: k for k, t in enumerate(texts)}
    return Counter((i, i if t is None else of.get(find(place[t])) if sum(x == t or find(place[x]) == find(place[t]) for _, x in rows if x is not None) > 1 else i) for i, t in rows)


def variants(seed=4):
    """A text, variants of it with few and with more words changed, and chains of changes."""
    rng = random.Random(seed)
    base = words(rng, 160)
    rows = [(1, " ".join(base)), (2, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(160), rng.choice([1, 1, 2, 2, 3, 4, 5, 6])):
            copy[at] = f"new{rng.randint(0, 5)}"
        rows.append((10 + i, " ".join(copy)))
    chain = words(rng, 150)
    for i in range(12):
        rows.append((100 + i, " ".join(chain)))
        chain[10 * i] = f"step{i}"
        chain[10 * i + 5] = f"more{i}"
    return rows + [(200 + i, " ".join(words(rng, rng.randint(3, 200)))) for i in range(40)]


def test_dart_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(1)
    for x, y in (((1.0, 1.0), (1.0, 1.0)), ((1.0, 2.5), (1.0, 1.5)), ((0.3, 3.0), (0.9, 3.0))):
        found, n = [], 200
        for _ in range(12):
            elements = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.repeat(x, n), np.repeat(y, n)
            s = dart_minhash.signatures(np.repeat([0, 1], 2 * n), np.concatenate([elements, elements]), np.concatenate([a, b]), 2, 256)
            found.append((s[0] == s[1]).mean())
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(found) - want) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    texts = [t for _, t in variants()] + ["", None, "one", "two words"]
    whole = np.concatenate([s for s, _ in dart_minhash.sketch_texts(texts, PARAMS)])
    alone = np.concatenate([s for t in texts for s, _ in dart_minhash.sketch_texts([t], PARAMS)])
    assert (whole == alone).all()


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Shared(spark, "test"), "x").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), Shared(spark, "test"), "x").count() == 0


def test_classes_against_all_pairs(spark):
    rows = variants()
    got = Counter((r["doc_id"], r["class_id"]) for r in dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes_by_hand(rows)


def test_copies_of_awkward_rows(spark):
    long = " ".join(words(random.Random(1), 30_000))
    rows = [(5, PROSE), (5, PROSE), (3, PROSE + " falls"), (None, None), (6, None), (7, ""), (8, ""), (9, "one two"), (10, "One, two!"), (11, long), (12, long + " end"), (None, "alone in here"), (13, "###")]
    frame = awkward(spark, rows, ("doc_id", "text"))
    got = Counter((r["doc_id"], r["class_id"]) for r in dart_minhash.classes(frame).collect())
    assert got == Counter([(5, 3), (5, 3), (3, 3), (None, None), (6, 6), (7, 7), (8, 7), (9, 9), (10, 9), (11, 11), (12, 11), (None, None), (13, 13)])
    kept = dart_minhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in kept.collect()) == [(False, 3, False), (False, 6, True), (False, 7, False), (False, 9, False), (False, 11, False), (False, 13, False), (True, 0, False), (True, 0, True)]
    none = awkward(spark, [], ("doc_id", "text"))
    assert dart_minhash.classes(none).count() == 0 and dart_minhash.keep_first(none).count() == 0
    repeated = dart_minhash.keep_first(awkward(spark, [(1, PROSE)] * 4 + [(2, PROSE)], ("doc_id", "text")))
    assert [r["doc_id"] for r in repeated.collect()] == [1]


def test_registered_copies_query_against_brute_force(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = Counter((r["doc_id"], r["class_id"]) for r in queries.QUERIES["op3_dart_minhash"](spark, FOLDER).collect())
    assert got == classes_by_hand(rows)


def overlaps_by_hand(docs, items, params=decontaminate.SeedParams()):
    """Every diagonal that some mask hits, and the best stretch on it."""
    import re
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for i, t in docs:
        w = split(t)
        for k, b in items:
            v = split(b)
            shifts = set()
            for mask in params.masks:
                on = [j for j, c in enumerate(mask) if c == "1"]
                at = {}
                for p in range(len(v) - len(mask) + 1):
                    at.setdefault(tuple(v[p + j] for j in on), []).append(p)
                for p in range(len(w) - max(on)):
                    shifts.update(p - q for q in at.get(tuple(w[p + j] for j in on), []))
            for s in shifts:
                run = best = 0
                for j in range(len(v)):
                    if 0 <= s + j < len(w):
                        run = max(run, 0) + (1 if w[s + j] == v[j] else -1)
                        best = max(best, run)
                if best >= params.min_score:
                    found[i, k] = max(best, found.get((i, k), 0))
    return found


def test_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randint(5, 60)))) for i in range(12)] + [(90, "of the and to in a of the and to in"), (91, None), (None, PROSE)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(0, 120))
        if i % 3:
            part = (items[i % 12][1] or "").split()
            part = [x if rng.random() > 0.12 * (i % 4) else "changed" for x in part[rng.choice([0, 0, 3]):]]
            w[len(w) // 2:len(w) // 2] = part
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "The quick, brown FOX " + PROSE[20:]), (102, "The quick, brown FOX " + PROSE[20:])]
    frame, bench = awkward(spark, rows, ("doc_id", "text")), spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("*", "1 as id", "2 as doc_id")
    for params in (decontaminate.SeedParams(), decontaminate.SeedParams(block_seeds=300)):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.overlaps(frame, bench, params).collect()}
        assert got == overlaps_by_hand(rows, items)
    kept = decontaminate.keep_clean(frame, bench)
    leaking = {i for i, _ in got}
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in leaking)
    assert decontaminate.keep_clean(frame, bench, broadcast_rows=0).count() == kept.count()
    assert decontaminate.overlaps(frame.filter("false"), bench).count() == 0 and decontaminate.keep_clean(frame, bench.filter("false")).count() == len(rows)


def test_substituted_passages_are_caught(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 40))) for i in range(30)]
    rows = []
    for i, t in items:
        w = t.split()
        for at in rng.sample(range(40), 6):
            w[at] = "substitute"
        rows.append((i, " ".join(words(rng, 50) + w + words(rng, 50))))
    clean = [(1000 + i, " ".join(words(rng, 150))) for i in range(100)]
    got = {r["doc_id"] for r in decontaminate.overlaps(spark.createDataFrame(rows + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & set(range(30))) >= 29 and not any(i >= 1000 for i in got)


def test_registered_overlaps_against_brute_force(spark):
    db = duckdb.connect()
    docs, items = (db.execute(f"select * from '{FOLDER}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.QUERIES["op9_decontaminate"](spark, FOLDER).collect()}
    assert got == overlaps_by_hand([r[:2] for r in docs], items)


def test_a_long_copy_takes_linear_time(spark):
    import time

    def seconds(n):
        rng = random.Random(n)
        item = words(rng, n)
        copy = list(item)
        copy[n // 2] = "other"
        docs = spark.createDataFrame([(1, " ".join(words(rng, 50) + copy)), (2, " ".join(item[:7]))], "doc_id long, text string")
        bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
        began = time.time()
        got = [(r["doc_id"], r["score"], r["n_words"], r["n_equal"]) for r in decontaminate.overlaps(docs, bench).collect()]
        assert got == [(1, n - 2, n, n - 1)]
        return time.time() - began

    seconds(200)
    assert seconds(8_000) < 8 * max(seconds(2_000), 1.0)


def test_pieces_of_documents_change_nothing(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.choice([8, 9, 20, 60])))) for i in range(12)] + [(50, "of the and to in a of the and to in a")]
    items += [(20 + i, t) for i, t in items[:3]] + [(0, items[1][1]), (51, "too short to hit"), (52, None)]
    rows = [(i, " ".join(words(rng, n))) for i, n in enumerate([0, 7, 8, 9, 59, 60, 61, 62, 120, 200])] + [(30, "of the and to in a " * 90), (31, None), (None, items[3][1])]
    for i in range(40):
        w = words(rng, rng.choice([0, 1, 55, 130, 300]))
        for _ in range(3):
            part = rng.choice(items[:12])[1].split()
            part = [x if rng.random() > 0.1 * (i % 3) else "changed" for x in part]
            at = rng.randint(0, len(w))
            w[at:at] = part[rng.choice([0, 0, 2]):]
        rows.append((100 + i, " ".join(w)))
    frame, bench = awkward(spark, rows, ("doc_id", "text")), spark.createDataFrame(items, "item_id long, text string")

    def found(params):
        return sorted(tuple(r) for r in decontaminate.overlaps(frame.filter("doc_id is not null or text is not null"), bench, params).drop("key").fillna(-1, "doc_id").collect())

    whole = found(decontaminate.SeedParams())
    assert len(whole) > 40 and whole == found(decontaminate.SeedParams(piece_words=1)) == found(decontaminate.SeedParams(piece_words=77, block_seeds=700))
    assert {r[:2]: r[2] for r in whole} == {(-1 if i is None else i, k): v for (i, k), v in overlaps_by_hand(rows, items).items()}


MANY_HITS = """
import random, sys
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.driver.host", "127.0.0.1").getOrCreate())
from rampart.llm import decontaminate
rng = random.Random(3)
word = lambda: "".join(rng.choice("aeinorst") for _ in range(7))
passage = [word() for _ in range(40)]
text = []
for _ in range(20):
    text += [word() for _ in range(960)] + passage
docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:960]))], "doc_id long, text string")
bench = spark.createDataFrame([(i, " ".join(passage + [f"tail{{i}}"])) for i in range(40)], "item_id long, text string")
got = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).drop("key").collect())
assert got == [(1, i, 40, 19_960, 0, 40, 40) for i in range(40)], got
print("whole", flush=True)
import os
os._exit(0)
"""


def test_many_hits_in_a_long_text_need_little_memory(tmp_path):
    """20 copies of a passage that 40 items hold: 74,400 hits, each of which held the document's 20,000 words."""
    import subprocess
    import sys
    from pathlib import Path

    tests = Path(__file__).resolve().parent
    script = tmp_path / "many_hits.py"
    script.write_text(MANY_HITS.format(repo=str(tests.parents[1]), tests=str(tests)))
    run = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert run.stdout.split()[-1:] == ["whole"], run.stderr[-3000:]
