"""A bucket of any size gives the templates of one pass over its lines."""

import random

from rampart.operators.templates import SIMILARITY, WILD, cluster_lines


def one_pass(lines):
    templates, member = [], []
    for text in lines:
        tokens, best, best_key = text.split(" "), -1, (-1, -1)
        for i, t in enumerate(templates):
            key = (sum(a == b != WILD for a, b in zip(t, tokens)) / len(tokens), sum(a == WILD for a in t))
            if key[0] >= SIMILARITY and key > best_key:
                best, best_key = i, key
        if best < 0:
            templates.append(tokens)
            best = len(templates) - 1
        else:
            templates[best] = [a if a == b else WILD for a, b in zip(templates[best], tokens)]
        member.append(best)
    return {x: " ".join(templates[m]) for x, m in zip(lines, member)}


def test_a_bucket_of_many_lines_against_one_pass(spark):
    rng = random.Random(1)
    kinds = [[f"k{i}w{j}" for j in range(7)] for i in range(30)]
    lines = set()
    while len(lines) < 11_000:
        k = rng.choice(kinds)
        lines.add(" ".join([w if rng.random() < 0.75 else rng.choice(rng.choice(kinds)) for w in k]))
    lines = sorted(lines)
    rng.shuffle(lines)
    rows = [("big", x, i) for i, x in enumerate(lines)] + [("small", x, i) for i, x in enumerate(lines[:200])]
    got = {(r["bucket"], r["text"]): r["template"] for r in cluster_lines(spark.createDataFrame(rows, "bucket string, text string, first_ns long")).collect()}
    assert got == {("big", x): t for x, t in one_pass(lines).items()} | {("small", x): t for x, t in one_pass(lines[:200]).items()}
