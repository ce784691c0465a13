"""Files read in ranges, wide JSON lines, many headers, large trees: cost grows with the input, results are whole."""

import gzip
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from rampart.operators.engines import flatten_json
from rampart.operators.integrity import merkle_roots
from rampart.sources.lines import read_log_lines
from rampart.sources.zeek import parse_zeek_tsv

MARK = b"\xef\xbb\xbf"


def test_byte_exact_lines_are_read_in_ranges(spark, tmp_path):
    lines = [b"%d \xff\xfe %s" % (i, b"x" * (i % 90)) for i in range(20_000)]
    files = {"marked.log": MARK + b"\n".join(lines), "plain.log": b"\r\n".join(lines) + b"\n", "only.log": MARK + b"one", "marked_lines.log": MARK + MARK + b"a\n" + MARK + b"b\n", "empty.log": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = read_log_lines(spark, str(tmp_path), byte_exact=True)
        assert df.select("block_start").distinct().count() > 5
        got = {}
        for r in df.collect():
            got.setdefault(r["source_id"], []).append(bytes(r["raw"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {name: [x.removesuffix(b"\r") for x in data.split(b"\n") if x.strip()] for name, data in files.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_files_whose_bytes_do_not_add_up_are_refused(spark, tmp_path):
    (tmp_path / "a.log.gz").write_bytes(gzip.compress(b"some text\n" * 50))
    with pytest.raises(Exception, match="do not add up"):
        read_log_lines(spark, str(tmp_path), byte_exact=True).collect()
    assert read_log_lines(spark, str(tmp_path)).count() == 50


def test_wide_json_lines_take_linear_time(spark):
    def seconds(n):
        text = json.dumps({"items": [{"a": i, "b": {"c": "[{"}} for i in range(n)]})
        df = spark.createDataFrame([(text,)] * 2, "line string").select(flatten_json(F.col("line")).alias("f"))
        began = time.time()
        row = df.select(F.size("f").alias("n"), F.try_element_at("f", F.lit(f"items.{n - 1}.b.c")).try_cast("string").alias("last")).collect()[0]
        assert row["n"] == 2 * n and row["last"] == "[{"
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 5 * max(seconds(4_000), 0.5)


def test_streams_of_many_headers(spark):
    rows, want = [], []
    for s in range(3):
        n = 0
        for h in range(400):
            names = [f"f{h}", "x"]
            rows.append((f"s{s}", n, "#fields\t" + "\t".join(names)))
            rows.append((f"s{s}", n + 1, "#types\tstring\tstring"))
            n += 2
            for i in range(h % 4):
                rows.append((f"s{s}", n, f"v{h}\t{i}"))
                want.append((f"s{s}", n, {f"f{h}": f"v{h}", "x": str(i)}))
                n += 1
    rows.append(("bare", 0, "no\theader"))
    df = spark.createDataFrame(rows, "file string, n int, line string").repartition(7)
    got = parse_zeek_tsv(df, ["file"], ["n"]).collect()
    assert sorted((r["file"], r["n"], r["fields"]) for r in got if r["file"] != "bare") == sorted(want)
    assert [r["parse_error"] for r in got if r["file"] == "bare"] == ["no #fields header seen"]


def test_trees_of_all_sizes(spark):
    def root(leaves):
        while len(leaves) > 1:
            leaves = [hashlib.sha256(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).digest() for i in range(0, len(leaves), 2)]
        return leaves[0].hex()

    sizes = [1, 2, 3, 5, 8, 13, 64, 65, 1000, 4097]
    rows = [(n, i, hashlib.sha256(f"{n}/{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "batch int, i int, raw_hash string").repartition(5)
    got = {r["batch"]: (r["root"], r["leaf_count"]) for r in merkle_roots(df, ["batch"], ["i"]).collect()}
    assert got == {n: (root([bytes.fromhex(h) for b, _, h in rows if b == n]), n) for n in sizes}
