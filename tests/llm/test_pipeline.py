import struct

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from rampart.llm import bpe, dart_minhash, quality, queries, secret_scan
from test_copies import overlaps_by_hand
from test_texts import judged_by_hand

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_against_the_stages_by_hand(spark):
    db = duckdb.connect()
    docs = db.execute(f"select doc_id, text, lang from '{FOLDER}/documents.parquet'").fetchall()
    items = db.execute(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    kept = judged_by_hand(docs)
    rows = [(i, t) for i, t, _ in docs if kept[i]]
    copies = []
    for i, t in sorted(rows):
        near = [c for c in copies if t == c[1] or (min(len(t), len(c[1])) > 0.6 * max(len(t), len(c[1])) and dart_minhash.weighted_jaccard(t, c[1], 5) >= 0.8)]
        if not near:
            copies.append((i, t))
    leaks = {i for i, _ in overlaps_by_hand(copies, items)}
    clean = [(i, t) for i, t in copies if i not in leaks]
    frame = spark.createDataFrame(clean, "doc_id long, text string")
    redacted = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame, secret_scan.model(frame)).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.vocabulary()), special_tokens={})
    got = {r["doc_id"]: (r["text"], bytes(r["ids"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(redacted)
    for i, text in redacted.items():
        ids = library.encode_ordinary(text)
        assert got[i] == (text, struct.pack(f"<{len(ids)}I", *ids), len(ids))


def test_stages_keep_the_columns_and_take_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 as kept", "2 as `key`", "3 as rp_text_key", "4 as repeated")
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, FOLDER).columns == docs.columns and stage(spark, empty, FOLDER).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
