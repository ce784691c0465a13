"""One registered query per operator, each over its whole table, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from . import alignment, bpe, dart_minhash, decontaminate, fill_in_middle, licenses, main_text, quality, secret_scan, suffix_dedup, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The rules of op2.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@query
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op3_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id of every document: the least doc_id of its class of near copies."""
    return dart_minhash.classes(table(spark, folder, "documents"))


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: token count, digests of ids and of decoded bytes."""
    both = bpe.round_trip(table(spark, folder, "documents"), bpe.load_ranks(vocabulary()), public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License passages of every document."""
    return licenses.scan(table(spark, folder, "documents"))


SQL["op5_licenses"] = licenses.oracle_sql()


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by token count, with suffix sums."""
    encoded = bpe.encode(table(spark, folder, "documents"), bpe.load_ranks(vocabulary()), public_tokenizers.PATTERN)
    return token_counts.histogram(encoded.select("n_tokens"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.references(docs))


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets of every document."""
    docs = table(spark, folder, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.model(docs)))


@query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The best overlap of every leaking document with each benchmark item."""
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived, read back and indexed. Pages have no capture time: second page_id of 2020 stands for it."""
    pages = table(spark, folder, "pages")
    index = warc.archive(pages, ts=F.coalesce("page_id", F.lit(0)) + 1_577_836_800)
    return index.select(F.when(F.col("record") != "", F.col("record")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "ts")


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers, for every document."""
    byte_bpe, pieces = (Path(public_tokenizers.path(f)).read_bytes() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.measures(table(spark, folder, "documents"), byte_bpe, pieces)


@query
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that start earlier in the corpus."""
    found = suffix_dedup.deduplicate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and rebuilt."""
    made = fill_in_middle.transform(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"))


SQL["op13_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS k2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS k3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS k4 FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:least(k1, k2)], '') AS prefix, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle, array_to_string(units[greatest(k1, k2) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k3 >= 90 THEN 'plain' WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
