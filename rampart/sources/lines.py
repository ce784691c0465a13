"""Raw log lines and intake payloads as event tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rampart.functions.text import strip
from rampart.functions.times import floor_div
from rampart.session import broadcast_if_small

MARK = b"\xef\xbb\xbf"


def _lines(df: DataFrame) -> DataFrame:
    """One trailing CR cut, blank lines dropped."""
    raw = F.regexp_replace(F.col("value").cast("string"), "\r\\z", "")
    return df.withColumn("raw", F.when(F.col("value").endswith("\r"), F.substring(F.col("value").cast("binary"), F.lit(1), F.octet_length("value") - 1)).otherwise(F.col("value").cast("binary"))).filter(
        strip(raw) != "").drop("value")


def _restore_marks(df: DataFrame) -> DataFrame:
    """``df`` with the byte-order marks that the text reader drops at the start of files.

    Every byte of a file is a line's, a newline, or the mark, so the sum of the lines tells whether there was one; a
    last line without a newline counts one byte too many. Works on splits of any size, in any store.
    """
    files = df.groupBy("file_path").agg(F.max("file_size").alias("size"), F.sum(F.octet_length("value") + 1).alias("read"), F.min(F.struct("block_start", "row_id")).alias("first"))
    left = F.col("size") - F.col("read")
    unknown = F.raise_error(F.concat(F.lit("not a plain file of lines, its bytes do not add up: "), F.col("file_path")))
    marked = F.when(left.isin(0, -1), False).when(left.isin(3, 2), True).otherwise(unknown.cast("boolean"))
    first = files.filter(marked).select(F.col("file_path").alias("_file"), F.col("first.row_id").alias("_row"))
    joined = df.join(broadcast_if_small(first), (F.col("file_path") == F.col("_file")) & (F.col("row_id") == F.col("_row")), "left")
    value = F.when(F.col("_row").isNotNull(), F.concat(F.lit(MARK), F.col("value").cast("binary")).cast("string")).otherwise(F.col("value"))
    return joined.withColumn("value", value).drop("_file", "_row")


def read_log_lines(spark: SparkSession, path: str, byte_exact: bool = False) -> DataFrame:
    """``raw, source_id, file_path, block_start, row_id`` of every non-blank line; large files are read in ranges by many tasks.

    The text reader drops a byte-order mark at the start of a file; ``byte_exact`` reads plain (not compressed) files
    and keeps it. A file of nothing but the mark has no line.
    """
    df = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_name").alias("source_id"), F.col("_metadata.file_path").alias("file_path"),
                                                     F.col("_metadata.file_block_start").alias("block_start"), F.col("_metadata.file_size").alias("file_size"),
                                                     F.monotonically_increasing_id().alias("row_id"))
    return _lines(_restore_marks(df) if byte_exact else df).select("source_id", "file_path", "block_start", "row_id", "raw")


def stream_log_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream of lines; the checkpoint of the query resumes it.

    Row ids are added per micro-batch (``run_stream``): a stream has no row numbers of its own.
    """
    reader = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files)
    df = reader.text(folder).select("value", F.col("_metadata.file_name").alias("source_id"), F.col("_metadata.file_path").alias("file_path"),
                                    F.col("_metadata.file_block_start").alias("block_start"))
    return _lines(df)


def event_uid(ingest_ns: Column, *origin: Column) -> Column:
    """A time-ordered id in UUID version 7 layout: ingest milliseconds, then a hash of the origin."""
    ms = F.lpad(F.lower(F.hex(floor_div(ingest_ns, 1_000_000))), 12, "0")
    digest = F.sha2(F.concat_ws("\n", *[F.coalesce(o.cast("string"), F.lit("")) for o in origin]), 256)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), part(1, 3), F.lit("-8"), part(4, 3), F.lit("-"), part(7, 12))


def uid_date(uid: Column) -> Column:
    """The UTC date an id of :func:`event_uid` was minted on; null for ids in another layout."""
    text = F.lower(uid)
    ms = F.conv(F.concat(F.substring(text, 1, 8), F.substring(text, 10, 4)), 16, 10).cast("bigint")
    return F.when(text.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))


def to_raw_events(df: DataFrame, source_id: str | None = None, transport: str = "file", ingest_time_ns: int | None = None) -> DataFrame:
    """Admit raw bytes: id, SHA-256 over the untouched bytes, length and ingest time.

    The id is derived from the row's origin (file, position) and content, so a retried task mints the same id.
    """
    now = F.lit(ingest_time_ns).cast("bigint") if ingest_time_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    source = F.lit(source_id) if source_id is not None else F.col("source_id")
    origin = [F.col(c) for c in ("file_path", "block_start", "row_id") if c in df.columns]
    peer = F.col("peer") if "peer" in df.columns else F.lit(None).cast("string")
    hashed = df.withColumns({"raw_hash": F.sha2("raw", 256), "ingest_time_ns": now})
    uid = event_uid(F.col("ingest_time_ns"), source, *origin, F.col("raw_hash"))
    return hashed.select(uid.alias("event_uid"), "raw", "raw_hash", F.octet_length("raw").alias("raw_len"), "ingest_time_ns",
                         source.alias("source_id"), F.lit(transport).alias("transport"), peer.alias("peer"))


def _hec(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Objects of concatenated collector payloads; a malformed payload gives one error row."""
    decoder = json.JSONDecoder()
    for pdf in batches:
        out = []
        for payload_id, body in zip(pdf["payload_id"], pdf["body"]):
            text, at, found, error = (body or "").strip(), 0, [], None
            while at < len(text) and error is None:
                try:
                    obj, end = decoder.raw_decode(text, at)
                    if not isinstance(obj, dict) or "event" not in obj:
                        raise ValueError("each record must be an object with an 'event'")
                except ValueError as exc:
                    error = str(exc)
                    break
                event = obj["event"]
                raw = event if isinstance(event, str) else json.dumps(event, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
                found.append((payload_id, len(found), raw, obj.get("sourcetype") and str(obj["sourcetype"]), None))
                at = end + len(text[end:]) - len(text[end:].lstrip())
            out += found if error is None else [(payload_id, 0, None, None, error)]
        yield pd.DataFrame(out, columns=["payload_id", "position", "raw", "sourcetype", "error"])


def explode_payloads(df: DataFrame, kind: str, body: str = "body", payload_id: str = "payload_id") -> DataFrame:
    """``payload_id, position, raw, sourcetype, error`` of ``text``, ``json`` or ``hec`` payloads.

    A malformed payload is refused as a whole: it yields one row with ``error`` and no raw text.
    JSON list items and collector events that are not text become compact JSON with sorted keys.
    """
    df = df.select(F.col(payload_id).alias("payload_id"), F.col(body).cast("string").alias("body"))
    none = F.lit(None).cast("string")
    lines = F.filter(F.transform(F.split("body", "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", "")), lambda x: strip(x) != "")
    if kind == "text":
        return df.select("payload_id", F.posexplode(lines).alias("position", "raw"), none.alias("sourcetype"), none.alias("error"))
    if kind == "json":
        is_list = F.ltrim("body").startswith("[")
        items = F.try_parse_json("body").try_cast("array<variant>")
        bad = F.when(is_list, items.isNull()).otherwise(F.exists(lines, lambda x: F.try_parse_json(x).isNull()))
        values = F.when(is_list, F.transform(items, lambda v: F.to_json(v))).otherwise(lines)
        pick = F.when(bad, F.array(none)).otherwise(values)
        return df.select("payload_id", F.posexplode(pick).alias("position", "raw"), none.alias("sourcetype"), F.when(bad, "invalid JSON").alias("error"))
    if kind == "hec":
        return df.mapInPandas(_hec, f"payload_id {dict(df.dtypes)['payload_id']}, position int, raw string, sourcetype string, error string")
    raise ValueError(f"unknown payload kind {kind!r}")
