"""WARC archives and their index.

Captures are written as WARC files; a payload that was captured before is a revisit record. Each archive gives an
index run, sorted by URL key and time. The runs are dealt into ranges of keys, and each range merges its pieces of
the runs with a tree of losers, which gives the capture histories in one global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Shared, quoted

CRLF = "\r\n"


@dataclass(frozen=True)
class ArchiveParams:
    """``file_bytes`` of payload go to an archive and ``range_rows`` captures to a range of the index, both on average: the most that a task holds is a few times that, or one record."""

    file_bytes: int = 16_000_000
    range_rows: int = 200_000


def _hash_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [base64.b32encode(hashlib.sha1((x.as_py() or "").encode("utf-8")).digest()).decode() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["id", "url", "payload", "ts", "digest"])


def captures(pages: DataFrame, shared: Shared, id_col: str = "page_id", url: str = "url", payload: str = "html", ts: Column | None = None) -> DataFrame:
    """id, url, payload, ts, digest, record_type, refers_to. A null payload is an empty one, a null url too.

    Of equal payloads the one of the largest id is the response and the others revisit it; rows that share that id
    are responses all. A null id is smaller than any other.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        quoted(pages, id_col).alias("id"), F.coalesce(quoted(pages, url).cast("string"), F.lit("")).alias("url"), F.coalesce(quoted(pages, payload).cast("string"), F.lit("")).alias("payload"),
        (ts if ts is not None else F.lit(0)).cast("long").alias("ts"))
    hashed = rows.mapInArrow(_hash_payload, f"id {kind}, url string, payload string, ts long, digest string")
    first = shared.save(hashed.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "response"), "responses")
    joined = hashed.join(first, F.col("digest") == F.col("of"), "left")
    revisit = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return joined.select("id", "url", "payload", "ts", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def _record() -> Column:
    """The WARC record of a capture without the two line ends that close it."""
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:capture:"), c.cast("string"), F.lit(">")), F.lit("<urn:capture:>"))
    date = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.0" + CRLF), F.lit("WARC-Type: "), F.col("record_type"), F.lit(CRLF), F.lit("WARC-Record-ID: "), name(F.col("id")), F.lit(CRLF),
        F.lit("WARC-Target-URI: "), clean(F.col("url")), F.lit(CRLF), F.lit("WARC-Date: "), date, F.lit(CRLF),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + CRLF))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(head, block)


def write_archives(found: DataFrame, path: str, files: int) -> None:
    """Writes ``captures`` as about ``files`` gzipped WARC files below ``path``; Spark's committer keeps a retried task from leaving records twice."""
    dealt = found.repartition(max(1, files), F.xxhash64("digest", "id", "url"))
    dealt.select(_record().alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        first = data.index(b"\r\n", at) + 2
        headers = {k.decode().strip().lower(): v.decode("utf-8") for k, v in _HEADER.findall(data[first:end + 2])}
        start, size = end + 4, int(headers["content-length"])
        yield at, headers, data[start:start + size]
        at = start + size + 4


def url_key(url: str) -> str:
    """Sort key of a URL: its host's labels from the last one on, then port and path."""
    found = re.match(r"(?s)^.*?://([^/?#]*)(.*)$", url)
    if not found:
        return url
    host, rest = found[1].lower().rpartition("@")[2], found[2]
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + rest


_INDEX = "url_key string, ts string, run string, offset long, record string, record_type string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean"
_INDEX_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
_INDEX_NAMES = [c.split(" ")[0] for c in _INDEX.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per archive its index entries, sorted."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            entries = []
            for offset, headers, block in read_records(gzip.decompress(content.as_py())):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                ok = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                refers = headers.get("warc-refers-to", "<urn:capture:>")[13:-1]
                entries.append((url_key(headers["warc-target-uri"]), headers["warc-date"], path.as_py(), offset, headers["warc-record-id"][13:-1], kind, refers or None, size, digest, ok))
            entries.sort(key=lambda e: (e[0], e[1], e[4]))
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), _INDEX_TYPES)], names=_INDEX_NAMES)


def index_runs(path: str, shared: Shared) -> DataFrame:
    """The archives read back: one sorted run of index entries per archive."""
    files = shared.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return shared.save(files.mapInArrow(_runs, _INDEX), "runs")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        self.winner = -1
        for i in range(len(self.runs)):
            self._play(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, run: int, building: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = run
                return
            if other >= 0 and self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of runs that a range holds; each piece is a stretch of rows of one run, in its order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "ts", "record"))))
    runs = table.column("run").to_pylist()
    starts = [0] + [i for i in range(1, len(runs)) if runs[i] != runs[i - 1]]
    pieces = [((keys[i], i) for i in range(a, b)) for a, b in zip(starts, starts[1:] + [len(runs)])]
    order = pa.array([i for _, i in LoserTree(pieces)], pa.int64())
    yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)


def merge_index(runs: DataFrame, params: ArchiveParams = ArchiveParams()) -> DataFrame:
    """All entries in the order of URL key, time and record, over the partitions and inside each.

    Ranges are cut by key, time and record, so a URL with very many captures spreads over several.
    """
    ranges = max(1, -(-runs.count() // params.range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "ts", "record").sortWithinPartitions("run", "url_key", "ts", "record")
    return dealt.mapInArrow(_merged, _INDEX)


def archive(pages: DataFrame, params: ArchiveParams = ArchiveParams(), id_col: str = "page_id", url: str = "url", payload: str = "html", ts: Column | None = None) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back and returns the merged index, in global order."""
    shared = Shared(pages.sparkSession, "warc")
    size = pages.agg(F.sum(F.octet_length(quoted(pages, payload).cast("string")))).first()[0] or 0
    write_archives(captures(pages, shared, id_col, url, payload, ts), f"{shared.root}/archives", -(-size // params.file_bytes))
    return merge_index(index_runs(f"{shared.root}/archives", shared), params)
