"""What the operators share: free column names, text keys, tables in the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128-bit key of a text: equal texts have equal keys; null for null."""
    return F.unhex(F.md5(text))


def quoted(df: DataFrame, name: str) -> Column:
    """The column of that very name, also where the name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def quoted_name(name: str) -> Column:
    """The same, of whichever frame it is used with."""
    return F.col("`" + name.replace("`", "``") + "`")


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="rampart-shared-")  # one machine: tests
    return f"file://{_own}"


_own: str | None = None

#: Spark's setting that ends the shuffle files of a query with it.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shared:
    """Tables written below the shared folder to cut lineage; a lost executor costs no recomputation of them.

    ``save`` writes and rereads one; ``drop`` deletes one that no later frame reads. What is left is
    deleted when the interpreter ends. With ``tidy`` the shuffle files of a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, "true" if self.tidy else before)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            pass


def per_worker(slot: str, name: str, build: Callable[[], object]) -> object:
    """The object ``name`` of this Python worker, built once and kept between its tasks; a slot holds one object at a time."""
    held = vars(sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")))
    if held.get(slot, (None, None))[0] != name:
        held.pop(slot, None)
        held[slot] = (name, build())
    return held[slot][1]


def broadcast_if_bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of rows of fixed width) with a broadcast hint if a count proves at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_sizes(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of these sizes of about ``most`` in all, a larger row alone: bounds what is held at a time."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def by_chars(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """The same by the characters of ``texts``."""
    return by_sizes([len(text or "") for text in texts], most)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand tasks batches of ``rows`` rows, unless the session sets its own number: texts are wide, and a batch exists on both sides at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, "10000") == "10000":
        spark.conf.set(setting, str(rows))


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in parts, for what is made of its rows to be held a part at a time; then the memory that is free goes back."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
