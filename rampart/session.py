"""Session settings the library relies on, and the two runtime helpers that
need the session: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

REQUIRED_CONF = {
    # every stored time is UTC epoch nanoseconds; text timestamps resolve in UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a log line keeps its last value
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # partition directories are strings (date=2024-01-01 stays text)
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # event fields differ per source, so wide CASE projections are normal here;
    # they fall back to split projections instead of one huge method
    "spark.sql.codegen.hugeMethodLimit": "65535",
}

# A reference table (zones, indicators, ledger heads) is broadcast only when a
# count proves that it has at most this many rows.
BROADCAST_ROWS = 200_000
# Lines that one task parses.
ROWS_PER_TASK = 100_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to ``spark`` and return it."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    try:  # call-site capture doubles the time to build wide plans
        spark.conf.set("spark.python.sql.dataFrameDebugging.enabled", "false")
    except Exception:
        pass
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for data between jobs; a local session without one uses a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="rampart-ckpt-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the interpreter ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            pass

    atexit.register(delete)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt evenly (or by ``keys``) over tasks of about ``rows`` rows, over all cores at least. The splits of a file do not tell how
    its rows lie in them (a row group is read by one task), so the rows are counted, which Parquet answers
    from its footers; the number of tasks is given, so small partitions are not joined again. Meant ahead of
    parsing, which costs far more than moving the lines."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else unchanged
    (a shuffled join with adaptive skew handling takes over)."""
    return F.broadcast(df) if at_most(df, rows) else df
