"""Uniting frames with drifting schemas and compacting silver partitions."""

from __future__ import annotations

import logging
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_log = logging.getLogger(__name__)

TARGET_BYTES = 128 * 1024 * 1024
_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}


def _wider(kinds: set[str]) -> str | None:
    """The widest of several numeric types; None when the types do not mix."""
    if len(kinds) == 1:
        return next(iter(kinds))
    return max(kinds, key=_RANK.get) if kinds <= set(_RANK) else None


def _kinds(dfs: list[DataFrame]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for df in dfs:
        for name, kind in df.dtypes:
            if kind != "void":
                out.setdefault(name, set()).add(kind)
    return out


def reconcile_types(dfs: list[DataFrame], quote_text: bool = True) -> list[DataFrame]:
    """Numbers are widened; a column whose types conflict becomes JSON text in every frame
    (plain text where ``quote_text`` is off)."""
    kinds = _kinds(dfs)

    def fix(df: DataFrame) -> DataFrame:
        columns = []
        for f in df.schema.fields:
            ref, wanted = F.col(f"`{f.name}`"), _wider(kinds.get(f.name, {"string"}))
            if wanted is not None:
                columns.append(ref.cast(wanted).alias(f.name))
            elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                columns.append(F.to_json(ref).alias(f.name))
            elif isinstance(f.dataType, T.StringType) and quote_text:
                quoted = F.to_json(F.array(ref))
                columns.append(F.when(ref.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).alias(f.name))
            else:
                columns.append(ref.cast("string").alias(f.name))
        return df.select(*columns)

    return [fix(df) for df in dfs]


def union_frames(dfs: list[DataFrame], quote_text: bool = True) -> DataFrame:
    """All rows of all frames, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reconcile_types(dfs, quote_text))


@dataclass
class CompactionResult:
    date: str
    source_type: str
    files_before: int
    files_after: int
    rows: int
    bytes_before: int
    bytes_after: int
    compacted: bool

    def to_dict(self) -> dict:
        return asdict(self)


def folder(spark: SparkSession, path: str):
    """A path and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that replaces one of its name as a whole."""
    part, fs = folder(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    stream.write(text.encode())
    stream.close()
    target, _ = folder(spark, path)
    if not fs.rename(part, target):
        fs.delete(target, False)
        if not fs.rename(part, target) and not fs.exists(target):
            raise OSError(f"{path} was not written")


def get_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; none if there is no such file."""
    at, fs = folder(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def data_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Parquet files under a folder with their sizes."""
    path, fs = folder(spark, root)
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        if name.endswith(".parquet") and "/." not in name:
            out.append((name, status.getLen()))
    return sorted(out)


def load_files(spark: SparkSession, files: list[str], base: str | None = None) -> DataFrame:
    """All files as one frame; files whose schemas conflict are read by schema and reconciled.

    ``base`` is the table folder whose partition columns are wanted.
    """
    reader = lambda: spark.read.option("basePath", base) if base is not None else spark.read
    try:
        return reader().option("mergeSchema", True).parquet(*files)
    except (PySparkException, Py4JJavaError) as exc:
        if "CANNOT_MERGE" not in str(exc):
            raise
        groups: dict[str, list[str]] = {}
        for f in files:
            groups.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
        return union_frames([reader().parquet(*g) for g in groups.values()], quote_text=base is None)


def compact(spark: SparkSession, path: str, date: str, source_type: str, target_bytes: int = TARGET_BYTES, min_files: int = 2) -> CompactionResult:
    """Rewrite one partition as files of about ``target_bytes``; nothing is removed before the new
    files are complete. Fewer than ``min_files`` files are left as they are."""
    place = f"{path}/date={date}/source_type={source_type}"
    files = data_files(spark, place)
    size = sum(n for _, n in files)
    if len(files) < max(min_files, 1):
        rows = spark.read.parquet(*[f for f, _ in files]).count() if files else 0
        return CompactionResult(date, source_type, len(files), len(files), rows, size, size, False)
    df = load_files(spark, [f for f, _ in files])
    run = f"compact-{uuid.uuid4().hex}"
    staging = f"{path}/_staging/{run}"  # names with an underscore are invisible to readers
    df.repartition(max(1, -(-size // max(target_bytes, 1)))).write.option("compression", "zstd").parquet(staging)
    written = spark.read.parquet(staging)
    rows = written.count()
    source, fs = folder(spark, staging)
    target, _ = folder(spark, f"{place}/run={run}")
    if not fs.rename(source, target):
        raise OSError(f"could not move {staging} into place")
    for name, _n in files:
        old, _ = folder(spark, name)
        fs.delete(old, False)
    after = data_files(spark, f"{place}/run={run}")
    return CompactionResult(date, source_type, len(files), len(after), rows, size, sum(n for _, n in after), True)


def partitions(spark: SparkSession, path: str, date: str | None = None) -> list[tuple[str, str]]:
    """Every (date, source_type) partition, from the folder names."""
    root, fs = folder(spark, path)
    out = []
    for day in fs.listStatus(root) if fs.exists(root) else []:
        name = day.getPath().getName()
        if name.startswith("date=") and date in (None, name[5:]):
            out += [(name[5:], s.getPath().getName()[12:]) for s in fs.listStatus(day.getPath()) if s.getPath().getName().startswith("source_type=")]
    return sorted(out)


def compact_all(spark: SparkSession, path: str, date: str | None = None, **options) -> list[CompactionResult]:
    """Compact every partition; one that fails is logged and the others are still done."""
    results = []
    for day, source in partitions(spark, path, date):
        try:
            results.append(compact(spark, path, day, source, **options))
        except Exception:
            _log.exception("partition %s/%s stays as it is", day, source)
    return results
