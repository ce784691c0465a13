"""Lake tables: bronze, silver, dead letters, resolutions, anomalies.

Each write belongs to a ``run``; a repeated run replaces exactly its own files
(dynamic partition overwrite), so a retried job or micro-batch never doubles rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rampart import schemas
from rampart.functions.times import event_date
from rampart.session import broadcast_if_small
from rampart.sources.lines import uid_date
from rampart.sources.merging import data_files, folder, get_text, load_files, put_text


def slug(c: Column) -> Column:
    """A partition value safe in file names."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), F.lit("")), F.lit("unknown"))


def _write(df: DataFrame, path: str, keys: list[str], fmt: str, run: str | None, **options) -> None:
    """Rebalance by partition key (adaptive execution splits hot keys), then write the run's files."""
    keys = [*keys, "run"]
    out = df.withColumn("run", F.lit(run or uuid.uuid4().hex)).hint("rebalance", *keys)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(*keys).format(fmt).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _read(spark: SparkSession, path: str, fmt: str, schema: str, keys: str = "date string, run string", **options) -> DataFrame:
    full = f"{schema}, {keys}"
    if not _exists(spark, path):
        return spark.createDataFrame([], full).drop("run")
    return spark.read.options(**options).schema(full).format(fmt).load(path).drop("run")


def _day(ns: str) -> Column:
    return event_date(F.col(ns))


# -- bronze ------------------------------------------------------------------------------


def write_bronze(df: DataFrame, path: str, fmt: str = "parquet", run: str | None = None) -> None:
    """Append raw events by ingest date, as Parquet (with Bloom filters of the ids) or as gzipped JSON lines with base64 bytes."""
    out = df.withColumn("date", _day("ingest_time_ns"))
    if fmt == "json":
        out = out.withColumn("raw", F.regexp_replace(F.base64("raw"), "[\r\n]", ""))
        _write(out, path, ["date"], "json", run, compression="gzip", ignoreNullFields="false")
    else:
        bloom = {"parquet.bloom.filter.enabled#event_uid": "true", "parquet.bloom.filter.adaptive.enabled#event_uid": "true"}
        _write(out, path, ["date"], "parquet", run, compression="zstd", **bloom)


def read_bronze(spark: SparkSession, path: str, date: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Raw events, all or those of one ingest date (partition filter)."""
    schema = schemas.RAW.replace("raw binary", "raw string") if fmt == "json" else schemas.RAW
    df = _read(spark, path, fmt, schema)
    df = df.filter(F.col("date") == date) if date is not None else df
    return df.withColumn("raw", F.unbase64("raw")) if fmt == "json" else df


def _partitions(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the partition column ``key`` directly below ``path``."""
    root, fs = folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n[len(key) + 1:] for n in names if n.startswith(f"{key}="))


def mark_landed(spark: SparkSession, path: str, run: str) -> list[str]:
    """Note that the run's bronze files are complete, with their dates; called once all of them are written."""
    dates = []
    for date in _partitions(spark, path, "date"):
        at, fs = folder(spark, f"{path}/date={date}/run={run}")
        if fs.exists(at):
            dates.append(date)
    put_text(spark, f"{path}/_runs/{run}.json", json.dumps(dates))
    return dates


def landed_dates(spark: SparkSession, path: str, run: str) -> list[str] | None:
    """The dates of a run whose bronze files are complete; none if they are not."""
    text = get_text(spark, f"{path}/_runs/{run}.json")
    return None if text is None else json.loads(text)


def read_bronze_run(spark: SparkSession, path: str, run: str, dates: list[str]) -> DataFrame:
    """The raw events of one run, from its own folders."""
    if not dates:
        return spark.createDataFrame([], f"{schemas.RAW}, date string")
    files = [f"{path}/date={date}/run={run}" for date in dates]
    return spark.read.option("basePath", path).schema(f"{schemas.RAW}, date string, run string").parquet(*files).drop("run")


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches kept below ``path``."""
    return sorted(map(int, _partitions(spark, path, "batch")))


def drop_batches(spark: SparkSession, path: str, batches: list[int]) -> None:
    for n in batches:
        at, fs = folder(spark, f"{path}/batch={n}")
        fs.delete(at, True)


def read_bronze_located(spark: SparkSession, path: str, date: str | None = None, fmt: str = "json") -> DataFrame:
    """Raw events with ``locator`` = ``<partition>/<file>#L<n>``.

    Rows are numbered per file split and the counts of earlier splits are added, so a large
    file is numbered by many tasks.
    """
    schema = schemas.RAW.replace("raw binary", "raw string") if fmt == "json" else schemas.RAW
    df = spark.read.schema(f"{schema}, date string, run string").format(fmt).load(path)
    df = df.filter(F.col("date") == date) if date is not None else df
    df = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    parts = df.groupBy("_f", "_b").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = df.join(broadcast_if_small(offsets), ["_f", "_b"])
    place = F.regexp_extract("_f", r"(date=[^/]+/(?:run=[^/]+/)?[^/]+)\z", 1)
    out = out.withColumn("locator", F.concat(place, F.lit("#L"), F.col("_before") + F.col("_id") - F.col("_first") + 1))
    out = out.withColumn("raw", F.unbase64("raw")) if fmt == "json" else out
    return out.drop("_f", "_b", "_id", "_first", "_before", "run")


def around(date: str) -> list[str]:
    """A date with its neighbours: an id minted at midnight may be stored on the next day."""
    day = dt.date.fromisoformat(date)
    return [str(day + dt.timedelta(days=n)) for n in (-1, 0, 1)]


def bronze_on(df: DataFrame, dates: list[str] | None) -> DataFrame:
    """The partitions of bronze around ``dates``; all of them for none."""
    if dates is None:
        return df
    return df.filter(F.col("date").isin(sorted({d for date in dates for d in around(date)})))


def uid_dates(df: DataFrame) -> list[str] | None:
    """The dates in the ids of ``df``, one per day to the driver; none where an id has no date in it."""
    dates = [r[0] for r in df.select(uid_date(F.col("event_uid")).alias("d")).distinct().collect()]
    return None if None in dates else dates


def bronze_by_uid(df: DataFrame, uid: str) -> DataFrame:
    """The raw event of an id. The id names its day, so only that partition and its neighbours are read,
    and of their files those whose Bloom filters hold the id; ids in another layout are sought in all."""
    date = df.sparkSession.range(1).select(uid_date(F.lit(uid))).first()[0]
    return bronze_on(df, None if date is None or "date" not in df.columns else [date]).filter(F.col("event_uid") == uid)


# -- silver -----------------------------------------------------------------------------------


#: Types of one class are read as the widest of them; Parquet's reader widens inside a class.
_CLASSES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}


def _kind(simple: str) -> str:
    return _CLASSES.get(simple, simple)


def _stored_kinds(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Stored columns and the classes of type they were written with, from the notes beside the table (one per schema ever written)."""
    root, fs = folder(spark, f"{path}/_schema")
    kinds: dict[str, set[str]] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        note = status.getPath().toString()
        for name, kind in json.loads(get_text(spark, note) or "{}").items() if note.endswith(".json") else ():
            kinds.setdefault(name, set()).add(kind)
    return kinds


def _typed_name(name: str, kind: str) -> str:
    """The stored name of a column whose type is not the one that others of this name have."""
    return f"{name}@@{kind if kind.isalnum() else hashlib.sha256(kind.encode()).hexdigest()[:8]}"


def write_silver(df: DataFrame, path: str, run: str | None = None) -> None:
    """Silver rows as ZSTD Parquet by event date (ingest date for events without a time) and source type.

    The columns and their types are noted beside the table before the rows are written, one note per schema, so
    readers need no footers. A column whose type is of another class than the stored one goes under a name of its own.
    """
    ingest = F.col("ingest_time_ns") if "ingest_time_ns" in df.columns else None
    out = df.withColumns({"date": event_date(F.col("time"), ingest), "source_type": slug(F.col("source_type"))}).drop("ingest_time_ns")
    stored, columns, note = _stored_kinds(df.sparkSession, path), [], {}
    declared = schemas.SILVER
    for name, simple in out.dtypes:
        if name in ("date", "source_type"):
            columns.append(F.col(name))
            continue
        kind = _kind(simple)
        first = _kind(declared[name]) if name in declared else min(stored.get(name, {kind}))
        as_named = name if kind == first else _typed_name(name, kind)
        note[as_named] = kind
        columns.append(F.col(f"`{name}`").alias(as_named))
    text = json.dumps(note, sort_keys=True)
    put_text(df.sparkSession, f"{path}/_schema/{hashlib.sha256(text.encode()).hexdigest()[:16]}.json", text)
    _write(out.select(*columns), path, ["date", "source_type"], "parquet", run, compression="zstd")


def _united(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns stored under several types as one: numbers as doubles, others as JSON text, as compaction leaves them."""
    groups: dict[str, list[str]] = {}
    for stored in df.columns:
        groups.setdefault(stored.rsplit("@@", 1)[0] if stored in kinds else stored, []).append(stored)
    columns = []
    for name, parts in groups.items():
        refs = [F.col(f"`{p}`") for p in parts]
        if len(parts) == 1:
            columns.append(refs[0].alias(name))
        elif all(kinds.get(p) in ("bigint", "double") for p in parts):
            columns.append(F.coalesce(*[r.cast("double") for r in refs]).alias(name))
        else:
            as_text = [F.when(r.isNotNull(), F.regexp_replace(F.to_json(F.array(r)), r"(?s)^\[(.*)\]\z", "$1")) for r in refs]
            columns.append(F.coalesce(*as_text).alias(name))
    return df.select(*columns)


def read_silver(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Silver rows, columns united by name, ``date`` as text; a typed empty frame when there is no data.

    The schema comes from the notes of the writers; no file is opened for it. Tables that were written without notes are
    read by their footers. ``columns`` declares further columns.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.ddl(schemas.SILVER))
    stored = _stored_kinds(spark, path)
    if not stored and columns is None:
        files = [name for name, _ in data_files(spark, path)]
        return load_files(spark, files, path).drop("run") if files else spark.createDataFrame([], schemas.ddl(schemas.SILVER))
    clash = sorted(name for name, kinds in stored.items() if len(kinds) > 1)
    if clash:  # two first writers at once
        return load_files(spark, [name for name, _ in data_files(spark, path)], path).drop("run")
    kinds = {name: next(iter(found)) for name, found in stored.items()}
    declared = {**kinds, **{n: t for n, t in schemas.SILVER.items() if n in kinds or n in ("date", "source_type") or columns is not None}, **(columns or {}), "run": "string"}
    return _united(spark.read.schema(schemas.ddl(declared)).parquet(path).drop("run"), kinds)


# -- dead letters ---------------------------------------------------------------------------------


def write_dead_letters(df: DataFrame, path: str, run: str | None = None) -> None:
    out = df.withColumns({"date": _day("ts_ns"), "raw": F.regexp_replace(F.base64("raw"), "[\r\n]", "")})
    _write(out, path, ["date"], "json", run)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Dead letters with their bytes; ``detail`` stays JSON text (``parse_json`` gives a variant)."""
    return _read(spark, path, "json", schemas.DEAD_LETTER).withColumn("raw", F.unbase64("raw"))


def write_resolutions(df: DataFrame, path: str, run: str | None = None) -> None:
    _write(df.withColumn("date", _day("resolved_ts_ns")), path, ["date"], "json", run)


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "json", schemas.RESOLUTION)


# -- anomalies ---------------------------------------------------------------------------------------


def write_anomalies(df: DataFrame, path: str, run: str | None = None) -> None:
    """Scored events by event date; events without a time are left out."""
    kept = df.filter(F.col("event_time_ns").isNotNull()).withColumn("date", _day("event_time_ns"))
    _write(kept, path, ["date"], "parquet", run)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "parquet", schemas.ANOMALY)
