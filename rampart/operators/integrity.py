"""Evidence: content hashes, Merkle batches, the hash-chained ledger and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rampart.functions.times import event_date, floor_div
from rampart.operators.ordering import global_position
from rampart.session import broadcast_if_small, checkpoint

GENESIS = "00" * 32
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def node(left: Column, right: Column) -> Column:
    """Parent hash (hex) of two hex hashes."""
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def verify_hashes(bronze: DataFrame) -> DataFrame:
    """Add ``hash_ok``: whether the stored bytes still have their recorded hash."""
    return bronze.withColumn("hash_ok", F.sha2("raw", 256) == F.lower("raw_hash"))


def _fold(nodes: Column, levels: Column | int) -> Column:
    """Hash a list of nodes up ``levels`` levels; a lone last node is paired with itself."""

    def up(level: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        at = lambda i: F.get(level, i)
        return F.transform(pairs, lambda i: node(at(i * 2), F.coalesce(at(i * 2 + 1), at(i * 2))))

    steps = F.lit(levels) if isinstance(levels, int) else levels
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), nodes, up)).otherwise(nodes)


def _height(n: Column) -> Column:
    """Levels needed to hash ``n`` nodes to one."""
    return F.when(n > 1, F.length(F.bin((n - 1).cast("bigint")))).otherwise(F.lit(0)).cast("int")


def _parent(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def _peaks(keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds rows (batch columns, position, hash), which come in order, into the largest aligned subtrees that lie inside the task:
    height, index among the subtrees of that height, hash. Two subtrees a level at most are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        stack: list[tuple[int, int, bytes]] = []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*list(batch.schema)[:keys], ("height", pa.int32()), ("index", pa.int64()), ("hash", pa.binary())])
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(keys + 2)]
            for row in zip(*columns):
                key, index, value = row[:keys], row[keys], bytes.fromhex(row[keys + 1])
                if key != current:
                    out += [(*current, *peak) for peak in stack] if stack else []
                    current, stack = key, []
                height = 0
                while stack and index & 1 and stack[-1][:2] == (height, index - 1):
                    value = _parent(stack.pop()[2], value)
                    height, index = height + 1, index >> 1
                stack.append((height, index, value))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * (keys + 3), schema)], schema=schema)
        if stack:
            rows = zip(*[(*current, *peak) for peak in stack])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


def fold_peaks(peaks: list[tuple[int, int, bytes]], leaves: int) -> bytes:
    """The root over the peaks of all tasks; a lone last node of a level is paired with itself."""
    levels: dict[int, dict[int, bytes]] = {}
    for height, index, value in peaks:
        levels.setdefault(height, {})[index] = value
    height, size = 0, leaves
    while size > 1:
        here, up = levels.pop(height, {}), levels.setdefault(height + 1, {})
        for index in sorted(here):
            if index % 2 == 0:
                up[index // 2] = _parent(here[index], here[index + 1] if index + 1 < size else here[index])
        height, size = height + 1, (size + 1) // 2
    return levels[height][0]


def merkle_roots(df: DataFrame, batch: list[str], order: list[str], leaf: str = "raw_hash", positioned: str | None = None) -> DataFrame:
    """``batch.., root, leaf_count``: the Merkle root of each ordered batch, of whatever size.

    Leaves are shuffled once, by range; each task folds its part of a batch into aligned subtrees, a few for each level, and these
    are folded to the root. ``positioned`` names an existing 0-based position column.
    """
    if positioned is None:
        df, positioned = global_position(df.select(*batch, *dict.fromkeys([*order, leaf])), batch, order, "_pos"), "_pos"
    leaves = df.select(*batch, F.col(positioned).cast("bigint").alias("_i"), F.lower(F.col(leaf)).alias("_h"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = leaves.repartitionByRange(parts, *batch, "_i").sortWithinPartitions(*batch, "_i")
    kinds = dict(leaves.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in batch)
    peaks = ranged.mapInArrow(_peaks(len(batch)), f"{named}, height int, index bigint, hash binary")
    every = peaks.groupBy(*batch).agg(F.collect_list(F.struct("height", "index", "hash")).alias("peaks"), F.sum(F.expr("shiftleft(1L, height)")).alias("leaf_count"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [fold_peaks([(p["height"], p["index"], p["hash"]) for p in peaks], n).hex() for peaks, n in zip(rows.column(len(batch)).to_pylist(), rows.column(len(batch) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(batch)], pa.array(found, pa.string()), rows.column(len(batch) + 1)], names=[*batch, "root", "leaf_count"])

    return every.mapInArrow(finish, f"{named}, root string, leaf_count bigint")


def merkle_levels(leaves: Column) -> Column:
    """Every level of a bounded batch, leaves first, as an array of arrays."""

    def up(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.size(last) > 1, F.concat(acc, F.array(_fold(last, 1)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(_height(F.size(leaves)), F.lit(1))), F.array(leaves), up)


def merkle_proofs(df: DataFrame, batch: list[str], position: str, leaf: str = "raw_hash") -> DataFrame:
    """Add ``proof``: the sibling hashes from leaf to root with their side, for the batches of a ledger (one batch is
    held in a row, so its seal size bounds the row; there is no other limit)."""
    trees = df.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("i"), F.lower(F.col(leaf)).alias("h")))).alias("_l"))
    levels = trees.withColumn("_levels", merkle_levels(F.transform("_l", lambda x: x["h"])))

    def path(at: Column) -> Column:
        def step(level: Column, depth: Column) -> Column:
            here = F.floor(at / F.pow(F.lit(2.0), depth)).cast("int")
            even = here % 2 == 0
            sibling = F.when(even, F.coalesce(F.get(level, here + 1), F.get(level, here))).otherwise(F.get(level, here - 1))
            return F.struct(sibling.alias("sibling"), F.when(even, "right").otherwise("left").alias("side"))

        return F.transform(F.slice("_levels", F.lit(1), F.size("_levels") - 1), step)

    paths = F.transform("_l", lambda x, at: F.struct(x["i"].alias("i"), path(at).alias("proof")))
    proofs = levels.select(*batch, paths.alias("_paths")).select(*batch, F.explode("_paths").alias("_p"))
    return df.join(proofs.select(*batch, F.col("_p.i").alias(position), F.col("_p.proof").alias("proof")), [*batch, position])


def fold_proof(leaf: Column, proof: Column) -> Column:
    """Root computed from a leaf and its path."""
    return F.aggregate(proof, leaf, lambda acc, s: F.when(s["side"] == "left", node(s["sibling"], acc)).otherwise(node(acc, s["sibling"])))


def verify_proofs(df: DataFrame, leaf: str = "raw_hash", root: str = "batch_root") -> DataFrame:
    """Add ``proof_ok``."""
    return df.withColumn("proof_ok", fold_proof(F.lower(F.col(leaf)), F.col("proof")) == F.lower(F.col(root)))


# -- ledger -------------------------------------------------------------------------------

def _sha(*parts: str) -> str:
    return hashlib.sha256(b"".join(bytes.fromhex(p) for p in parts)).hexdigest()


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains the batch roots of each ledger; the rows of a task come by ledger and seq, so only the last root is held."""
    ledger = prev = None
    for pdf in frames:
        before, after = [], []
        for name, root, seed in zip(pdf["ledger"], pdf["batch_root"], pdf["seed"]):
            prev = prev if name == ledger else seed
            ledger = name
            before.append(prev)
            prev = _sha(prev, root)
            after.append(prev)
        yield pdf[["ledger", "seq"]].assign(prev_chained_root=before, chained_root=after)


def seal_batches(bronze: DataFrame, batch_size: int = 1000, sealed_at_ns: int | None = None, prev: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(ledger entries, event index)`` for raw events, one ledger per ingest date and source.

    Batches of ``batch_size`` events in ingest order get a Merkle root; every entry hashes the chained root of
    the one before it with its own root. The first links to 32 zero bytes, or to the ``chained_root`` that ``prev`` (``ledger,
    chained_root``) holds for the ledger; where ``prev`` has ``entries``, numbering goes on from that number. The index maps each event to ``(ledger, ledger_seq, leaf_index)``.
    """
    day = event_date(F.col("ingest_time_ns"))
    named = bronze.select(F.concat_ws("/", day, "source_id").alias("ledger"), "event_uid", "ingest_time_ns", F.lower("raw_hash").alias("raw_hash"))
    placed = global_position(named, ["ledger"], ["ingest_time_ns", "event_uid"], "_pos")
    first_seq = F.lit(0).cast("bigint")
    if prev is not None and "entries" in prev.columns:
        placed = placed.join(broadcast_if_small(prev.select("ledger", F.col("entries").cast("bigint").alias("_entries"))), "ledger", "left")
        first_seq = F.coalesce("_entries", first_seq)
    placed = placed.withColumns({"seq": first_seq + floor_div(F.col("_pos"), batch_size), "leaf_index": (F.col("_pos") % batch_size).cast("bigint")})
    roots = merkle_roots(placed, ["ledger", "seq"], [], positioned="leaf_index").withColumnRenamed("root", "batch_root")
    ends = placed.groupBy("ledger", "seq").agg(F.min_by("event_uid", "leaf_index").alias("first_event_uid"), F.max_by("event_uid", "leaf_index").alias("last_event_uid"))
    entries = checkpoint(roots.join(ends, ["ledger", "seq"]))  # one row per batch, read twice below
    seeded = entries.select("ledger", "seq", "batch_root").withColumn("seed", F.lit(GENESIS))
    if prev is not None:
        heads = broadcast_if_small(prev.select("ledger", F.col("chained_root").alias("head")))
        seeded = seeded.join(heads, "ledger", "left").withColumn("seed", F.coalesce("head", "seed")).drop("head")
    # one row per batch of events; a ledger's chain is sequential by its nature
    chained = seeded.repartition("ledger").sortWithinPartitions("ledger", "seq").mapInPandas(_chain, f"ledger string, seq {dict(entries.dtypes)['seq']}, prev_chained_root string, chained_root string")
    at = F.lit(sealed_at_ns).cast("bigint") if sealed_at_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    ledger = entries.join(chained, ["ledger", "seq"]).select(
        "ledger", "seq", "batch_root", "prev_chained_root", "chained_root", "leaf_count", "first_event_uid", "last_event_uid",
        at.alias("sealed_at_ns"), F.lit(None).cast("binary").alias("signature"),
    )
    return ledger, placed.select("event_uid", "ledger", F.col("seq").alias("ledger_seq"), "leaf_index")


def ledger_heads(ledger: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """``ledger, chained_root, entries``: where each ledger stands after these entries; ledgers of ``prev`` without new ones stand where they stood."""
    heads = ledger.groupBy("ledger").agg(F.max_by("chained_root", "seq").alias("chained_root"), (F.max("seq") + 1).cast("bigint").alias("entries"))
    if prev is not None:
        heads = heads.unionByName(prev).groupBy("ledger").agg(F.max_by("chained_root", "entries").alias("chained_root"), F.max("entries").alias("entries"))
    return heads


def check_links(ledger: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Add ``link_ok`` to each entry: it follows the previous one (the first: ``prev``, see ``seal_batches``), links to its chained root and recomputes."""
    before = ledger.select(F.col("ledger").alias("_of"), (F.col("seq") + 1).alias("_next"), F.col("chained_root").alias("_prev"))
    keyed = ledger.join(before, (F.col("ledger") == F.col("_of")) & (F.col("seq") == F.col("_next")), "left")
    first = F.lit(GENESIS)
    if prev is not None:
        keyed = keyed.join(broadcast_if_small(prev.select(F.col("ledger").alias("_named"), F.col("chained_root").alias("_head"))), F.col("ledger") == F.col("_named"), "left")
        first = F.coalesce("_head", first)
    linked = F.col("prev_chained_root") == F.when(F.col("seq") == 0, first).otherwise(F.col("_prev"))
    hashed = node(F.col("prev_chained_root"), F.col("batch_root")) == F.col("chained_root")
    return keyed.withColumn("link_ok", F.coalesce(linked & hashed, F.lit(False))).drop("_of", "_next", "_prev", "_named", "_head")


def verify_chain(ledger: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """``ledger, entries, chain_ok, first_bad_seq`` per ledger."""
    checked = check_links(ledger, prev)
    return checked.groupBy("ledger").agg(
        F.count("*").alias("entries"), F.bool_and("link_ok").alias("chain_ok"),
        F.min(F.when(~F.col("link_ok"), F.col("seq"))).alias("first_bad_seq"),
    )


def ledger_status(ledger: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Entries, sealed events, last seal and whether the whole chain holds."""
    checked = check_links(ledger, prev)
    return checked.agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("leaf_count"), F.lit(0)).alias("events_sealed"),
        F.max("sealed_at_ns").alias("last_sealed_at_ns"), F.coalesce(F.bool_and("link_ok"), F.lit(True)).alias("chain_ok"),
    )


def locate_leaves(bronze: DataFrame, index: DataFrame, ledger: DataFrame) -> DataFrame:
    """Raw events with the batch and leaf that hold them (nulls for unsealed ones)."""
    entries = ledger.select("ledger", F.col("seq").alias("ledger_seq"), "batch_root", "chained_root", "leaf_count")
    return bronze.join(index, "event_uid", "left").join(entries, ["ledger", "ledger_seq"], "left")


def verify_events(bronze: DataFrame, index: DataFrame, ledger: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Per event: ``hash_ok``, ``proof_ok`` (its recomputed hash is in the sealed root) and ``chain_ok``.

    The proof uses the recorded hashes of the sibling events and the recomputed hash of the event.
    """
    placed = locate_leaves(verify_hashes(bronze), index, ledger).withColumn("recomputed_hash", F.sha2("raw", 256))
    sealed = placed.filter(F.col("ledger").isNotNull())
    proofs = merkle_proofs(sealed.select("event_uid", "ledger", "ledger_seq", "leaf_index", "raw_hash"), ["ledger", "ledger_seq"], "leaf_index").select("event_uid", "proof")
    links = check_links(ledger, prev).select("ledger", F.col("seq").alias("ledger_seq"), F.col("link_ok").alias("chain_ok"))
    out = placed.join(proofs, "event_uid", "left").join(links, ["ledger", "ledger_seq"], "left")
    proof_ok = fold_proof(F.col("recomputed_hash"), F.col("proof")) == F.col("batch_root")
    out = out.withColumn("proof_ok", F.when(F.col("proof").isNotNull(), proof_ok))
    passed = F.col("hash_ok") & F.coalesce(F.col("proof_ok") & F.col("chain_ok"), F.col("ledger").isNull())
    return out.select("event_uid", "hash_ok", "proof_ok", "chain_ok", "ledger", "ledger_seq", "leaf_index", "batch_root", "recomputed_hash", "proof", passed.alias("verified"))


def event_proof(bronze: DataFrame, index: DataFrame, ledger: DataFrame, event_uid: str, prev: DataFrame | None = None) -> DataFrame:
    """The proof of one event. A ledger is named by its ingest date, so of a bronze table with dates only that
    partition is read; of it, the events of the batch."""
    spot = index.filter(F.col("event_uid") == event_uid).select("ledger", "ledger_seq").first()
    if spot is None:  # not sealed: the event alone
        mine, siblings = index.limit(0), bronze.filter(F.col("event_uid") == event_uid)
    else:
        mine = index.filter((F.col("ledger") == spot["ledger"]) & (F.col("ledger_seq") == spot["ledger_seq"]))
        day = bronze.filter(F.col("date") == spot["ledger"].split("/")[0]) if "date" in bronze.columns else bronze
        siblings = day.join(broadcast_if_small(mine.select("event_uid")), "event_uid", "left_semi")
    return verify_events(siblings, mine, ledger, prev).filter(F.col("event_uid") == event_uid)


def lineage(silver: DataFrame, bronze: DataFrame, index: DataFrame, ledger: DataFrame) -> DataFrame:
    """Silver rows with their raw hash check and ledger position."""
    raw = verify_hashes(bronze).select("event_uid", F.col("hash_ok").alias("raw_verified"), "source_id")
    version = F.col("`metadata.log_version`") if "metadata.log_version" in silver.columns else F.lit(None).cast("string")
    place = locate_leaves(raw, index, ledger)
    return silver.select("event_uid", "raw_hash", "source_type", version.alias("mapping_version")).join(
        place.select("event_uid", "raw_verified", "source_id", "ledger", "ledger_seq", "leaf_index", "batch_root"), "event_uid", "left"
    )
