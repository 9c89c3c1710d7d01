"""Shards by fixed virtual slots: records hash into slots, slots belong to shards, and only that map is edited when shards are rebalanced or added.

The number of slots is a parameter that never changes for a data set; a record's slot comes from its id and its text's checksum, so neither an id nor a text that many
rows share makes a slot heavy. Rows that repeat as a whole are counted first, and each `REPEATS` of them have a slot of their own. Spark adds up bytes and rows
by slot; the map (a row a slot: bounded by the parameter) is all that the driver sees. Its versions are kept side by side as a table, one folder
each: version 1 deals the slots round, and every later one is an edit of its predecessor that moves or swaps as few slots as it can
until the shards' bytes are within `tolerance` of each other. A version of which rows are missing (a writer that was lost) is passed over.

The query's law is `bytes`: sizes near equal. Unequal stay only shards whose excess is one slot, which mostly is one long document.

A record's place in its shard is the number of rows in the shard's slots before its own, which the map has, plus its rank in its slot: no
task sees more than a slot, that is the share 1 / slots of all rows.

Defined cases: null text is empty (size 16); null ids are a value like any other, so their rows spread by text; repeated rows get places of their own;
the order within a slot is by id (null first), checksum and size; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialize, new_path

SLOTS = 8192
#: Equal rows that share a slot.
REPEATS = 64
#: Bytes that a record takes besides its text.
OVERHEAD = 16
_MAP = "slot int, shard int, bytes long, n_rows long, version int"


def totals(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """Bytes of each shard."""
    out = np.zeros(shards, np.int64)
    np.add.at(out, owner, load)
    return out


def rebalanced(owner: np.ndarray, load: np.ndarray, shards: int, tolerance: float = 0.001, most: int = 100_000) -> np.ndarray:
    """The map edited until the shards' bytes differ by tolerance of their mean: each edit moves a slot from the fullest shard to the emptiest, or swaps two, so that their gap closes best."""
    owner, full = owner.copy(), totals(owner, load, shards)
    open_ = np.ones(shards, bool)  # without shards that no edit helps: one slot outweighs the rest
    close = max(1, int(tolerance * full.mean()))
    for _ in range(most):
        among = np.flatnonzero(open_)
        if len(among) < 2:
            break
        hi, lo = among[np.argmax(full[among])], among[np.argmin(full[among])]
        gap = int(full[hi] - full[lo])
        if gap <= close:
            break
        mine, theirs = np.flatnonzero((owner == hi) & (load > 0)), np.flatnonzero((owner == lo) & (load > 0))
        less = load[mine][:, None] - np.append(load[theirs], 0)[None, :]
        off = np.where((less > 0) & (less < gap), np.abs(2 * less - gap), gap)
        if not off.size or off.min() >= gap:
            open_[hi] = False
            continue
        i, j = np.unravel_index(np.argmin(off), off.shape)
        owner[mine[i]] = lo
        if j < len(theirs):
            owner[theirs[j]] = hi
        full[hi] -= less[i, j]
        full[lo] += less[i, j]
    return owner


def with_one_more(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map with shard number `shards` added: it takes slots of the fullest shards until it has its share; no slot moves between the others."""
    owner, full = owner.copy(), totals(owner, load, shards + 1)
    share = int(full.sum()) // (shards + 1)
    stay = np.zeros(len(owner), bool)
    while full[shards] < share and not stay.all():
        at = np.flatnonzero(~stay & (owner != shards))
        if not len(at):
            break
        from_ = owner[at[np.argmax(full[owner[at]])]]
        mine = at[owner[at] == from_]
        fits = mine[load[mine] <= share - full[shards]]
        if not len(fits):
            stay[mine] = True
            continue
        slot = fits[np.argmax(load[fits])]
        if load[slot] == 0:
            stay[mine] = True
            continue
        owner[slot], full[from_], full[shards] = shards, full[from_] - load[slot], full[shards] + load[slot]
    return owner


def save_version(spark: SparkSession, path: str, version: int, owner: np.ndarray, load: np.ndarray, rows: np.ndarray) -> None:
    """Add a version of the map; there must be none of that number."""
    cells = zip(range(len(owner)), owner.tolist(), load.tolist(), rows.tolist(), [version] * len(owner), strict=True)
    spark.createDataFrame(list(cells), _MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """slot, shard, bytes, n_rows, version of the latest complete version of the map, or of the one asked for; None if there is none."""
    from parlance.sources.readers import missing

    try:
        every = spark.read.schema(_MAP).option("basePath", path).parquet(f"{path}/version=*")
        full = every.groupBy("version").agg(F.count("*").alias("n"), (F.max("slot") + 1).alias("slots")).where("n = slots")
        found = full.agg(F.max("version") if version is None else F.max(F.when(F.col("version") == version, version))).first()[0]
    except Exception as e:
        if not missing(e):
            raise
        found = None
    return None if found is None else every.where(F.col("version") == found)


def _arrays(slots: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, bytes, rows) by slot, of a table of at most n slots."""
    out = np.zeros((3, n), np.int64)
    for r in slots.select("slot", "shard", "bytes", "n_rows").collect():
        out[:, r[0]] = r[1], r[2], r[3]
    return out[0], out[1], out[2]


def add_shard(spark: SparkSession, path: str) -> int:
    """Write the next version of the map at path, with one more shard; returns its number."""
    latest = load_map(spark, path)
    n, version, shards = latest.agg(F.count("*"), F.max("version"), F.max("shard") + 1).first()
    owner, load, rows = _arrays(latest, n)
    save_version(spark, path, version + 1, with_one_more(owner, load, shards), load, rows)
    return version + 1


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, n (equal rows), virtual_slot: distinct records, of each at most REPEATS rows a slot."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    own = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = F.col("copies")
    parts = own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / REPEATS))))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "part"), F.lit(slots)).cast("int")
    return parts.select("doc_id", "size", "text_crc32", F.least(F.lit(REPEATS), n - F.col("part") * REPEATS).alias("n"), slot.alias("virtual_slot"), "part")


def slot_loads(records: DataFrame) -> DataFrame:
    """slot, bytes, n_rows: a row a slot at most."""
    return records.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n_rows"))


def edited_map(spark: SparkSession, path: str, loads: DataFrame, shards: int, slots: int, tolerance: float) -> DataFrame:
    """The map at path for these loads: its first version if there is none yet, and a further one if the shards aren't near equal."""
    _, load, rows = _arrays(loads.withColumn("shard", F.lit(0)), slots)
    latest = load_map(spark, path)
    version = 0 if latest is None else latest.agg(F.max("version")).first()[0]
    owner = np.arange(slots) % shards if latest is None else _arrays(latest, slots)[0]
    if latest is None:
        version = 1
        save_version(spark, path, version, owner, load, rows)
    elif latest.count() != slots:
        raise ValueError(f"the map at {path} has another number of slots than {slots}")
    better = rebalanced(owner, load, max(shards, int(owner.max()) + 1), tolerance)
    save_version(spark, path, version + 1, better, load, rows)  # also where no slot moves: the places below need these loads
    return load_map(spark, path, version + 1)


def places(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """One row for each document: shard, and slot, its place in the shard."""
    w = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).alias("first"))
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = records.withColumn("rank", F.coalesce(F.sum("n").over(in_slot), F.lit(0)))
    out = ranked.join(F.broadcast(first), "virtual_slot")  # as many rows as slots
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", F.col("first") + F.col("rank") + F.col("copy"))


def shard_documents(docs: DataFrame, path: str, shards: int = 40, slots: int = SLOTS, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every document. path: the folder of the map's versions, in a shared store."""
    spark = docs.sparkSession
    records = materialize(slotted(docs.select("doc_id", "text"), slots), "records")
    slot_map = edited_map(spark, path, slot_loads(records), shards, slots, tolerance)
    version: Column = F.lit(slot_map.first()["version"])
    out = places(records, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", version.alias("map_version"))


def sharded(docs: DataFrame) -> DataFrame:
    """All documents in shards 0 to 39, under a new map in the shared folder."""
    return shard_documents(docs, new_path(docs.sparkSession, "slot-map"))
