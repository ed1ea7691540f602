"""Sharding by fixed virtual slots.

A record's slot is a hash of its id modulo a number that never changes, some thousands. Bytes are
aggregated by slot, and a small map says which shard holds a slot. Maps are versions of one table:
the first deals slots, heaviest first, to the lightest shard; later ones are edited copies that move
only what balance asks for, so when a shard is added, records move into it and nowhere else.

Sizes are near equal under the map (the law is ``bytes``): slots are many times lighter than a
shard. A slot that isn't, as one id may fill a third of the table, is split into pieces that are
mapped one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import written

SLOTS = 4096
#: A slot of more than this many times the mean bytes is split.
HEAVY = 4
MAP = "virtual_slot int, piece int, pieces int, bytes long, n_rows long, shard int, base long"


@dataclass(frozen=True)
class Unit:
    """A slot, or a piece of a heavy one, where it lives, and the rows before it in its shard."""

    virtual_slot: int
    piece: int
    pieces: int
    bytes: int
    n_rows: int
    shard: int = -1
    base: int = 0

    @property
    def key(self) -> tuple[int, int]:
        return self.virtual_slot, self.piece


def keyed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, uid`` of ``docs(doc_id, text)``, written once.

    ``size`` is the bytes of the text in UTF-8 plus one; null texts have none, and their checksum is
    that of the empty text. Rows without an id are hashed by their text. ``uid`` numbers the rows of
    the written table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slot = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("long"))), F.lit(slots)).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("virtual_slot")
    )
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "keyed")


def units(rows: DataFrame, slots: int = SLOTS) -> list[Unit]:
    """Bytes and rows of each slot, heavy ones in pieces: at most a quarter more units than slots."""
    per = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")).collect()  # a row a slot
    limit = max(HEAVY * sum(r["bytes"] for r in per) / slots, 1.0)
    cut = {r["virtual_slot"]: int(-(-r["bytes"] // limit)) for r in per if r["bytes"] > limit and r["n_rows"] > 1}
    out = [Unit(r["virtual_slot"], 0, 1, r["bytes"], r["n_rows"]) for r in per if r["virtual_slot"] not in cut]
    if cut:
        spark = rows.sparkSession
        pieces = spark.createDataFrame(list(cut.items()), "virtual_slot int, pieces int")
        split = rows.join(F.broadcast(pieces), "virtual_slot").withColumn("piece", _piece())  # fewer rows than slots
        for r in split.groupBy("virtual_slot", "piece", "pieces").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")).collect():
            out.append(Unit(r["virtual_slot"], r["piece"], r["pieces"], r["bytes"], r["n_rows"]))
    return sorted(out, key=lambda u: u.key)


def _piece():
    return F.pmod(F.xxhash64("uid"), F.col("pieces")).cast("int")


def dealt(found: Iterable[Unit], loads: dict[int, int]) -> list[Unit]:
    """Units, heaviest first, each to the shard with the least bytes; ``loads`` are the bytes there already."""
    heap, out = [(n, s) for s, n in sorted(loads.items())], []
    heapq.heapify(heap)
    for u in sorted(found, key=lambda u: (-u.bytes, u.key)):
        n, s = heapq.heappop(heap)
        out.append(replace(u, shard=s))
        heapq.heappush(heap, (n + u.bytes, s))
    return sorted(out, key=lambda u: u.key)


def edited(old: Iterable[Unit], found: Iterable[Unit], shards: int) -> list[Unit]:
    """The old map for the slots as they are now, over ``shards`` shards.

    Slots stay where they are. From shards above the mean, units go while what stays is the mean at
    least; they, slots that the old map lacks and those of shards that are gone are dealt out: to new
    shards alone, if there are any and no old one is gone, else to the lightest.
    """
    home = {u.key: u.shard for u in old}
    before = {s for s in home.values()}
    new = [s for s in range(shards) if s not in before]
    kept: dict[int, list[Unit]] = {s: [] for s in range(shards)}
    loose = []
    for u in found:
        s = home.get(u.key, home.get((u.virtual_slot, 0), -1))
        if 0 <= s < shards:
            kept[s].append(replace(u, shard=s))
        else:
            loose.append(u)
    target = (sum(u.bytes for many in kept.values() for u in many) + sum(u.bytes for u in loose)) / shards
    loads = {s: sum(u.bytes for u in many) for s, many in kept.items()}
    for s, many in kept.items():
        for u in sorted(many, key=lambda u: (-u.bytes, u.key)):
            if loads[s] - u.bytes >= target:
                loads[s] -= u.bytes
                many.remove(u)
                loose.append(u)
    into = {s: loads[s] for s in new} if new and before <= set(range(shards)) else loads
    return sorted([u for many in kept.values() for u in many] + dealt(loose, into), key=lambda u: u.key)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the map below ``path``, through Hadoop's file system API."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = (s.getPath() for s in files.listStatus(where))
    own = ((p.getName().partition("=")[2], p) for p in found if p.getName().startswith("version="))
    return sorted(int(n) for n, p in own if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest unless named: ``virtual_slot, piece, pieces, bytes, n_rows, shard, base``."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"no version {version or ''} of a slot map at {path}; there are {known}")
    return spark.read.schema(MAP).parquet(f"{path}/version={version or known[-1]}")


def write_map(rows: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Write the next version of the map for ``rows`` of :func:`keyed`, and return it.

    The first version deals all slots; each further one edits the one before it.
    """
    spark, found = rows.sparkSession, units(rows, slots)
    known = versions(spark, path)
    if known:
        old = [Unit(**r.asDict()) for r in read_map(spark, path).collect()]  # as many rows as units
        placed = edited(old, found, shards)
    else:
        placed = dealt(found, dict.fromkeys(range(shards), 0))
    version = known[-1] + 1 if known else 1
    data, filled = [], dict.fromkeys(range(shards), 0)
    for u in placed:
        data.append((u.virtual_slot, u.piece, u.pieces, u.bytes, u.n_rows, u.shard, filled[u.shard]))
        filled[u.shard] += u.n_rows
    spark.createDataFrame(data, MAP).coalesce(1).write.parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` of :func:`keyed` with ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    Records are numbered inside their unit, in the order of their id, side by side for all units, and
    moved by the rows of the units before it in the shard; the map tells those. Repeated rows have
    places of their own. The map has a bounded number of rows and goes along with the join.
    """
    cut = slot_map.select("virtual_slot", "pieces").distinct()
    own = rows.join(F.broadcast(cut), "virtual_slot").withColumn("piece", _piece()).drop("pieces")
    at = F.row_number().over(Window.partitionBy("virtual_slot", "piece").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "uid")) - 1
    based = slot_map.select("virtual_slot", "piece", "shard", "base")
    return own.withColumn("at", at).join(F.broadcast(based), ["virtual_slot", "piece"]).withColumn("slot", F.col("base") + F.col("at")).drop("base", "at")


def shard(docs: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Place ``docs(doc_id, text)`` in ``shards`` shards under the next version of the map at ``path``.

    Returns per row ``doc_id, size, text_crc32, virtual_slot, piece, uid, shard, slot``. Other columns
    are ignored; null texts have size 1; rows that repeat an id share a slot and have places of their
    own; an empty table gives an empty one, and an empty version of the map.
    """
    rows = keyed(docs, slots)
    return place(rows, write_map(rows, path, shards, slots))
