"""Shards by fixed virtual slots.

Every row is hashed (id and text) into one of `slots` virtual slots, a number
that never changes. A table maps slots to shards and has versions: a version is
the one before it, edited. Rebalancing aggregates the bytes of each slot and
moves slots from heavy shards to light ones, or swaps two, until shards differ
by less than `tolerance` of their mean or nothing helps; growing by a shard
takes slots from the others into it alone. Where rows of one slot outweigh an
eighth of a shard (many equal rows), the map splits the slot into pieces, to
which its rows are dealt by their number.

The slots and their bytes are bounded by parameters (slots + 8 * shards rows), so
editing the map is the driver's work; rows are reduced to a digest of some 40
bytes, written once, and only joined with the broadcast map. A row's place in
its shard is the count of its shard's rows in partitions before its own and its
rank in its partition, so no shard's rows are sorted in one task.

A row's size is its text's UTF-8 bytes plus `overhead`; null texts have none.
Null ids, repeated rows and empty texts are rows like others. An empty table
gives no rows and leaves the map as it is.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _spark

SLOTS = 1 << 14
SPLIT = 8  # a slot of more than this part of a shard is split
TOLERANCE = 0.001
_MAP = "version long, virtual_slot int, piece int, pieces int, shard int"


@dataclass(frozen=True)
class Entry:
    virtual_slot: int
    piece: int
    pieces: int
    shard: int


class SlotMap:
    """Versions of the map in a folder of Parquet; the largest number is current."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self, shards: int, slots: int = SLOTS) -> int:
        """The first version: slots dealt out evenly, in order."""
        return self._write(0, [Entry(s, 0, 1, s * shards // slots) for s in range(slots)])

    def _write(self, version: int, entries: list[Entry]) -> int:
        rows = [(version, e.virtual_slot, e.piece, e.pieces, e.shard) for e in entries]
        self.spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").parquet(self.folder)
        return version

    def table(self, version: int | None = None) -> DataFrame:
        stored = self.spark.read.schema(_MAP).parquet(self.folder)
        return stored.where(F.col("version") == (self.versions()[-1] if version is None else version)).drop("version")

    def versions(self) -> list[int]:
        return sorted(r[0] for r in self.spark.read.schema(_MAP).parquet(self.folder).select("version").distinct().collect())

    def entries(self, version: int | None = None) -> list[Entry]:
        return [Entry(*r) for r in self.table(version).orderBy("virtual_slot", "piece").collect()]

    def edit(self, entries: list[Entry]) -> int:
        return self._write(self.versions()[-1] + 1, entries)


def digest(docs: DataFrame, slots: int = SLOTS, overhead: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and row, a number of the row, for every row; written once."""
    source = _spark.columns(docs, doc_id=id, text=text)
    return _spark.checkpoint(
        source.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _loads(rows: DataFrame, entries: list[Entry], shards: int, split: bool) -> tuple[list[Entry], dict[tuple[int, int], int]]:
    """The entries, with heavy slots split where asked, and the bytes of each (slot, piece)."""
    sums = {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    most = max(1, sum(sums.values()) // (shards * SPLIT))
    whole = {e.virtual_slot: e for e in entries if e.piece == 0}
    pieces = {s: max(whole[s].pieces, -(-b // most) * split) for s, b in sums.items() if split and b > most or whole[s].pieces > 1}
    loads = {(s, 0): b for s, b in sums.items()}
    if pieces:
        cut = rows.sparkSession.createDataFrame(list(pieces.items()), "virtual_slot int, pieces int")
        dealt = rows.join(F.broadcast(cut), "virtual_slot").groupBy("virtual_slot", _piece("pieces").alias("piece")).agg(F.sum("size"))
        loads |= {(s, 0): 0 for s in pieces} | {(r[0], r[1]): r[2] for r in dealt.collect()}
    kept = {(e.virtual_slot, e.piece): e for e in entries if pieces.get(e.virtual_slot, 1) == e.pieces}
    new = [Entry(s, k, n, whole[s].shard) for s, n in pieces.items() for k in range(n) if (s, k) not in kept]
    return sorted([*kept.values(), *new], key=lambda e: (e.virtual_slot, e.piece)), loads


def _piece(pieces: str) -> Column:
    return F.pmod(F.xxhash64("row"), F.col(pieces)).cast("int")


def _levelled(entries: list[Entry], loads: dict[tuple[int, int], int], shards: int, tolerance: float) -> list[Entry]:
    """Moves and swaps between the heaviest and the lightest shard, each the one that brings both nearest to each other."""
    own: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}  # (bytes, place of the entry)
    for k, e in enumerate(entries):
        own.setdefault(e.shard, []).append((loads.get((e.virtual_slot, e.piece), 0), k))
    homeless = sorted((x for s in list(own) if s >= shards for x in own.pop(s)), reverse=True)
    total = {s: sum(b for b, _ in x) for s, x in own.items()}
    for x in own.values():
        x.sort()
    heap = [(b, s) for s, b in total.items()]
    heapq.heapify(heap)
    for b, k in homeless:  # of shards that there are no more
        _, s = heapq.heappop(heap)
        insort(own[s], (b, k))
        total[s] += b
        heapq.heappush(heap, (total[s], s))
    mean, by_load = sum(total.values()) / shards, sorted((b, s) for s, b in total.items())
    while (gap := by_load[-1][0] - by_load[0][0]) > tolerance * mean:
        (_, light), (_, heavy) = by_load[0], by_load[-1]
        best: tuple[float, int, int] | None = None  # what is left of the gap, places in the shards' lists (-1: none)
        sizes = [b for b, _ in own[light]]
        for i, (b, _) in enumerate(own[heavy]):
            j = bisect_left(sizes, b - gap / 2)
            for k in (-1, j - 1, j):
                if k < len(sizes) and 0 < (d := b - (sizes[k] if k >= 0 else 0)) < gap and (best is None or abs(gap - 2 * d) < best[0]):
                    best = abs(gap - 2 * d), i, k
        if best is None:
            break
        moved = [(heavy, light, own[heavy].pop(best[1]))] + ([(light, heavy, own[light].pop(best[2]))] if best[2] >= 0 else [])
        by_load = by_load[1:-1]
        for old, new, x in moved:
            insort(own[new], x)
            total[old], total[new] = total[old] - x[0], total[new] + x[0]
        for s in (light, heavy):
            insort(by_load, (total[s], s))
    shard = {k: s for s, x in own.items() for _, k in x}
    return [replace(e, shard=shard[k]) for k, e in enumerate(entries)]


def rebalance(slot_map: SlotMap, rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> int:
    """A version in which the shards' bytes are near equal; slots that need not move stay. rows: as `digest` gives them."""
    entries, loads = _loads(rows, slot_map.entries(), shards, split=True)
    return slot_map.edit(_levelled(entries, loads, shards, tolerance))


def grow(slot_map: SlotMap, rows: DataFrame) -> int:
    """A version with one more shard, into which rows move and between the others none: the heaviest shard gives, until the new one has its part."""
    before = slot_map.entries()
    new = max(e.shard for e in before) + 1
    entries, loads = _loads(rows, before, new + 1, split=False)
    weight = [loads.get((e.virtual_slot, e.piece), 0) for e in entries]
    own: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, e in enumerate(entries):
        own[e.shard].append((weight[k], k))
    heap = [(-sum(b for b, _ in x), s) for s, x in own.items()]
    heapq.heapify(heap)
    for x in own.values():
        x.sort()
    room, taken = sum(weight) // (new + 1), set()
    while heap and room > 0:
        load, s = heapq.heappop(heap)
        j = bisect_left(own[s], (min(room, -load) // 2 + 1, -1)) - 1
        if j < 0:
            continue  # its smallest slot would be too much
        b, k = own[s].pop(j)
        taken.add(k)
        room -= b
        heapq.heappush(heap, (load + b, s))
    return slot_map.edit([replace(e, shard=new) if k in taken else e for k, e in enumerate(entries)])


def place(rows: DataFrame, slot_map: SlotMap, version: int | None = None) -> DataFrame:
    """The rows of `digest` with shard and slot, the row's place in its shard, from 0 without gaps."""
    table = slot_map.table(version)
    split = table.where(F.col("pieces") > 1).select("virtual_slot", "pieces").distinct()
    dealt = rows.join(F.broadcast(split), "virtual_slot", "left").withColumn("piece", F.coalesce(_piece("pieces"), F.lit(0))).drop("pieces")
    found = dealt.join(F.broadcast(table.drop("pieces")), ["virtual_slot", "piece"]).withColumn("part", F.shiftright("row", 33))
    counts = found.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return found.withColumn("rank", rank).join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))
