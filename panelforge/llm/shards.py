"""Sharding over fixed virtual slots.

A record hashes to one of SLOTS virtual slots. Rows and bytes are summed for each slot, which gives a table of at most
SLOTS rows whatever the input. A slot map says which shard owns each slot; it is numbered by version and kept as a small
table. Building or rebalancing a map edits that map and never rehashes a record.
"""

from __future__ import annotations

import bisect
import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

SLOTS = 8192
TOGETHER = 10  #: copies of a record that stay together
FRAME_BYTES = 8  #: stored with each record besides its text


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the owner of each slot. moved: the slots that this version reassigned."""

    version: int
    shards: int
    owner: tuple[int, ...]
    moved: tuple[int, ...] = field(default=(), compare=False)

    def table(self, spark: SparkSession) -> DataFrame:
        """The map as rows (version, slot, shard), to be stored beside earlier versions."""
        owner = F.from_json(F.lit(json.dumps(self.owner)), "array<int>")
        rows = spark.range(1).select(F.lit(self.version).alias("version"), F.posexplode(owner).alias("vslot", "shard"))
        return rows.withColumn("moved", F.array_contains(F.from_json(F.lit(json.dumps(self.moved)), "array<int>"), F.col("vslot")))

    @staticmethod
    def load(rows: DataFrame, version: int | None = None) -> SlotMap:
        """A stored version (the last by default). At most SLOTS rows are read."""
        at = version if version is not None else rows.agg(F.max("version")).first()[0]
        got = sorted((r["vslot"], r["shard"], r["moved"]) for r in rows.filter(F.col("version") == at).collect())
        return SlotMap(at, max(s for _, s, _ in got) + 1, tuple(s for _, s, _ in got), tuple(v for v, _, m in got if m))


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0: slots dealt out in turn, before anything is known of their bytes."""
    return SlotMap(0, shards, tuple(i % shards for i in range(slots)))


def rebalance(old: SlotMap, weight: dict[int, int], shards: int | None = None) -> SlotMap:
    """The next version: slots are moved from the fullest shards until loads are as near as whole slots allow.

    New shards start empty. A slot moves only if that lowers the larger of the two loads concerned, so a map that is
    even already stays as it is. Slots not in weight hold nothing and stay.
    """
    shards = shards or old.shards
    owner = [s if s < shards else None for s in old.owner]
    load = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loose = sorted(((weight.get(i, 0), i) for i, s in enumerate(owner) if s is None), reverse=True)
    for i, s in enumerate(owner):
        if s is not None and weight.get(i):
            load[s] += weight[i]
            own[s].append((weight[i], i))
    mean = sum(weight.values()) / shards
    for s in range(shards):  # the largest slots that fit into what a shard has beyond its share become loose
        kept = []
        for w, i in sorted(own[s], reverse=True):
            if w <= load[s] - mean:
                load[s] -= w
                loose.append((w, i))
            else:
                kept.append((w, i))
        own[s] = kept
    loose.sort(reverse=True)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for w, i in loose:
        x, s = heapq.heappop(heap)
        owner[i] = s
        own[s].append((w, i))
        heapq.heappush(heap, (x + w, s))
    load = [x for x, _ in sorted(heap, key=lambda x: x[1])]
    _refine(owner, own, load)
    return SlotMap(old.version + 1, shards, tuple(owner), tuple(i for i, s in enumerate(owner) if s != old.owner[i]))


def _refine(owner: list[int], own: list[list[tuple[int, int]]], load: list[int]) -> None:
    """Moves a slot from the fullest shard to the emptiest, or exchanges two, while that brings the two closer."""
    for _ in range(4 * len(load)):
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        theirs = sorted([(0, -1), *own[low]])
        best = (gap, None, None)
        for w, i in own[high]:  # the slot in return that leaves the two nearest to each other
            at = bisect.bisect_left(theirs, (w - gap / 2, -1))
            for v, j in theirs[max(0, at - 1) : at + 1]:
                best = min(best, (abs(gap - 2 * (w - v)), (w, i), (v, j)), key=lambda x: x[0])
        if best[1] is None:
            return
        (w, i), (v, j) = best[1:]
        own[high].remove((w, i))
        own[low].append((w, i))
        owner[i] = low
        if j >= 0:
            own[low].remove((v, j))
            own[high].append((v, j))
            owner[j] = high
        load[high] += v - w
        load[low] += w - v


def slotted(records: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, __vslot, __copies): records put into virtual slots, equal ones counted.

    Equal records are counted before the shuffle, and their copies go to slots by tens, so that no row that repeats, however
    often, makes a slot which no map can split. A slot hashes the key, the text's hash and the ten; a null key or text hashes
    like any other value.
    """
    content = F.col(f"`{text}`")
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + FRAME_BYTES
    rows = records.select(F.col(f"`{key}`").alias("doc_id"), size.alias("size"), F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("__hash"))
    counted = rows.groupBy("doc_id", "size", "text_crc32", "__hash").agg(F.count("*").alias("__n"))
    tens = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / TOGETHER)))
    dealt = counted.withColumn("__ten", tens).withColumn("__copies", F.least(F.lit(TOGETHER), F.col("__n") - F.col("__ten") * TOGETHER).cast("int"))
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__hash", "__ten"), F.lit(slots)).cast("int")
    return dealt.select("doc_id", "size", "text_crc32", slot.alias("__vslot"), "__copies")


def slot_stats(rows: DataFrame) -> DataFrame:
    """(__vslot, rows, bytes), at most one row for each slot; combined before the shuffle."""
    return rows.groupBy("__vslot").agg(F.sum("__copies").alias("rows"), F.sum(F.col("__copies") * F.col("size")).alias("bytes"))


def _lookup(values, kind: str):
    """Element __vslot of a list that has one entry for each slot: a literal in the plan, no join."""
    return F.element_at(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), F.col("__vslot") + 1)


def shard_records(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS
) -> tuple[DataFrame, SlotMap]:
    """Each record's shard and its place there, with sizes near equal; and the map that says so.

    Rows: doc_id, size, text_crc32, shard, slot, vslot, map_version. `slot` numbers a shard's records from 0 without
    gaps: a virtual slot's records are numbered in a window of that slot alone, and begin where the shard's earlier
    virtual slots end. Null texts have crc32 null and size 8; empty ones crc32 0. Repeated rows are each placed. An
    empty table gives no rows. Other columns are left out, so their names cannot clash.
    """
    rows = staged(slotted(docs, key, text, slots), "slotted")
    stats = {r["__vslot"]: r for r in slot_stats(rows).collect()}  # at most `slots` rows
    at = rebalance(even_map(shards, slots), {v: r["bytes"] for v, r in stats.items()})
    begins, filled = [0] * slots, [0] * shards
    for v in range(slots):
        begins[v] = filled[at.owner[v]]
        filled[at.owner[v]] += stats[v]["rows"] if v in stats else 0
    order = Window.partitionBy("__vslot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__copies").over(order), F.lit(0))
    each = F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__copy")
    out = rows.select("*", before.alias("__before")).select("*", each).select(
        "doc_id", "size", "text_crc32",
        _lookup(at.owner, "int").alias("shard"),
        (_lookup(begins, "bigint") + F.col("__before") + F.col("__copy")).alias("slot"),
        F.col("__vslot").alias("vslot"),
        F.lit(at.version).alias("map_version"),
    )
    return out, at
