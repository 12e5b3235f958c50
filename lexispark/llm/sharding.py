"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots; bytes are summed per slot; a map gives each
slot its shard. Rebalancing edits the map and stores it as the next version, so a reader of any
version finds every record by its key and text: slot by hash, shard by the map. Whatever grows
with the data stays in DataFrames; only the slot table, of fixed length, reaches the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SLOTS = 8192


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record: by its key and its text, so that rows that share a key, or have none, are spread."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


@dataclass
class SlotMap:
    """Which shard holds each virtual slot, with its version and the slots moved since the last."""

    shards: int
    shard_of: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [s % shards for s in range(slots)])

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = 0.0005) -> SlotMap:
        """The next version: moves slots from the heaviest to the lightest shard while that evens them.

        Each move takes the slot nearest to half the difference, so that few slots move. It ends
        when the difference is under `tolerance` of the mean or no move lowers it. `shards` may
        be larger than now: new shards begin empty and only receive.
        """
        n = shards or self.shards
        if n < self.shards:
            raise ValueError("a shard can't be taken away while its slots are mapped")
        where, load = list(self.shard_of), [0] * n
        held: list[list[int]] = [[] for _ in range(n)]
        for slot, size in slot_bytes.items():
            load[where[slot]] += size
            held[where[slot]].append(slot)
        mean = sum(load) / n
        moved: set[int] = set()
        heavy = [(-x, i) for i, x in enumerate(load)]
        heapq.heapify(heavy)
        while heavy:
            x, top = heavy[0]
            if -x != load[top]:
                heapq.heapreplace(heavy, (-load[top], top))
                continue
            low = min(range(n), key=lambda i: (load[i], i))
            gap = load[top] - load[low]
            if gap <= tolerance * mean:
                break
            fits = [s for s in held[top] if 0 < slot_bytes[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
            held[top].remove(slot)
            held[low].append(slot)
            load[top] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            where[slot] = low
            moved.add(slot)
            heapq.heapreplace(heavy, (-load[top], top))
            heapq.heappush(heavy, (-load[low], low))
        return SlotMap(n, where, self.version + 1, sorted(s for s in moved if where[s] != self.shard_of[s]))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, x) for s, x in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "map_version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones; a version is written once."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version:06d}").orderBy("virtual_slot").collect()
        return cls(rows[0].n_shards, [r.shard for r in rows], version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): a narrow row for each record; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), text, slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every occupied slot; as many as there are slots at most."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in sums}


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, base: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """A row for every record with its shard and its gapless position (`slot`) there.

    The law is `bytes`: the base map (even by count, or a stored version) is edited until the
    shards' bytes are nearly equal; `store` keeps both versions. Positions are numbered inside
    virtual slots and shifted by what the shard's earlier slots hold, so that no task sorts a
    whole shard. Null texts count as empty. Rows of equal id and text share a virtual slot, and
    any order among them gives the same rows; other rows of an id, or without one, are spread
    by their texts. Other columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = records(docs, slots)
    sizes = slot_sizes(rows)
    first = base or SlotMap.even(shards, slots)
    now = first.rebalanced({s: b for s, (b, _) in sizes.items()}, shards)
    if store:
        for version in (first, now):
            version.save(spark, store)
    begin, at = [0] * slots, [0] * now.shards
    for s in range(slots):
        begin[s] = at[now.shard_of[s]]
        at[now.shard_of[s]] += sizes.get(s, (0, 0))[1]
    placed = spark.createDataFrame([(s, now.shard_of[s], begin[s]) for s in range(slots)], "virtual_slot int, shard int, begin long")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    # One row for each virtual slot, a fixed number: safe to broadcast.
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(placed), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("begin") + F.col("within") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(now.version).alias("map_version"),
        )
    )
