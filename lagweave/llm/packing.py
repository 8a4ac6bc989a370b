"""Items of varying size into containers of fixed capacity.

Method. Bounded-space online best-fit: a fixed number of bins is open, their free spaces marked in a bitset; an item goes to
the open bin with the least free space that holds it, found by one shift and one lowest-bit search. If none does, a new bin
opens, and if too many are open the fullest closes. An item larger than the capacity is divided into full containers
and a remainder; no other is ever divided.

Scale. Items are hashed into buckets of about `per_bucket` items, each packed on its own in the order of its items, so the
result does not depend on partitions, cores or retries. The bins that a bucket leaves open, at most `open_bins`, are then
packed themselves as items, fullest first. State: one bitset and `open_bins` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.session import stored


class OpenBins:
    """The open bins of one run."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: dict[int, list[int]] = {}  # free space: bins
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        out = bins.pop()
        if not bins:
            del self.free[space]
            self.bits ^= 1 << space
        self.open -= 1
        return out

    def place(self, size: int) -> int:
        """The bin that gets the item; 0 < size <= capacity."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if size < self.capacity and self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, space = self.made, self.capacity
            self.made += 1
        if space > size:
            left = space - size
            self.free.setdefault(left, []).append(at)
            self.bits |= 1 << left
            self.open += 1
        return at


def _packer(limit: int):
    """Rows (pack_id, capacity, bucket, room, a, b), sorted by pack and bucket, to the same with the bin; then, with room NULL, each bin left open and its filling in a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, schema = None, None, None

        def left(key: tuple, bins: OpenBins) -> pa.RecordBatch:
            rest = [(at, bins.capacity - space) for space, own in bins.free.items() for at in own]
            n = len(rest)
            cols = [[key[0]] * n, [bins.capacity] * n, [key[1]] * n, [None] * n, [x for _, x in rest], [None] * n, [x for x, _ in rest]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([*(pa.field(f.name, f.type) for f in batch.schema), pa.field("bin", pa.int64())])
            packs, capacities, buckets, rooms = (batch.column(c).to_pylist() for c in ("pack_id", "capacity", "bucket", "room"))
            out, ends = [], []
            for key, capacity, room in zip(zip(packs, buckets), capacities, rooms):
                if key != now:
                    if bins:
                        ends.append(left(now, bins))
                    now, bins = key, OpenBins(capacity, limit)
                out.append(bins.place(room))
            yield pa.RecordBatch.from_arrays([*(c for c in batch.columns), pa.array(out, pa.int64())], schema=schema)
            yield from ends
        if bins:
            yield left(now, bins)

    return run


def _packed(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """rows: pack_id, capacity, bucket, room, a, b."""
    schema = "pack_id int, capacity long, bucket long, room long, a long, b long, bin long"
    return rows.repartition("pack_id", "bucket").sortWithinPartitions("pack_id", "bucket", *order).mapInArrow(_packer(limit), schema)


def pack_items(items: DataFrame, open_bins: int = 64, per_bucket: int = 50_000) -> DataFrame:
    """One row per piece of an item: pack_id, item_id, piece (0, 1, ...), room, container.

    items: pack_id int, item_id long, size long, capacity long (the same within a pack). An item without room (size NULL, 0 or less) gets
    one row with room 0 and no container; a capacity that is NULL or below 1 gives no container either, its pieces are the whole items.
    Repeated items and NULL ids are items of their own; ties fall to the bin opened last.
    """
    usable = (F.col("size") > 0) & (F.col("capacity") > 0)
    rows = items.select("pack_id", "item_id", F.coalesce("size", F.lit(0)).alias("size"), "capacity")
    none = rows.where(~F.coalesce(usable, F.lit(False))).select("pack_id", "item_id", F.lit(0).cast("long").alias("piece"), F.when(F.col("size") > 0, F.col("size")).otherwise(0).alias("room"), F.lit(None).cast("string").alias("container"))
    count = items.groupBy("pack_id").count().agg(F.max("count")).first()[0] or 0
    buckets = -(-count // per_bucket) or 1
    pieces = rows.where(usable).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("capacity")))).alias("piece"))
    pieces = pieces.select(
        "pack_id", F.col("capacity").cast("long").alias("capacity"), F.pmod(F.xxhash64("item_id", "size"), F.lit(buckets)).alias("bucket"),
        F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).cast("long").alias("room"), F.col("item_id").cast("long").alias("a"), F.col("piece").alias("b"),
    )
    first = stored(_packed(pieces, ["a", "b", "room"], open_bins))  # read twice: for the bins left open, and for all pieces
    again = -(-buckets * open_bins // per_bucket) or 1
    rest = first.where("room IS NULL").select("pack_id", "capacity", F.pmod(F.col("bucket"), F.lit(again)).alias("bucket"), F.col("a").alias("room"), F.col("bucket").alias("a"), F.col("bin").alias("b"))
    merged = _packed(rest, [F.col("room").desc(), "a", "b"], open_bins).where("room IS NOT NULL")
    merged = merged.select("pack_id", F.col("a").alias("bucket"), F.col("b").alias("bin"), F.concat(F.lit("m"), F.col("bucket"), F.lit("."), F.col("bin")).alias("moved"))
    placed = first.where("room IS NOT NULL").join(merged, ["pack_id", "bucket", "bin"], "left")
    own = F.concat(F.lit("b"), F.col("bucket"), F.lit("."), F.col("bin"))
    return placed.select("pack_id", F.col("a").alias("item_id"), F.col("b").alias("piece"), "room", F.coalesce("moved", own).alias("container")).unionByName(none)
