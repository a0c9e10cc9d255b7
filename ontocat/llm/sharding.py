"""Sharding by a minimax contiguous partition. Built-in functions only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontocat.llm.common import free_name

SHARDS = 40
#: Atomic groups: documents by a hash of their whole text, so equal texts are always in one group.
GROUPS = 16_384
#: Parts of a shard that are numbered independently.
CELLS = 512
ROW_BYTES = 16


def fits(sizes: list[int], shards: int, capacity: int) -> bool:
    """Whether filling shards greedily in order needs no more than ``shards`` of ``capacity``."""
    used, room = 1, capacity
    for size in sizes:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
        room -= size
    return used <= shards


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity that fits, by binary search."""
    low, high = max(max(sizes, default=0), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if fits(sizes, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """Ends of the shards (exclusive group numbers): none above the least capacity, each near what is left on average.

    Greedy filling up to the capacity alone would leave the last shards empty
    when one large group sets the capacity. So each shard ends nearest the
    average of the rest, but never above the capacity and never so early that
    the rest would not fit.
    """
    capacity = least_capacity(sizes, shards)
    sums = [0, *accumulate(sizes)]
    need = [0] * (len(sizes) + 1)  # shards that the groups from here on need
    for at in range(len(sizes) - 1, -1, -1):
        need[at] = 1 + need[bisect_right(sums, sums[at] + capacity) - 1] if sums[at] < sums[-1] else 0
    ends, at = [], 0
    for left in range(shards, 0, -1):
        aim = sums[at] + (sums[-1] - sums[at]) / left
        end = max(bisect_left(sums, aim, at), at)
        if end > at and sums[end - 1] > sums[at] and aim - sums[end - 1] < sums[end] - aim:
            end -= 1  # but never to an empty shard before a large group
        end = min(end, bisect_right(sums, sums[at] + capacity) - 1)
        while need[end] > left - 1:
            end += 1
        at = len(sizes) if left == 1 else end
        ends.append(at)
    return ends


def group_of(doc_id: Column, text: Column, groups: int = GROUPS) -> Column:
    """The atomic group of a row: equal texts share one; null texts are spread by id."""
    return F.pmod(F.coalesce(F.when(text.isNotNull(), F.xxhash64(text)), F.xxhash64(doc_id)), F.lit(groups)).cast("int")


def shard_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    groups: int = GROUPS, cells: int = CELLS, out: str = "placed") -> DataFrame:
    """``docs`` with a struct column ``out``: size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text plus 16. The text hash deals all rows into
    ``groups`` ordered atomic groups whose sizes are summed by Spark; these at
    most 16,384 sums, whatever the input, are partitioned into contiguous
    shards of the least possible largest size. Equal texts are thus in one
    shard (law ``bytes``: sizes near equal, as far as a group of copies larger
    than a shard allows).

    Slots: rows of a shard are numbered within ``cells`` parts by id hash, and
    each part starts where the one before ends, so neither a hot group nor a
    whole shard is sorted in one task. Order inside a part: id, then text
    checksum; rows equal in both are interchangeable. No text is shuffled unless
    the caller keeps the text column.

    Null texts have size 16 and no checksum and are spread by id; null ids are
    numbered first in their part. Repeated rows get slots of their own. Empty
    input gives no rows. Other columns are kept; one called ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    in_part, start, rank = (free_name(docs, n) for n in ("_part", "_start", "_rank"))
    key, body = docs[doc_id], docs[text]
    rows = docs.select(*kept, F.struct(
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.crc32(body.cast("binary"))), F.lit(cells)).cast("int").alias("cell"),
        group_of(key, body, groups).alias("g")).alias(out))

    def item(name: str) -> Column:
        return F.col(f"{out}.{name}")

    sums = dict(rows.groupBy(item("g").alias("g")).agg(F.sum(item("size")).alias("s")).collect())  # at most `groups` rows
    ends = cut_points([sums.get(g, 0) for g in range(groups)], shards)
    shard = sum([F.when(item("g") >= end, 1).otherwise(0) for end in ends[:-1]], F.lit(0))
    keys = rows.select(shard.alias("shard"), item("cell").alias("cell"))
    counts = keys.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most shards x cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.struct("shard", "cell").alias(in_part),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    part = F.struct(shard.alias("shard"), item("cell").alias("cell"))
    placed = rows.select(*[rows[c] for c in kept], rows[out], part.alias(in_part))
    within = Window.partitionBy(in_part).orderBy(placed[doc_id], item("text_crc32"), item("size"))
    numbered = placed.withColumn(rank, F.row_number().over(within)).join(F.broadcast(starts), in_part)
    return numbered.select(*[numbered[c] for c in kept], F.struct(
        item("size").alias("size"), item("text_crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col(f"{in_part}.shard").alias("shard"), (F.col(start) + F.col(rank) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard")).alias(out))
