"""Minimax contiguous partition of atomic groups into shards.

Rows with equal texts form an atomic group. Groups stand in the order of a
64-bit hash of their text, and a shard is a run of that order. The capacity
is the smallest for which a greedy pass fits all groups into the shards; it is
found by binary search. Of all the cuts that hold the capacity, each cut is
put as near as it goes to its even share, so shards are near equal on both
sides of the mean.

The search runs over sums, not rows. The first sums are by the top bits of
the hash; then only those ranges in which a cut of some still possible
capacity may fall are summed again by more bits, until single groups are left
there. So each pass brings a bounded number of sums to the driver, at
any size of the input, and the cuts are exact. Shards are then assigned by
comparing hashes with the cuts, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, fresh, stored

#: Sums that one pass brings to the driver at most.
SUMS = 50_000
#: Cells for counting slots: CELLS ranges of the hash by SALTS parts of each.
CELLS, SALTS = 256, 64


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (in elements) of shards that are filled as far as capacity allows; None if the elements don't fit. prefix starts with 0."""
    ends, at = [], 0
    for _ in range(shards):
        if at < len(prefix) - 1:
            to = bisect_right(prefix, prefix[at] + capacity) - 1
            if to == at:
                return None
            at = to
        ends.append(at)
    return ends if at == len(prefix) - 1 else None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    prefix = [0, *accumulate(sizes)]
    low, high = max([0, -(-prefix[-1] // shards), *sizes]), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """shards-1 cuts (in elements), each as near to its even share as the capacity allows."""
    prefix = [0, *accumulate(sizes)]
    n, total = len(sizes), prefix[-1]
    back = [n - x for x in reversed(greedy([0, *accumulate(reversed(sizes))], capacity, shards)[:-1])]
    cuts, at = [], 0
    for k in range(1, shards):
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        near = bisect_right(prefix, k * total // shards) - 1
        if near < n and prefix[near + 1] + prefix[near] < 2 * k * total / shards:
            near += 1
        at = min(max(near, back[k - 1], at), most)
        cuts.append(at)
    return cuts


def _zones(sizes: list[int], single: list[bool], shards: int) -> list[int]:
    """Elements that aren't single groups and in which a cut may fall once they are split."""
    prefix = [0, *accumulate(sizes)]
    total, largest = prefix[-1], max([0, *(s for s, one in zip(sizes, single, strict=True) if not one)])
    high = smallest_capacity(sizes, shards)
    low = max(high - largest, -(-total // shards))
    found: set[int] = set()

    def mark(a: int, b: int) -> None:
        first, last = max(0, bisect_right(prefix, a) - 2), min(len(sizes) - 1, bisect_right(prefix, b))
        found.update(i for i in range(first, last + 1) if not single[i])

    at_low = 0
    for k in range(1, shards):  # from the left, from the right, and around the even shares
        at_low = max(k * low - 2 * k * largest, 0)
        mark(at_low, min(k * high + largest, total))
        mark(max(total - (shards - k) * high - largest, 0), min(total - (shards - k) * low + 2 * (shards - k) * largest, total))
        mark(k * total // shards - largest, k * total // shards + largest)
    return sorted(found)


def minimax_cuts(rows: DataFrame, shards: int, key: str = "h", size: str = "size", first_bits: int = 14, most: int = SUMS) -> list[int]:
    """Keys at which shards 1 to shards-1 begin, for rows with a 64-bit key and a size. A cut beyond the last key is 2**63. No pass brings more than most sums to the driver."""

    def sums(bits: int, within: DataFrame) -> list[tuple]:
        by = F.shiftright(key, 64 - bits).alias("p") if bits < 64 else F.col(key).alias("p")
        found = within.groupBy(by).agg(F.sum(size).alias("s"), F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n")).collect()
        return [(r.a, r.b, r.s, r.n, bits) for r in found]

    parts = sorted(sums(min(first_bits, most.bit_length() - 1), rows))
    while True:
        sizes, single = [p[2] for p in parts], [p[0] == p[1] for p in parts]
        zone = _zones(sizes, single, shards)
        if not zone:
            break
        # parts of equal depth, the largest first: they make the zones wide
        bits = min(parts[i][4] for i in zone)
        todo = sorted((i for i in zone if parts[i][4] == bits), key=lambda i: -sizes[i])[: max(1, most // 8)]
        more = 64 if sum(parts[i][3] for i in todo) <= most else min(64, bits + (most // len(todo)).bit_length() - 1)
        inside = f"shiftright({key}, {64 - bits}) IN ({', '.join(str(parts[i][0] >> (64 - bits)) for i in todo)})"
        drop = set(todo)
        parts = sorted([p for i, p in enumerate(parts) if i not in drop] + sums(more, rows.filter(inside)))
    cuts = even_cuts(sizes, shards, smallest_capacity(sizes, shards)) if parts else [0] * (shards - 1)
    return [parts[c][0] if c < len(parts) else 1 << 63 for c in cuts]


def minimax_shards(df: DataFrame, shards: int = 40, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard added; such columns of df itself are replaced.

    size is the UTF-8 length of the text plus 16; a null text has length 0 and
    goes with the empty ones. Rows with equal texts share a shard, so a group
    larger than the even share sets the capacity. Rows that are alike in all
    columns get slots of their own. With fewer groups than shards some shards
    stay empty; an empty table gives no rows. The order of slots is by range
    of the hash, then by part, hash and id (nulls first).
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = df.drop(*made)
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ("h", "cell", "part", "before")
    own = dict(zip(names, fresh([*kept.columns, *made], *(f"_{c}" for c in names)), strict=True))
    rows = kept.select("*", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias(own["h"]))
    sums = stored(rows.select(F.col(own["h"]).alias("h"), "size"), "sizes")
    cuts = minimax_cuts(sums, shards)
    shard = sum((F.when(F.col(own["h"]) >= c, 1).otherwise(0) for c in cuts if c < 1 << 63), F.lit(0))
    rows = rows.withColumns({"shard": shard.cast("int"), own["cell"]: F.shiftright(own["h"], 56).cast("int"), own["part"]: F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(SALTS)).cast("int")})
    cell = ["shard", own["cell"], own["part"]]
    # at most (CELLS + shards) * SALTS counts, whatever the input
    counts = rows.groupBy(*cell).agg(F.count("*").alias(own["before"]))
    before = counts.select(*cell, (F.sum(own["before"]).over(W.partitionBy("shard").orderBy(*cell[1:])) - F.col(own["before"])).alias(own["before"]))
    within = F.row_number().over(W.partitionBy(*cell).orderBy(own["h"], id_col))
    out = rows.withColumn("slot", within.cast("long")).join(F.broadcast(before), cell)
    out = out.withColumns({"slot": F.col("slot") - 1 + F.col(own["before"]), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*kept.columns, *made)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
