"""Best-fit-decreasing sharding of indivisible groups of documents.

Groups are rows of equal text.  They are never listed whole: every group falls into one of
a fixed number of bundles by the hash of its text, and only groups larger than a stated
share of a shard are items of their own, of which there are few by their size.  The items,
bounded in number whatever the input, are placed by best fit in decreasing size: a sorted
tree of remaining capacities gives the tightest shard that still holds the item.  The smallest
capacity that needs no more than the wanted number of shards is found by bisection, which
makes the shards near equal.  Only an item larger than an equal share gets a fuller shard.

The rows then meet their items' shard numbers in an equi-join with that bounded table, and
slots are counted in two steps, per slice of a shard and over the slices' counts, so no task
holds a whole shard or a hot group.

Defined cases: a NULL text weighs like an empty one and equals it; NULL and repeated ids are
kept, rows that are equal in every respect take their slots in any order; an empty table
gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bundles of small groups per shard; also the share of a shard from which a group is large.
BUNDLES_PER_SHARD = 256
# Slices per shard in which slots are counted.
SLICES = 1024
ROW_BYTES = 8


def best_fit(sizes: list[int], capacity: int, limit: int) -> list[int] | None:
    """Bin of each item (``sizes`` fall), or None if more than ``limit`` bins are needed.

    ``room`` keeps (remaining capacity, bin) in order; the first entry that is not below the
    size is the tightest fit.  An item above the capacity gets a bin of its own.
    """
    room: list[tuple[int, int]] = []
    bins, used = [], 0
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            if used == limit:
                return None
            left, chosen = max(capacity, size), used
            used += 1
        bins.append(chosen)
        insort(room, (left - size, chosen))
    return bins


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """Best fit under the smallest capacity, found by bisection, that ``shards`` bins suffice for."""
    if not sizes:
        return []
    low, high = 1, sum(sizes)  # an item above the equal share lowers the share of the rest
    found = best_fit(sizes, high, shards)
    while low < high:
        middle = (low + high) // 2
        bins = best_fit(sizes, middle, shards)
        if bins is None:
            low = middle + 1
        else:
            found, high = bins, middle
    return found


def shard(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, item)``: equal texts share a shard."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit("")).cast("binary")
    bundles = shards * BUNDLES_PER_SHARD
    rows = docs.select(
        F.col(doc_id).alias("_id"),
        (F.octet_length(value) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(value).alias("_group"),
    ).withColumn("_bundle", F.pmod("_group", F.lit(bundles)))

    # Only groups of the heaviest bundles can be large: a bundle holds its groups.
    weights = {
        r["_bundle"]: r["w"] for r in rows.groupBy("_bundle").agg(F.sum("size").alias("w")).collect()
    }
    large = -(-sum(weights.values()) // bundles)
    heavy = [b for b, w in weights.items() if w > 2 * large]
    apart: dict[int, tuple[int, int]] = {}
    if heavy:
        groups = (
            rows.filter(F.col("_bundle").isin(heavy))
            .groupBy("_group", "_bundle")
            .agg(F.sum("size").alias("w"))
            .filter(F.col("w") > large)  # at most `bundles` groups can be that large
        )
        apart = {r["_group"]: (r["_bundle"], r["w"]) for r in groups.collect()}
    for bundle, weight in apart.values():
        weights[bundle] -= weight

    items = [(w, "g", g) for g, (_, w) in apart.items()]
    items += [(w, "b", b) for b, w in weights.items() if w]
    items.sort(key=lambda item: (-item[0], item[1], item[2]))
    placed = fewest_capacity([w for w, *_ in items], shards)
    of_item = [(kind, key, bin_) for (_, kind, key), bin_ in zip(items, placed, strict=True)]
    by_bundle = spark.createDataFrame(
        [(k, b) for kind, k, b in of_item if kind == "b"], "_bundle bigint, _by_bundle int"
    )
    by_group = spark.createDataFrame(
        [(k, b) for kind, k, b in of_item if kind == "g"], "_group bigint, _by_group int"
    )
    # Both tables have at most `bundles` rows.
    placed_rows = (
        rows.join(F.broadcast(by_group), "_group", "left")
        .join(F.broadcast(by_bundle), "_bundle", "left")
        .select(
            F.col("_id").alias(doc_id), "size", "text_crc32",
            F.coalesce("_by_group", "_by_bundle").alias("shard"),
            F.when(F.col("_by_group").isNotNull(), F.col("_group"))
            .otherwise(F.col("_bundle")).alias("item"),
        )
    )
    return with_slots(placed_rows, doc_id)


def with_slots(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``slot``, counted from 0 without gaps in each shard."""
    slice_ = F.pmod(F.xxhash64(doc_id, "text_crc32", "size"), F.lit(SLICES)).cast("int")
    sliced = rows.withColumn("_slice", slice_)
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per shard and slice: at most SLICES rows in a window.
    offsets = (
        sliced.groupBy("shard", "_slice").agg(F.count("*").alias("_rows"))
        .select("shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_slice").orderBy(doc_id, "size", "text_crc32")
    return (
        sliced.withColumn("_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "_slice"])
        .withColumn("slot", (F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_slice", "_in", "_before")
    )
