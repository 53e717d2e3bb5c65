"""Similarity join of documents on the Jaccard index of their word n-gram sets.

Every set is put into one global order, rare n-grams first.  Two sets that are similar enough
share an n-gram within their prefixes, so only prefixes are joined.  A pair that meets there
still has to pass the length filter, the positional filter (what can still follow both
positions) and the suffix filter (both sets are counted in fixed ranges of the n-gram space,
and no more can be shared than the smaller count of each range).  What passes is compared
by members cut to 16 bits, and what still passes exactly, once.

Equal sets form one class first; only one document of a class is joined.  The answer are the
components of the links, so pairs that are connected already need no link of their own:
short posting lists give all their pairs, long ones first only the pairs with their most
central member, the one with the fewest n-grams of its own; members of different components
are then paired in a second round, once per pair.  No pair of different components is left out.

The frequencies behind "rare first" are counted over all documents: blocks of n-grams report
those that occur often within the block, the reports are added up, and the most frequent are
ordered last by their number.  The order decides how many candidates there are, not which
links are found.

Defined cases: texts without words, NULL texts among them, have an empty set and are linked
with nothing; rows that repeat an id are one node; a NULL id gives a component of its own;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import row_key, sequence_hashes, stored, unused, word_hashes
from .components import components

BLOCK = 2_000_000  # n-grams counted together
OFTEN = 3  # occurrences within a block that are reported
FREQUENT = 1 << 18  # n-grams ordered by their number, a broadcast of 4 MB
RANGES = 64  # ranges of the suffix filter
ASKED_BITS = 1 << 26  # bits of the map of documents to compare, 8 MB
SHORT_LIST = 8  # members of a posting list that is paired in full at once


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of word n-grams, as ascending hashes."""
    return np.unique(sequence_hashes(word_hashes(text), n))


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of all documents, ascending by hash, and their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            values, number = np.unique(np.concatenate(held), return_counts=True)
            often = number >= OFTEN
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(number[often].astype(np.int64))],
                names=["h", "c"],
            )

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), n))
                size += len(held[-1])
                if size >= BLOCK:
                    yield report()
                    size = 0
        if held:
            yield report()

    top = (
        docs.select("text").mapInArrow(count, "h bigint, c bigint")
        .groupBy("h").agg(F.sum("c").alias("c"))
        .orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    )
    top = top.assign(h=top["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    return top["h"].to_numpy(np.uint64), top["c"].to_numpy(np.int64)


def _prefix(values: np.ndarray, frequent: np.ndarray, number: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` of a set in the order (frequency, hash)."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        often = np.where(frequent[at] == values, number[at], 0)
        return values[np.lexsort((values, often))[:keep]]
    return values[:keep]


def signatures(docs: DataFrame, n: int, num: int, den: int, frequent, number) -> DataFrame:
    """``(doc_id, n_shingles, set_hash, prefix, ranges)`` of every document."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((frequent, number))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            sizes, digests, prefixes, ranges = [], [], [], []
            for text in batch.column(1):
                values = shingles(text.as_py(), n)
                size = len(values)
                sizes.append(size)
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                least = -(-num * size // den)  # a partner shares at least as many
                prefixes.append(_prefix(values, *order, size - least + 1 if size else 0))
                spread = np.bincount((values >> np.uint64(58)).astype(np.int64), minlength=RANGES)
                ranges.append(np.minimum(spread, 65535).astype(np.uint16).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate([*prefixes, np.array([], np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array(ranges, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "prefix", "ranges"],
            )

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
        T.StructField("set_hash", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("ranges", T.BinaryType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _possible(num: int, den: int) -> Column:
    """Length and positional filter on two list rows ``x`` (the smaller set) and ``y``.

    What both share before this n-gram lies in both prefixes, so in lists: at most ``sh`` each.
    """
    nx, ny = F.col("x.n"), F.col("y.n")
    before = F.least(F.col("x.sh"), F.col("y.sh"))
    after = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    # shared >= num/den * union  <=>  shared * (num + den) >= num * (nx + ny)
    return (den * nx >= num * ny) & ((before + after) * (num + den) >= num * (nx + ny))


def _placed_well(num: int, den: int, px: Column, py: Column, nx: Column, ny: Column) -> Column:
    """Is enough left after the first shared n-gram?  Nothing is shared before it."""
    return F.least(nx - px, ny - py) * (num + den) >= num * (nx + ny)


def _suffix_filter(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose counts per range leave room for enough shared n-grams."""
    side = lambda c: reps.select(
        F.col("rep").alias(c), F.col("ranges").alias(f"r{c}"), F.col("n").alias(f"n{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            read = lambda c: np.frombuffer(
                b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, RANGES).astype(np.int64)
            ra, rb = read("ra"), read("rb")
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # A count at the top of its type says nothing about its range.
            room = np.where((ra == 65535) | (rb == 65535), 1 << 40, np.minimum(ra, rb)).sum(axis=1)
            keep = pa.array(room * (num + den) >= num * both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    return wide.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(work, schema)


def _short(values: np.ndarray) -> np.ndarray:
    """The last 16 bits of every member: a quarter of a set, equal for equal members."""
    return np.sort((values & np.uint64(0xFFFF)).astype(np.uint16))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two ascending lists share, repeated ones as often as in both."""
    (ux, cx), (uy, cy) = (np.unique(v, return_counts=True) for v in (x, y))
    _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    return int(np.minimum(cx[ix], cy[iy]).sum())


def _verify(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs that are similar enough, by comparing their whole sets.

    Members cut to 16 bits are compared first.  They share no fewer than the members do, so what
    falls short there is dropped, and whole sets travel for little more than the links.
    """
    return _compared(docs, _compared(docs, pairs, n, num, den, True), n, num, den, False)


def _compared(
    docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, short: bool
) -> DataFrame:
    """The pairs whose sets, whole or ``short``, share enough."""
    pairs = stored(pairs)
    # A bit map of fixed size tells the documents whose sets are asked for, so that texts
    # are never shuffled; a set that is sent without need meets no pair.
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ASKED_BITS))
    words = (
        pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
        .groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {ASKED_BITS}) & 63 AS int))"))
             .alias("bits"))
    ).toArrow()
    bits = np.zeros(ASKED_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    ids = docs.schema["doc_id"]
    kind = np.uint16 if short else np.uint64

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64)
            asked = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(asked.astype(bool)))
            sets = (shingles(t.as_py(), n) for t in batch.column(1))
            sets = [(_short(v) if short else v).tobytes() for v in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("ia"), batch.column("ib"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), kind) for v in (left, right))
                shared = _shared(x, y)
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    sets = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", bit.alias("bit")).mapInArrow(
        to_sets, T.StructType([ids, T.StructField("items", T.BinaryType())]))
    wide = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), "a")
    )
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    return wide.select("a", "b", "ia", "ib").mapInArrow(compare, schema)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents linked at ``num / den`` or more.

    ``component_id`` is the smallest id that links lead to, the document's own included.
    """
    docs = docs.select("doc_id", "text")
    frequent, number = frequent_shingles(docs, n)
    signed = stored(signatures(docs, n, num, den, frequent, number))
    reps = (
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
             F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"))
    )
    reps = stored(reps)
    listed = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = listed.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1")
    # A prefix is as long as a set may differ, so this window sorts one short list a document.
    earlier = Window.partitionBy("rep").orderBy("pos")
    lists = stored(listed.join(shared, "gram").withColumn(
        "sh", (F.row_number().over(earlier) - 1).cast("int")))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of one list that pass the length and positional filter, smaller set first."""
        return x.alias("x").join(y.alias("y"), "gram").filter(
            F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")).filter(_possible(num, den))

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(
            F.min("x.pos").alias("px"), F.min("y.pos").alias("py"),
            F.first("x.n").alias("nx"), F.first("y.n").alias("ny"))

    # First round: short lists in full, long ones against their most central member, the one
    # with the fewest n-grams of its own, and of those the largest.
    short, long_ = lists.filter(F.col("members") <= SHORT_LIST), lists.filter(
        F.col("members") > SHORT_LIST)
    central = F.struct((F.col("pos") - F.col("sh")).alias("own"), (-F.col("n")).alias("size"),
                       "rep", "n", "pos", "sh")
    heads = long_.groupBy("gram").agg(F.min(central).alias("h")).select(
        "gram", "h.rep", "h.n", "h.pos", "h.sh")
    met = pairs_of(joined(short, short)).unionByName(pairs_of(joined(heads, long_))).unionByName(
        pairs_of(joined(long_, heads)))
    first = met.groupBy("a", "b").agg(
        F.min("px").alias("px"), F.min("py").alias("py"),
        F.first("nx").alias("nx"), F.first("ny").alias("ny"),
    ).filter(_placed_well(num, den, *map(F.col, ("px", "py", "nx", "ny")))).select("a", "b")
    slim = reps.select("rep", "n", "ranges")
    first = stored(_suffix_filter(first, slim, num, den))
    links = stored(_verify(docs, first, n, num, den))
    found = components(links)

    # Second round: long lists whose members are in several components still.  A pair is made
    # in the first such list that both are in.  If they share an n-gram before it, that is of
    # a short list, and the first round judged the pair, or of a list that lies in one component.
    placed = long_.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.join(mixed.select("gram"), "gram", "left_semi").withColumn(
        "grams", F.collect_list("gram").over(before)))
    second = joined(placed, placed).filter(
        (F.col("x.component") != F.col("y.component"))
        & _placed_well(num, den, *map(F.col, ("x.pos", "y.pos", "x.n", "y.n")))
        & ~F.arrays_overlap("x.grams", "y.grams")
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).join(
        first, ["a", "b"], "left_anti")
    second = _verify(docs, _suffix_filter(second, slim, num, den), n, num, den)
    found = components(links.unionByName(second))

    classes = signed.groupBy("set_hash").agg(F.min("doc_id").alias("rep")).join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "n_shingles", "set_hash").join(
        classes, "set_hash", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of every component: the one of the smallest id.

    Rows are told apart by a 64-bit key of id and text, so rows that repeat an id with other
    texts, and rows without an id, are documents of their own; an id comes before none, and
    the key decides between equal ids.  Of rows equal in id and text any one stays.  Rows
    without words all stay.  Columns pass whatever their names.
    """
    (row,) = unused(docs, "_row")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).withColumn(row, row_key("doc_id", "text"))
    found = stored(jaccard_components(
        keyed.select(F.col(row).alias("doc_id"), "text"), n, num, den).select(
        F.col("doc_id").alias("key"), "component_id").distinct())
    # Components of several texts, with the ids of their rows: numbers only.
    several = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = found.join(several, "component_id", "left_semi").join(
        keyed.select(F.col(row).alias("key"), "doc_id").distinct(), "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    members = stored(members.select("key", "component_id", order.alias("place")))
    first = members.groupBy("component_id").agg(F.min("place")["key"].alias("key"))
    away = members.select("key").join(first, "key", "left_anti").select(F.col("key").alias(row))
    # Equal rows are folded before the shuffle; the join keeps their partitioning.
    once = keyed.dropDuplicates([row]).join(away, row, "left_anti")
    return once.select(*docs.columns).unionByName(docs.filter(~worded))
