"""Merkle fixity audit of archive copies.

A record is the leaf of a tree: its digest covers its place and its bytes.  Above the leaves,
each level hashes the ordered digests of an offset range that is ``2^FAN_BITS`` times as wide,
up to one root per archive file.  Two copies are compared root by root; only under roots that
differ are the next ranges compared, and so on down to the records.  The trees are written
once to the checkpoint folder, so the descent reads digests, never the records again; as files,
whose small ones are read together, for a level has few nodes in many partitions.

A node hashes at most ``2^FAN_BITS`` ranges, and a lowest range holds at most
``2^LEAF_BITS / smallest record`` records, so no task gathers an unbounded group, however
large an archive file is.

Defined cases: a NULL payload is hashed apart from an empty one; records with a NULL archive
form an archive of their own, with a NULL offset a range of their own; records that repeat in
the same place are hashed as one list of sorted digests, and reported once with their number;
an empty copy makes every record of the other one missing; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAF_BITS = 16  # lowest ranges are 64 KiB of offsets
FAN_BITS = 4  # each range above is 16 times as wide
LEVELS = 4  # the widest ranges below the root are 256 MiB


def content_digest(payload: Column) -> Column:
    """SHA-256 of a record's bytes; NULL apart from empty."""
    return F.when(payload.isNull(), F.sha2(F.lit(b"\x00null"), 256)).otherwise(
        F.sha2(payload.cast("binary"), 256)
    )


def records(
    df: DataFrame, archive: Column, offset: Column, length: Column, content: Column
) -> DataFrame:
    """Leaves of a copy, one row per place, from the ``content_digest`` of its records."""
    own = F.sha2(
        F.concat_ws("|", F.coalesce(archive.cast("string"), F.lit("-")),
                    F.coalesce(offset.cast("string"), F.lit("-")), content), 256)
    leaves = df.select(
        archive.alias("archive"), offset.cast("bigint").alias("offset"),
        length.cast("bigint").alias("length"), own.alias("digest"),
    )
    return leaves.groupBy("archive", "offset").agg(
        F.max("length").alias("length"), F.count("*").alias("n"),
        F.when(F.count("*") == 1, F.max("digest")).otherwise(
            F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256)
        ).alias("digest"),
    )


def _range_digest(order: Column, digest: Column) -> Column:
    """Digest of the digests below, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order.alias("o"), digest.alias("d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), ""), 256)


def tree(leaves: DataFrame) -> DataFrame:
    """Nodes ``(archive, level, span, digest)``; level 0 ranges of offsets, the root on top."""
    span = F.shiftright("offset", LEAF_BITS)
    level = leaves.groupBy("archive", span.alias("span")).agg(
        _range_digest(F.col("offset"), F.col("digest")).alias("digest")
    )
    nodes = level.withColumn("level", F.lit(0))
    for k in range(1, LEVELS):
        level = level.groupBy("archive", F.shiftright("span", FAN_BITS).alias("span")).agg(
            _range_digest(F.col("span"), F.col("digest")).alias("digest")
        )
        nodes = nodes.unionByName(level.withColumn("level", F.lit(k)))
    root = level.groupBy("archive").agg(
        _range_digest(F.col("span"), F.col("digest")).alias("digest")
    )
    return nodes.unionByName(
        root.select("archive", F.lit(0).cast("bigint").alias("span"), "digest",
                    F.lit(LEVELS).alias("level"))
    )


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that only one side has."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return a.join(b, condition, "full").filter(
        ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
    ).select(
        # A key of a missing side is NULL, so the other side's stands for both.
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        F.col("a.digest").alias("digest"), F.col("b.digest").alias("other_digest"),
        *[F.col(f"{s}.{c}").alias(f"{p}{c}") for s, p in (("a", ""), ("b", "other_"))
          for c in ("length", "n") if c in left.columns],
    )


def _under(nodes: DataFrame, parents: DataFrame, span: Column) -> DataFrame:
    """Nodes that lie under one of the differing parents."""
    p = parents.select(F.col("archive").alias("_archive"), F.col("span").alias("_span"))
    return nodes.join(
        p, F.col("archive").eqNullSafe(F.col("_archive")) & span.eqNullSafe(F.col("_span")),
        "left_semi",
    )


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Places where two copies (leaves from ``records``) differ.

    ``(archive, offset, length, other_length, digest, other_digest, fault)``, where ``fault``
    is ``changed``, ``missing`` (in the second copy) or ``extra``.
    """
    leaves = [stored(x) for x in (first, second)]
    trees = [stored(tree(x)) for x in leaves]
    def nodes(level: int) -> list[DataFrame]:
        return [t.filter(F.col("level") == level).drop("level") for t in trees]

    # Every list of suspects is small and read twice, so it is cut off from its making.
    suspect = stored(_differing(*nodes(LEVELS), ["archive", "span"]))
    for k in range(LEVELS - 1, -1, -1):
        # The topmost ranges, also that of NULL offsets, hang on the root.
        parent = F.lit(0).cast("bigint") if k == LEVELS - 1 else F.shiftright("span", FAN_BITS)
        level = [_under(t, suspect, parent) for t in nodes(k)]
        suspect = stored(_differing(*level, ["archive", "span"]))
    at = F.shiftright("offset", LEAF_BITS)
    found = _differing(*[_under(x, suspect, at) for x in leaves], ["archive", "offset"])
    return found.select(
        "archive", "offset", "length", "other_length", "digest", "other_digest",
        F.when(F.col("other_digest").isNull(), "missing")
        .when(F.col("digest").isNull(), "extra").otherwise("changed").alias("fault"),
    )
