"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
END = np.uint64(0xD6E8FEB86659FD93)  # stands for the end of a text


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Only a session on one machine that names none, as in tests, gets a temporary one; on a
    cluster, whose executors could not read it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(*columns: str) -> Column:
    """A 64-bit number that tells rows with different values of ``columns`` apart; NULL is a value."""
    parts = [p for k, c in enumerate(columns) for p in (F.lit(k), F.col(c))]
    return F.xxhash64(*parts)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    digests = b"".join(map(xxhash.xxh3_64_digest, words(text)))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX
        return h ^ (h >> np.uint64(29))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the whole as one run if there are fewer."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    count = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(count, size, np.uint64)
        for k in range(size):
            total = total * _MULTIPLIER + hashes[k : k + count]
    return mixed(total)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
