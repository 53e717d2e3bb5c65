"""The periodic runs of all documents, a tenth of which repeat themselves from some word on."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..periodic_runs import periodic_runs, sha256

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period",
                                                   "exponent_milli")]
FIELDS += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
FIELDS += [T.StructField(n, T.LongType()) for n in ("n_words", "n_dropped")]


def planted(words: list[bytes], row: tuple) -> list[bytes]:
    """Where the id's hash ends in 0, the text repeats its words from some word on.

    A document without an id is left as it is.
    """
    n = len(words)
    h = 1 if row[0] is None else crc32(str(row[0]).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def digest(measured: tuple) -> tuple:
    n_words, starts, lengths, periods, n_dropped, collapsed = measured
    found = list(zip(starts, lengths, periods, strict=True))
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in found).encode()
    longest: tuple = (None,) * 4
    if found:
        a, b, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        longest = (a, b, q, 1000 * b // q)
    return len(found), *longest, sha256(lines), sha256(collapsed), n_words, n_dropped


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, change=planted, digest=digest, digest_fields=FIELDS)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
