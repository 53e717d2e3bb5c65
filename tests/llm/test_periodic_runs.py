from __future__ import annotations

import hashlib
import random
import re
import time
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import periodic_runs as p
from tallygrid.llm.queries.op12 import op12_periodic_runs, planted
from tests.llm.conftest import documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, repeats=4, least=6):
    """Every stretch by its definition: maximal, smallest period, long enough."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words: list[int] = []
    for _ in range(rng.randint(0, 12)):
        base = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 9))]
        words += base * rng.randint(1, 7) + base[: rng.randint(0, len(base))]
        words += [rng.randint(0, 60) for _ in range(rng.randint(0, 8))]
    repeats, least = rng.choice([(4, 6), (4, 6), (3, 1), (3, 9), (5, 2)])
    assert p.runs(p.word_ids(words), repeats, least) == brute(words, repeats, least)


def test_splitting_leaves_nothing_of_prose_and_all_of_a_run():
    words = [f"w{i}" for i in range(500)]
    assert p.segments(p.word_ids(words)) == []
    words[100:140] = ["a", "b"] * 20
    assert p.segments(p.word_ids(words)) == [(100, 140)]
    # rare words split, and what they leave is counted anew
    nested = ["x", "y", "x", "y", "r1", "x", "y", "r2", "x", "y", *["z"] * 6]
    assert p.segments(p.word_ids(nested)) == [(10, 16)]


def test_long_texts_end():
    rng = np.random.default_rng(1)
    began = time.time()
    assert p.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    p.runs(rng.integers(0, 2, 60_000))
    period = rng.integers(0, 50, 3_000)
    assert (0, 120_000, 3_000) in p.runs(np.tile(period, 40))
    assert time.time() - began < 60


TEXTS = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a b " * 3, "A b a b a b a b",
         "x a b a b a b a b a y", "Straße\x0bStraße\x0c" * 4, "a b " * 7, "na " * 30_000]


def test_defined_cases(spark):
    docs = documents(spark, TEXTS).unionByName(documents(spark, [TEXTS[8]], 8))
    docs = docs.withColumn("n_words", F.lit("mine")).withColumn("starts", F.lit(None).cast("int"))
    rows = p.periodic_runs(docs, keep=("doc_id",)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        words = WORD.findall(TEXTS[r["doc_id"]] or "")
        found = list(zip(r["starts"], r["lengths"], r["periods"], strict=True))
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            assert found == brute(words)
        gone = {i for a, b, q in found for i in range(a + q, a + b)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["n_dropped"] == len(gone)
    assert rows[11]["collapsed"] == "na"
    assert p.periodic_runs(documents(spark, [])).count() == 0
    no_ids = documents(spark, TEXTS[:8]).withColumn("doc_id", F.lit(None).cast("long"))
    assert p.periodic_runs(no_ids).count() == 8
    with pytest.raises(ValueError):
        p.periodic_runs(docs, repeats=2)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % period] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    gone = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{b},{q}\n" for a, b, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_planted_words():
    words = [str(i) for i in range(30)]
    hit = next(i for i in range(1000) if crc32(str(i).encode()) % 10 == 0)
    miss = next(i for i in range(1000) if crc32(str(i).encode()) % 10)
    assert planted(words, (miss,)) == words and len(planted(words, (hit,))) == 30
    assert planted(words, (None,)) == words and planted([], (hit,)) == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no supplied tables")
def test_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    short = {k for k, t in texts.items() if len(WORD.findall(t or "")) < 1500}
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256")
    rows = op12_periodic_runs(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(short) > 100
    for r in rows:
        if r["doc_id"] in short:
            assert tuple(r[c] for c in names) == expected(r["doc_id"], texts[r["doc_id"]])
    assert any(r["n_runs"] for r in rows)
