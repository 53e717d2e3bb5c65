from __future__ import annotations

import random
import zlib

import pytest

from tallygrid.llm.sharding import best_fit, fewest_capacity, shard
from tests.llm.conftest import documents


def test_best_fit_takes_the_tightest_bin():
    # 6 and 5 open bins of 10; 4 fits both and goes to the tighter; 3 to the other.
    assert best_fit([6, 5, 4, 3], 10, 2) == [0, 1, 0, 1]
    assert best_fit([6, 6, 6], 10, 2) is None
    assert best_fit([25, 5, 5], 10, 2) == [0, 1, 1]


def test_capacity_is_close_to_the_equal_share():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(2_000)), reverse=True)
    bins = fewest_capacity(sizes, 7)
    totals = [sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(7)]
    assert max(totals) - min(totals) <= 100
    assert fewest_capacity([], 3) == []


@pytest.mark.parametrize("hot", [1, 300])
def test_shards(spark, hot):
    rng = random.Random(5)
    texts = ["w" * rng.randint(0, 400) + str(i) for i in range(900)] + ["copy " * 9] * hot
    texts += [None, "", None, "é" * 3_000]
    rows = shard(documents(spark, texts), 6).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    of_text, slots, totals = {}, {}, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert of_text.setdefault(data, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
    assert len(totals) == 6 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(totals.values()) - min(totals.values()) < 8_000


def test_nothing_and_repeated_rows(spark):
    assert shard(documents(spark, []), 4).count() == 0
    twice = documents(spark, ["x", None]).unionAll(documents(spark, ["x", None]))
    rows = shard(twice, 4).collect()
    assert len(rows) == 4
    assert shard(twice.selectExpr("cast(null as bigint) doc_id", "text"), 4).count() == 4
