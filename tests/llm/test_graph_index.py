from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallygrid.llm.graph_index import nearest, robust_prune, usable


def table(spark, values):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], i % 3)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(1_500, 16)).astype(np.float32)
    values[200:260] = values[7]  # copies of one vector
    exact = values.astype(np.float64)
    vectors = usable(table(spark, values))
    queries = vectors.filter("vec_id % 50 = 0 OR vec_id = 7")
    rows = nearest(vectors, queries, 10, shard_rows=400).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        d = np.sqrt(((exact[r["query_id"]] - exact[r["vec_id"]]) ** 2).sum())
        assert r["score"] == np.float64(d) or abs(r["score"] - d) < 1e-12
        assert r["query_id"] != r["vec_id"]
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = 0
    for q, own in found.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hits += len(set(order) & {i for _, i in own})
        assert own == sorted(own) and len(own) == 10
    assert hits / (10 * len(found)) >= 0.9
    assert [i for _, i in found[7]] == list(range(200, 210))


def test_what_takes_no_part(spark):
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    vectors = usable(table(spark, [*bad, [1.0, 2.0], [1.0, 2.5], [1.0, 2.0, 3.0]]))
    assert sorted(r["vec_id"] for r in vectors.collect()) == [6, 7, 8]
    rows = nearest(vectors, vectors, 10).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == {
        (6, 1, 7, 0.5), (7, 1, 6, 0.5)}
    assert nearest(vectors.filter(F.lit(False)), vectors, 3).count() == 0
    assert nearest(vectors, vectors.filter(F.lit(False)), 3).count() == 0


def test_pruning_keeps_diverse_neighbours():
    line = np.array([[0.0], [1.0], [1.1], [-1.0]])
    kept = robust_prune(line, np.array([0]), [np.array([1, 2, 3])], 1.2, 4)
    assert kept[0].tolist() == [1, 3, -1, -1]
