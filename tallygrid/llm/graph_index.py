"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt into shards of bounded size by the hash of their id, so copies of a frequent
vector spread evenly.  Each shard's distinct vectors form a directed graph: every vector's
greedy search through the graph so far proposes neighbours, and relaxed distance pruning keeps
a neighbour only if none kept before is nearer to it by the factor ``alpha``.  A query walks
every shard's graph with a beam; the shards' best are merged.  All rows are indexed.

Searches of a batch run in step as array operations.  A task holds one shard's index and one
block of queries, both bounded, whatever the number of vectors and queries.

Defined cases: vectors that are NULL, empty, all zero, or hold NULL, NaN or infinite
components take no part, nor do rows without an id; vectors are only compared with vectors of
their own length; copies are all found, ties go to the smaller id; rows that repeat an id are
one candidate each; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 4096
QUERY_BLOCK = 4096
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 256


def _squared(graph_vectors: np.ndarray, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of ``points[i]`` to the vectors ``ids[i, :]``."""
    return ((graph_vectors[ids] - points[:, None, :]) ** 2).sum(axis=2)


def beam_search(
    vectors: np.ndarray, graph: np.ndarray, entry: int, points: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nearest found ids and squared distances per point, and the ids each walk expanded."""
    m, n = len(points), len(vectors)
    ids = np.full((m, width), -1)
    far = np.full((m, width), np.inf)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, n + 1), bool)  # column n takes the padding
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    far[:, 0] = _squared(vectors, ids[:, :1], points)[:, 0]
    walked: list[list[np.ndarray]] = []
    while True:
        # Rows are kept in order of distance, so the first open entry is the nearest.
        open_ = ~done
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break
        at = open_[active].argmax(axis=1)
        node = ids[active, at]
        done[active, at] = True
        walked.append([active, node])
        near = graph[node]
        slot = np.where(near < 0, n, near)
        fresh = (near >= 0) & ~seen[active[:, None], slot]
        seen[active[:, None], slot] = True
        d = np.where(fresh, _squared(vectors, np.where(near < 0, 0, near), points[active]), np.inf)
        all_far = np.concatenate([far[active], d], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        pick = lambda a: np.take_along_axis(a, order, axis=1)
        far[active] = pick(all_far)
        ids[active] = pick(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1))
        done[active] = pick(np.concatenate([done[active], ~fresh], axis=1))
    owner = np.concatenate([w[0] for w in walked])
    nodes = np.concatenate([w[1] for w in walked])
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, m))
    return ids, far, np.split(nodes[order], cuts)


def robust_prune(
    vectors: np.ndarray, nodes: np.ndarray, candidates: list[np.ndarray], alpha: float, degree: int
) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each node, padded with -1."""
    width = max(map(len, candidates))
    c = np.full((len(nodes), width), -1)
    for row, found in zip(c, candidates, strict=True):
        row[: len(found)] = found
    points = vectors[nodes]
    gathered = vectors[np.where(c < 0, 0, c)]
    d = ((gathered - points[:, None, :]) ** 2).sum(axis=2)
    d[(c < 0) | (c == nodes[:, None])] = np.inf
    kept = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    relax = alpha * alpha  # distances are squared
    for k in range(degree):
        best = d.argmin(axis=1)
        alive = np.isfinite(d[rows, best])
        if not alive.any():
            break
        kept[alive, k] = c[rows, best][alive]
        star = gathered[rows, best]
        to_star = ((gathered - star[:, None, :]) ** 2).sum(axis=2)
        d[relax * to_star <= d] = np.inf
        d[rows, best] = np.inf
    return kept


def build_graph(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbours of every vector, and where searches enter."""
    n = len(vectors)
    random = np.random.default_rng(seed)
    degree = min(DEGREE, max(n - 1, 1))
    graph = np.full((n, DEGREE), -1)
    if n > 1:
        graph[:, :degree] = (np.arange(n)[:, None] + random.integers(1, n, (n, degree))) % n
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    for alpha in (1.0, ALPHA):
        order = random.permutation(n)
        for start in range(0, n, BATCH):
            nodes = order[start : start + BATCH]
            _, _, walked = beam_search(vectors, graph, entry, vectors[nodes], BUILD_BEAM)
            found = [np.union1d(w, g[g >= 0]) for w, g in zip(walked, graph[nodes], strict=True)]
            graph[nodes] = robust_prune(vectors, nodes, found, alpha, DEGREE)
            # Each new edge also runs backwards; full lists are pruned again.
            to, source = graph[nodes].ravel(), np.repeat(nodes, DEGREE)
            source, to = source[to >= 0], to[to >= 0]
            if not len(to):
                continue
            by = np.argsort(to, kind="stable")
            targets, first = np.unique(to[by], return_index=True)
            full, lists = [], []
            for target, more in zip(targets, np.split(source[by], first[1:]), strict=True):
                own = graph[target][graph[target] >= 0]
                both = np.union1d(own, more)
                if len(both) <= DEGREE:
                    graph[target, : len(both)] = both
                else:
                    full.append(target)
                    lists.append(both)
            if full:
                graph[full] = robust_prune(vectors, np.array(full), lists, alpha, DEGREE)
    return graph, entry


def _build(part: pd.DataFrame) -> pd.DataFrame:
    """One row with the index of a shard."""
    part = part.sort_values("vec_id", kind="stable")
    rows = np.stack(part["vector"].to_numpy()).astype(np.float64)
    distinct, owner = np.unique(rows, axis=0, return_inverse=True)
    graph, entry = build_graph(distinct)
    return pd.DataFrame([{
        "shard": part["shard"].iloc[0], "dim": part["dim"].iloc[0], "entry": entry,
        "ids": part["vec_id"].to_numpy(np.int64).tobytes(),
        "owner": owner.astype(np.int32).tobytes(),
        "vectors": distinct.tobytes(), "graph": graph.astype(np.int32).tobytes(),
    }])


def _search(k: int):
    """Searches a block of queries in the index of a shard."""

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(asked):
            row = index.iloc[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
            graph = np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1)
            ids = np.frombuffer(row["ids"], np.int64)
            owner = np.frombuffer(row["owner"], np.int32)
            # Row ids of every distinct vector, ascending, as slices of one array.
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(vectors) + 1))
            for begin in range(0, len(asked), BATCH):
                block = asked.iloc[begin : begin + BATCH]
                points = np.stack(block["vector"].to_numpy()).astype(np.float64)
                near, far, _ = beam_search(
                    vectors, graph, int(row["entry"]), points, max(SEARCH_BEAM, 4 * k)
                )
                for query, nodes, d in zip(block["vec_id"], near, far, strict=True):
                    # k + 1 distinct vectors hold k rows besides the query's own, and of
                    # each vector's copies the k + 1 smallest ids are enough.
                    nodes = nodes[np.isfinite(d)][: k + 1]
                    for node, score in zip(nodes, np.sqrt(d), strict=False):
                        copies = ids[order[starts[node] : starts[node + 1]][: k + 1]]
                        copies = copies[copies != query]
                        out["query_id"] += [query] * len(copies)
                        out["vec_id"] += copies.tolist()
                        out["score"] += [score] * len(copies)
        return pd.DataFrame(out)

    return search


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, vector, dim)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
        .filter(~bad & F.exists(v, lambda x: x != 0))
        .select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"),
                F.size(v).alias("dim"))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found rows of every query.

    Both inputs come from ``usable``.  A row never finds its own id.
    """
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    index = (
        vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
        # The work is in the computing, not in the bytes: one partition per shard.
        .repartition(n_shards, "shard", "dim")
        .groupBy("shard", "dim")
        .applyInPandas(_build, "shard int, dim int, entry int, ids binary, owner binary, "
                               "vectors binary, graph binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    asked = queries.select(
        "vec_id", "vector", "dim",
        F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
    )
    found = (
        index.groupBy("shard", "dim", "block").cogroup(asked.groupBy("shard", "dim", "block"))
        .applyInPandas(_search(k), "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
