from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallygrid.llm import pitman_yor as py
from tallygrid.llm import seating
from tests.llm.conftest import documents


def exact(c, base, discount, strength, others):
    """P(t | c) by counting all ways to seat c customers at t tables."""
    ways = {1: 1.0}
    for n in range(1, c):
        more = Counter()
        for t, w in ways.items():
            more[t] += w * (n - discount * t)
            more[t + 1] += w
        ways = more
    weight = {t: w * math.prod((strength + discount * (others + i)) * base for i in range(t))
              for t, w in ways.items()}
    return {t: w / sum(weight.values()) for t, w in weight.items()}


@pytest.mark.parametrize("direct", [64, 3])
def test_seatings_follow_their_conditional(monkeypatch, direct):
    """Drawn from all weights, or by a walk that they accept: the same distribution."""
    monkeypatch.setattr(seating, "EXACT", direct)
    monkeypatch.setattr(seating.stirling, "__defaults__", (direct,))
    n, c = 4_000, 12
    draw = seating.Seating(np.full(n, c), np.arange(n), 0.5, 1.0, np.random.default_rng(1),
                           other_tables=4.0)
    for _ in range(30 if direct < c else 1):
        draw.sweep(np.full(n, 0.2))
    want = exact(c, 0.2, 0.5, 1.0, 4.0)
    found = Counter(draw.tables.tolist())
    for t, p in want.items():
        assert found[t] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 2e-3)


def test_predictions_add_up_to_one():
    rng = np.random.default_rng(2)
    rooms = np.repeat(np.arange(5), 20)
    customers = rng.integers(1, 300, 100)
    base = rng.dirichlet(np.ones(25))
    dishes = np.tile(np.arange(20), 5)
    seats = seating.Seating(customers, rooms, 0.8, 1.0, rng)
    for _ in range(3):
        seats.sweep(base[dishes])
    guests = np.bincount(rooms, customers)
    p = np.bincount(rooms, seats.predictive(base[dishes], guests))
    rest = base[20:].sum() * (1.0 + 0.8 * seats.totals()) / (1.0 + guests)
    assert np.allclose(p + rest, 1.0)


def test_stirling_numbers_of_many_customers():
    for d in (0.5, 0.8):
        table = seating.stirling(d, 64)
        t = np.arange(1, 65.0)
        found = seating.log_stirling(np.full(64, 64.0), t, d)
        assert np.abs(found - table[64, 1:]).max() < 0.09


def test_log_gamma():
    x = np.array([0.1, 0.5, 1.0, 3.7, 8.0, 55.5, 1e7])
    assert np.allclose(seating.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_parent_adds_up_to_one():
    plan = py.Plan(3, np.array([], np.uint64))
    served = np.array([[9, 4, 1, 1], [7, 5, 1, 1]])
    tables = np.array([[2, 1, 1, 1], [3, 2, 1, 1]])
    rows = [SimpleNamespace(root=r, c=np.array(
        [20 - r, 4 if r == 0 else 0, *(served.sum(axis=1) * (r == 0)), *(tables.sum(axis=1) * (r == 0))],
        np.int64).tobytes()) for r in range(3)]

    class Reply:
        def __init__(self, found):
            self.found = found

        def filter(self, condition):
            return Reply(rows if condition == "shard = -1" else [])

        def select(self, *names):
            return self

        def collect(self):
            return [vars(r) for r in self.found]

    parent = py.Parent(Reply(rows), plan)
    for k in range(2):
        known = parent.base(served[k], tables[k], k).sum()
        assert known + parent.unknown[k] == pytest.approx(1.0)
        assert parent.mass[k].sum() + parent.unknown[k] == pytest.approx(1.0)


def corpus(seed=3, n=250):
    rng = random.Random(seed)
    nouns = [f"n{i}" for i in range(40)]
    text = lambda: " ".join(f"the {rng.choice(nouns)} {rng.choice(['is', 'was'])}"
                            for _ in range(rng.randint(1, 20)))
    return [text() for _ in range(n)] + [None, "", "The THE unheard", "na " * 9_000]


@pytest.mark.parametrize("shard_bytes", [10_000_000, 4_000])
def test_scores(spark, monkeypatch, shard_bytes):
    """One shard, and many with hot contexts split: counts exact, predictions better."""
    monkeypatch.setattr(py, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(py, "BLOCK_TOKENS", 2_000)
    texts = corpus()
    docs = documents(spark, texts).withColumn("score", F.lit("clash")).repartition(3)
    if shard_bytes < 5_000:
        assert len(py.hot_contexts(docs.select("doc_id", "text"), 10)) > 0
    rows = py.score(docs).collect()
    assert len(rows) == len(texts)
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total = sum(counts.values())
    sums = {True: [0.0, 0.0], False: [0.0, 0.0]}
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[r["doc_id"]], len(own), sum(w in counts for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
        if r["doc_id"] < 250:
            sums[r["held_out"]][0] += r["score"]
            sums[r["held_out"]][1] += r["base_score"]
    assert sums[True][0] > 0.7 * sums[True][1] and sums[False][0] > 0.7 * sums[False][1]


def test_hot_contexts_stay_one_restaurant(spark, monkeypatch):
    """Split over shards, a hot context predicts known and unknown words as in one shard."""
    monkeypatch.setattr(py, "BLOCK_TOKENS", 3_000)
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(3_000)]
    text = lambda: " ".join(
        f"{rng.choice(['the', 'the', 'a'])} {rng.choice(rare[:rng.choice([30, 3_000])])}"
        for _ in range(40))
    held = [i for i in range(4_000) if py.held_out(i)][300:302]
    texts = [text() for _ in range(400)]
    asked = documents(spark, ["the unheard " * 20], held[0]).unionAll(
        documents(spark, ["the r3 " * 20], held[1]))
    docs = documents(spark, texts).unionAll(asked).repartition(3)
    found = {}
    for size in (10_000_000, 12_000):
        monkeypatch.setattr(py, "SHARD_BYTES", size)
        found[size] = {r["doc_id"]: r["score"] / r["n_tokens"] for r in py.score(docs).collect()}
    whole, split = found.values()
    for i in held:
        assert split[i] == pytest.approx(whole[i], abs=0.05)
    assert sum(split.values()) == pytest.approx(sum(whole.values()), rel=0.01)


def test_shards_answer_only_for_documents_with_pairs(spark, monkeypatch):
    """Sums are rows of documents, no more than pairs, not arrays over a block in every shard."""
    sent = []
    add_up = py.documents
    monkeypatch.setattr(py, "documents", lambda sums: sent.append(sums) or add_up(sums))
    monkeypatch.setattr(py, "SHARD_BYTES", 100)
    texts = [f"x{i} y{i}" for i in range(300)]
    found = py.score(documents(spark, texts).coalesce(1))
    assert {r["n_tokens"] for r in found.collect()} == {3} and found.count() == 300
    assert not any(t == "binary" or t.startswith("array") for _, t in sent[0].dtypes)
    assert sent[0].count() <= 300 * 4  # three pairs and the document itself


def test_some_ids_are_null(spark):
    """NULL ids beside others."""
    docs = documents(spark, ["a b c", "d e", None, "a c"]).coalesce(1)
    some = docs.withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    rows = py.score(some).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["0", "2", "3", "None"]
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {0: 4, None: 3, 2: 1, 3: 3}


def test_nothing_to_learn_from(spark):
    assert py.score(documents(spark, [])).count() == 0
    held = [i for i in range(60) if py.held_out(i)][:2]
    rows = py.score(documents(spark, ["a b"], held[0])).collect()
    assert (rows[0]["n_known"], rows[0]["train_tokens"]) == (0, 0)
    assert rows[0]["score"] == rows[0]["base_score"] == 0.0
    twice = documents(spark, ["a b", None]).unionAll(documents(spark, ["a b"]))
    assert py.score(twice).count() == 3
    nameless = twice.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert not any(r["held_out"] or r["doc_id"] for r in py.score(nameless).collect())


@pytest.mark.parametrize("bits", [64, 0])
def test_a_block_counts_its_pairs_and_their_documents(monkeypatch, bits):
    monkeypatch.setattr(py, "KEY_BITS", bits)
    texts = ["a b a b a", None, "", "b a", "a " * 300, "c", "a b a b a"]
    block, wanted = py._Block(), Counter()
    for i, text in enumerate(texts):
        block.add(i, text)
        chain = py._chain(text).tolist()
        wanted.update((v, w, i) for v, w in zip(chain, chain[1:], strict=False))
    v, w, documents, place, times = block.counted()
    pairs = list(zip(v.tolist(), w.tolist(), strict=True))
    assert pairs == sorted(set(pairs)) and len(place) == documents.sum()
    found = {(*pairs[i], p): n for i, p, n in zip(
        np.repeat(np.arange(len(pairs)), documents), place.tolist(), times.tolist(), strict=True)}
    assert found == wanted


def test_the_parent_does_not_depend_on_the_number_of_classes(spark):
    """Its tables stay within sampling noise, however its words are dealt."""
    customers = 1 + np.random.default_rng(4).zipf(1.5, 3_000).clip(max=2_000)
    found = []
    for number in (1, 40):
        rows = [(r, len(customers[r::number]),
                 bytearray(np.stack([customers[r::number]] * py.SAMPLES).astype(np.int64).tobytes()))
                for r in range(number)]
        classes = spark.createDataFrame(rows, "root int, known bigint, customers binary")
        known, whole = py._parent_tables(classes, 7)
        assert known == len(customers) and (whole[:, 0] == known).all()
        found.append(whole[:, -1].mean())
    assert abs(found[0] / found[1] - 1) < 0.03


def test_shards_answer_a_block_with_one_row(spark, monkeypatch):
    """However many documents share a shard, it sends a row for each block; blocks add them up."""
    answers, calls = [], []
    add_up, log_gamma = py._add_up, seating.log_gamma

    def seen(part):
        return add_up(part).assign(n_known=len(part))

    monkeypatch.setattr(py, "documents", lambda sums: answers.append(sums) or sums)
    monkeypatch.setattr(py, "_add_up", seen)
    monkeypatch.setattr(py, "SHARD_BYTES", 800)
    texts = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(400)]
    rows = py.score(documents(spark, texts).coalesce(1)).collect()
    shards = -(-sum(len(t) for t in texts) // 800)
    assert len(rows) == 400 and shards > 8
    assert {r["n_known"] for r in rows} == {shards}  # here the rows of the one block
    monkeypatch.setattr(seating, "log_gamma", lambda x: calls.append(1) or log_gamma(x))
    seating.log_stirling(np.full(30, 500.0), np.full(30, 9.0), 0.8)
    assert len(calls) <= 4  # not two for each term


def test_the_series_is_that_of_single_terms(monkeypatch):
    """The same sums, however many dishes are taken at once."""
    c, t, d = np.array([64.0, 70, 900, 1e5]), np.array([3.0, 45, 1, 700]), 0.6
    found = []
    for dishes in (1, 3, 100):
        monkeypatch.setattr(seating, "SERIES_DISHES", dishes)
        found.append(seating._by_series(c, t, d))
    want = []
    for n, m in zip(c, t, strict=True):
        terms = [(-1) ** (j + math.floor(-d * j)) * math.exp(
            math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)
            + math.lgamma(n - d * j) - math.lgamma(n - d) - math.lgamma(-d * j))
            for j in range(1, seating.TERMS) if j <= m and n > d * j and (3 * j) % 5]
        want.append(math.log(sum(terms)) + math.lgamma(n - d) - math.lgamma(m + 1)
                    - m * math.log(d))
    for one in found:
        assert np.allclose(one, want, rtol=1e-8)


def test_shuffles_are_deleted_when_a_table_is_stored(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, during, keep = spark.conf.get(name), [], py.kept
    monkeypatch.setattr(py, "kept", lambda df: during.append(spark.conf.get(name)) or keep(df))
    table = py.stored(spark.range(50).repartition(4, "id"))
    assert during == ["true"] and spark.conf.get(name) == before and table.count() == 50


def test_tables_that_are_used_up_are_deleted(spark, monkeypatch):
    """The reports of step 1 lie on disk no longer than the parent needs them."""
    tables, keep = [], py.kept
    monkeypatch.setattr(py, "kept", lambda df: tables.append(keep(df)) or tables[-1])
    monkeypatch.setattr(py, "SHARD_BYTES", 2_000)
    found = py.score(documents(spark, corpus()))
    files = [f for f in tables[0].inputFiles() if os.path.exists(f.removeprefix("file:"))]
    assert tables[0].inputFiles() and not files and found.count() == len(corpus())


def test_values_are_numbered_in_order():
    x = np.array([7, 2**63, 7, 0, 2**64 - 1], np.uint64)
    for found, want in zip(py._numbered(x), np.unique(x, return_inverse=True), strict=True):
        assert np.array_equal(found, want)
    assert [len(y) for y in py._numbered(x[:0])] == [0, 0]


def test_sorted_contexts_are_numbered():
    assert py._rooms(np.array([3, 3, 5, 9, 9], np.uint64)).tolist() == [0, 0, 1, 2, 2]
    assert len(py._rooms(np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize("room", [8, -56])
def test_pairs_of_a_shard_are_sorted_as_one_number(monkeypatch, room):
    """In the order of contexts and words, also where a number has no room for a word."""
    monkeypatch.setattr(py, "WORD_ROOM", room)
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    rng = np.random.default_rng(8)
    for contexts in (1, 2, 500):
        names, words = (rng.integers(0, 2**56, n).astype(np.uint64) for n in (contexts, 300))
        rows = [(np.sort(rng.choice(names, 400)), rng.choice(words, 400)) for _ in range(3)]
        v, w, order = py._pairs([py._pack_runs(v) for v, _ in rows], [py._pack(w) for _, w in rows])
        sent = [np.concatenate(x) for x in zip(*rows, strict=True)]
        assert (v == sent[0][order]).all() and (w == sent[1][order]).all()
        pairs = list(zip(v.tolist(), w.tolist(), strict=True))
        assert pairs == sorted(pairs) and sorted(order.tolist()) == list(range(1_200))
    assert bool(sorts) == (room < 0)
    empty = py._pairs([py._pack_runs(names[:0])], [b""])
    assert [len(x) for x in empty] == [0, 0, 0]


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    """Word by word the same hashes; only words of more than 16 bytes go to the library."""
    texts = [" the  THE\tÄb \x0b eight_by nine_byte", None, "", " \n", "x\x00 x \x1c \x85", "y",
             *(" ".join("q" * k + w for k in range(40)) for w in ("a", "Zz", "é"))]
    calls, digest = [], xxhash.xxh3_64_intdigest
    want = [py._chain(t) for t in texts]
    monkeypatch.setattr(xxhash, "xxh3_64_digest", None)
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(len(w)) or digest(w))
    for column in (pa.array(texts), pa.array(["cut", *texts])[1:], pa.array(texts, pa.large_string())):
        found = py._chains(column)
        assert len(found) == len(want)
        assert all(np.array_equal(a, b) for a, b in zip(found, want, strict=True))
    assert calls and min(calls) > 16


@pytest.mark.parametrize("size", [1, 40, 10**9])
def test_blocks_do_not_depend_on_the_pieces_of_text(monkeypatch, size):
    monkeypatch.setattr(py, "PIECE_BYTES", size)
    monkeypatch.setattr(py, "BLOCK_TOKENS", 30)
    texts = ["a b c", None, "", "word " * 50, "d", " e f " * 9, None]
    ids = [1, None, 3, 4, 5, 6, 7]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(texts[a:b], pa.string())],
                                          ["doc_id", "text"]) for a, b in ((0, 0), (0, 5), (5, 7))]
    blocks = list(py._blocks(iter(batches)))
    assert [i for b in blocks for i in b.ids] == ids
    assert [b.size for b in blocks] == [5 + 2 + 2 + 52, 3 + 20 + 2]
    chains = [c for b in blocks for c in b.chains]
    assert all(np.array_equal(c, py._chain(t)) for c, t in zip(chains, texts, strict=True))


def test_steps_of_a_walk_share_the_series(monkeypatch):
    """What depends on customers alone is computed once, not in every step."""
    terms, series = [], seating.series
    monkeypatch.setattr(seating, "series", lambda c, d: terms.append(len(c)) or series(c, d))
    seats = seating.Seating(np.full(50, 500), np.arange(50), 0.8, 1.0, np.random.default_rng(1))
    for _ in range(2):
        seats.sweep(np.full(50, 0.01))
    assert terms == [50, 50]
    c, t = np.array([70.0, 900, 900, 1e7]), np.array([60.0, 2, 880, 3])
    assert np.array_equal(seating.log_stirling(c, t, 0.6),
                          seating.log_stirling(c, t, 0.6, series(c, 0.6)))
