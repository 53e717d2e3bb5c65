from __future__ import annotations

import random

import pytest

from tallygrid.llm import ngram_join
from tallygrid.llm.components import components
from tests.llm.conftest import documents


def sets_of(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(texts, n, num, den):
    sets, parent = [sets_of(t, n) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and den * shared >= num * (len(a) + len(sets[j]) - shared):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(sets[i]), root(i)) for i in range(len(texts))]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(60))
    texts += [f"{shared} {word()} {word()}" for _ in range(25)]
    texts += [f"{word()} {word()} {word()} {word()} {word()} {word()} {shared}" for _ in range(5)]
    texts += ["very long " + " ".join(word() for _ in range(20_000))]
    return texts + texts[10:14]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_components_equal_brute_force(spark, n, num, den):
    texts = corpus()
    rows = ngram_join.jaccard_components(documents(spark, texts), n, num, den).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, n, num, den)


def test_long_lists_and_few_frequent_ngrams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 7)
    texts = corpus(2)
    rows = ngram_join.jaccard_components(documents(spark, texts), 4, 85, 100).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 85, 100)


def test_one_of_each_group_stays(spark):
    texts = corpus(3)
    docs = documents(spark, texts)
    kept = ngram_join.keep_one(docs.unionAll(docs.filter("doc_id = 3")))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({c for _, c in brute(texts, 5, 4, 5)})
    assert kept.columns == docs.columns


def test_empty_table_and_null_ids(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    nameless = documents(spark, ["a b c d e f g"] * 2).selectExpr("cast(null as bigint) doc_id", "text")
    assert ngram_join.jaccard_components(nameless).count() == 2


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got) == 61 + 301
    assert all(c == (0 if n <= 60 else 1000) for n, c in got.items())


def test_large_group_of_near_copies(spark):
    """Copies with few to many changes: some meet only the middle, some one another, some none."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
        if i % 5 == 0:
            copy = copy[: rng.randint(120, 150)]
        texts.append(" ".join(copy))
        if i % 7 == 0:  # a copy of a copy
            copy[rng.randrange(len(copy))] = f"y{i}"
            texts.append(" ".join(copy))
    rows = ngram_join.jaccard_components(documents(spark, texts), 4, 85, 100).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    want = brute(texts, 4, 85, 100)
    assert [got[i] for i in range(len(texts))] == want
    assert 3 < len({c for _, c in want}) < len(texts) - 50


def test_rows_with_the_same_id_or_none_are_kept_by_their_texts(spark):
    plain = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    rows = [(1, plain[0]), (1, plain[1]), (1, plain[1]), (2, plain[1]), (None, plain[0]),
            (None, plain[2]), (None, plain[3]), (None, plain[3]), (7, None), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'x' AS _row", "'y' AS key")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert got == sorted([(1, plain[0]), (1, plain[1]), (0, plain[2]), (0, plain[3]),
                          (7, ""), (7, ""), (8, " ")])
