from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallygrid.llm import byte_bpe
from tallygrid.llm.byte_bpe import PrefixTable, _encoder, decode, encode
from tests.llm.conftest import documents

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "aAéß '\n\t\x1c\x85 ​　١²½__!?漢\U0001f642\x00'sll've  "


@pytest.fixture(scope="module")
def own():
    return _encoder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def peer(own):
    return tiktoken.Encoding("peer", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ranks,
                             special_tokens={})


def some(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_encoding_and_appending_equal_the_library(own, peer):
    rng = random.Random(1)
    for _ in range(3_000):
        text, more = some(rng, 30), some(rng, 10)
        ids = own.encode(text)
        assert ids == peer.encode_ordinary(text)
        assert own.append(text, ids, more) == peer.encode_ordinary(text + more)
        assert own.decode(ids) == text.encode()


def test_edits_refill_only_what_changes(own):
    rng = random.Random(2)
    letters = b"abcdethe in"
    pick = lambda n: bytes(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        data, new = pick(700), pick(rng.randint(0, 6))
        table = PrefixTable(own.vocabulary, data)
        assert table.ids() == own.vocabulary.merged(data)
        start = rng.randint(0, 300)
        stop = start + rng.randint(0, 5)
        filled = table.edit(start, stop, new)
        whole = PrefixTable(own.vocabulary, data[:start] + new + data[stop:])
        assert table.last == whole.last and filled < 400


def test_two_tokens_follow_each_other_if_their_bytes_are_encoded_so(own):
    rng, size = random.Random(3), len(own.vocabulary.tokens)
    common = [own.vocabulary.ranks[x] for x in (b"a", b"aa", b"aaaa", b" the", b"th", b"e", b"in")]
    pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(4_000)]
    pairs += [(a, b) for a in common for b in common]
    for _ in range(2_000):  # a token cut in two, so that a merge across the seam is likely
        data = own.vocabulary.tokens[rng.randrange(256, size)]
        at = rng.randint(0, len(data))
        if data[:at] in own.vocabulary.ranks and data[at:] in own.vocabulary.ranks:
            pairs.append((own.vocabulary.ranks[data[:at]], own.vocabulary.ranks[data[at:]]))
    for left, right in pairs:
        whole = own.vocabulary.tokens[left] + own.vocabulary.tokens[right]
        assert own.vocabulary.follows(left, right) == (own.vocabulary.merged(whole) == [left, right])


def test_pieces_asked_for_again_stay_and_the_bound_holds(own, peer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    known = byte_bpe.Pieces(own.vocabulary)
    for n in range(100):
        for piece in ("often", f"once{n}"):
            assert np.frombuffer(known[piece], np.int32).tolist() == peer.encode_ordinary(piece)
        assert len(known) <= 10 and len(known.older) <= 10
        assert "often" in known or "often" in known.older


def test_lists_are_decoded_alike_in_any_parts(own, peer):
    lists = [[15496], None, [], [995, 0], None, [11, 11, 13]]
    wanted = [None if x is None else peer.decode_bytes(x) for x in lists]
    column = pa.array(lists, pa.list_(pa.int32()))
    for size in (1, 2, 4, 6):
        parts = [own.decoded(column.slice(at, size)) for at in range(0, len(lists), size)]
        assert pa.concat_arrays(parts).to_pylist() == wanted


def test_whole_tables(spark, peer):
    texts = [None, "", "  ", "Hello world", "na" * 40_000, "<|endoftext|> x", "Hello world"]
    docs = documents(spark, texts).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = decode(encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == peer.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert encode(documents(spark, []), RANKS, PATTERN).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert decode(nothing, RANKS, PATTERN).first()["decoded"] is None
    some = [(0, [15496]), (1, None), (2, []), (3, [995, 0])]
    lists = spark.createDataFrame(some, "k int, ids array<int>").coalesce(1)
    found = {r["k"]: r["decoded"] for r in decode(lists, RANKS, PATTERN).collect()}
    assert found == {k: None if v is None else peer.decode_bytes(v) for k, v in some}


def test_half_a_million_pieces_are_remembered(monkeypatch):
    asked = []
    monkeypatch.setattr(byte_bpe.Pieces, "_encoded", lambda self, data: asked.append(data) or b"")
    known = byte_bpe.Pieces(None)
    for i in [*range(500_000), 0]:
        known[str(i)]
    assert len(asked) == 500_000 and len(known) + len(known.older) <= byte_bpe.REMEMBERED + 1
