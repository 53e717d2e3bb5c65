from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm.packing import Packer
from tallygrid.llm.queries.op4 import RANKS, TOKENIZER, pieces
from tests.llm.conftest import documents


def test_windows_are_full_powers_of_two_and_cover_every_token_once():
    rng = random.Random(0)
    for _ in range(300):
        packer = Packer()
        sizes = [rng.choice([1, 5, 256, 257, 1500, 2048, 2049, 5000, rng.randint(1, 3000)])
                 for _ in range(rng.randint(0, 12))]
        windows = []
        for doc, size in enumerate(sizes):
            windows += packer.add(doc, size)
            if rng.random() < 0.3:
                windows += packer.pack()
        windows += packer.flush()
        seen = set()
        for size, runs in windows:
            assert sum(r[2] for r in runs) == size <= 2048 and size & (size - 1) == 0
            tokens = {(d, k) for d, s, n in runs for k in range(s, s + n)}
            assert len(tokens) == size and not tokens & seen
            seen |= tokens
        assert len(seen) == sum(sizes)


def test_pieces_hold_the_tokenizers_ids(spark):
    texts = [None, "", "word", "two words", "café <|endoftext|> end", "long text " * 3_000,
             "two words"]
    docs = documents(spark, texts).withColumn("offset", F.lit("clash"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
           for t in texts]
    rows = sorted(pieces(docs).collect(), key=lambda r: (r["doc_id"], r["start"]))
    at = {i: 0 for i in range(len(texts))}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        part = own[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        at[r["doc_id"]] += r["length"]
    assert [at[i] for i in at] == [len(x) for x in ids]
    by_window = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by_window.get(r["sequence_id"], 0)
        by_window[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n & (n - 1) == 0 for n in by_window.values())
    assert pieces(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb", "  x y", "'ll 'LL ²١", "\x00\n\n "])
def test_both_tokenizer_files_agree(text):
    from tallygrid.llm.packing import Tokens
    fast = Tokens(TOKENIZER, RANKS, public_tokenizers.PATTERN)
    slow = Tokens(TOKENIZER, None, "")
    assert fast(text).tolist() == slow(text).tolist()
