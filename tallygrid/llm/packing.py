"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are routed to the smallest context tier that holds them; what exceeds the longest
tier fills whole windows of it.  Tiers are packed from the longest down: each document opens
a window of its tier, the gap takes the longest shorter documents that fit, and the last bit
of the gap is filled by the head of one more document.  The rest of a document goes back to
its tier.  What is left when a task ends is cut into windows of powers of two, so no window
is padded.  Windows of one tier are dealt into step groups that hold the same number of
tokens.

Every task packs its own rows, so there is no shuffle, and memory is bounded by one Arrow
batch and the few documents that wait.  A task that is run again packs the same rows alike.

Defined cases: a NULL or empty text is just its end id; a text of any length is cut into as
many windows as it takes; repeated rows are packed each for itself; an empty table gives no
pieces; columns other than the id and the text are not carried.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

TIERS = (256, 512, 1024, 2048)
# Windows of one step group hold this many windows of the longest tier, in tokens.
STEP_WINDOWS = 16
# Tokens gathered before they are packed together.
CHUNK_TOKENS = 1 << 22

FIELDS = [
    ("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()),
    ("step_group", T.LongType()), ("ids", T.BinaryType()),
]


class Tokens:
    """Texts to ids of a byte-level BPE file of the ``tokenizers`` library.

    The same vocabulary as ranks encodes several times faster with the same ids.  Texts that
    hold the string of a special token go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str):
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def _tokens(json_path: str, ranks_path: str | None, pattern: str) -> Tokens:
    return Tokens(json_path, ranks_path, pattern)


class Packer:
    """Packs runs of (document, start, length) into windows; cuts where a gap asks for it."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]

    def _route(self, length: int) -> int:
        return next(k for k, tier in enumerate(self.tiers) if length <= tier)

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Route a document; whole windows of the longest tier leave at once."""
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            yield longest, [(doc, start, longest)]
            start += longest
        if start < length:
            self._wait(doc, start, length - start)

    def _wait(self, doc: int, start: int, length: int) -> None:
        insort(self.waiting[self._route(length)], (length, doc, start))

    def _fitting(self, below: int, gap: int) -> tuple[int, int, int] | None:
        """The longest waiting run of at most ``gap`` tokens in the tiers up to ``below``."""
        for k in range(min(below, self._route(gap)), -1, -1):
            at = bisect_right(self.waiting[k], (gap, 1 << 62, 1 << 62))
            if at:
                return self.waiting[k].pop(at - 1)
        return None

    def _any(self, upto: int) -> tuple[int, int, int] | None:
        for k in range(upto, -1, -1):
            if self.waiting[k]:
                return self.waiting[k].pop()
        return None

    def pack(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows from the waiting runs; less than a window's tokens stay waiting."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            total = sum(r[0] for runs in self.waiting[: k + 1] for r in runs)
            while self.waiting[k] and total >= size:
                length, doc, start = self.waiting[k].pop()
                window, gap = [(doc, start, length)], size - length
                while gap:
                    found = self._fitting(k, gap)
                    if found is None:
                        length, doc, start = self._any(k)
                        self._wait(doc, start + gap, length - gap)
                        found = gap, doc, start
                    window.append((found[1], found[2], found[0]))
                    gap -= found[0]
                total -= size
                yield size, window

    def flush(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What still waits, in windows of falling powers of two."""
        yield from self.pack()
        runs = [(d, s, n) for tier in reversed(self.waiting) for n, d, s in reversed(tier)]
        left = sum(r[2] for r in runs)
        while left:
            size, window = min(1 << (left.bit_length() - 1), self.tiers[-1]), []
            gap = size
            while gap:
                doc, start, length = runs[0]
                take = min(gap, length)
                window.append((doc, start, take))
                runs[0] = (doc, start + take, length - take)
                if take == length:
                    runs.pop(0)
                gap -= take
            left -= size
            yield size, window
        self.waiting = [[] for _ in self.tiers]


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    ranks: str | None = None,
    pattern: str = "",
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id``, its place in the document and in its window, its ids.

    ``ids`` are little-endian unsigned 32-bit.  ``tier`` is the window's length and
    ``step_group`` groups windows of a tier whose tokens add up to ``STEP_WINDOWS`` longest
    windows.  ``ranks`` is the same vocabulary as a rank file, for speed.
    """
    source = docs.select(doc_id, text)
    id_field = source.schema[doc_id]
    schema = T.StructType([id_field, *[T.StructField(n, t) for n, t in FIELDS]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens(tokenizer_json, ranks, pattern)
        packer = Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, np.ndarray]] = {}
        next_doc = sequences = gathered = 0
        per_tier: dict[int, int] = {}
        rows: list[tuple] = []
        id_type = None

        def take(windows) -> None:
            nonlocal sequences
            for size, window in windows:
                at, seen = 0, per_tier.get(size, 0)
                per_tier[size] = seen + 1
                group = base + (size << 26) + seen // max(1, STEP_WINDOWS * tiers[-1] // size)
                for doc, start, length in window:
                    key, ids = held[doc]
                    rows.append((key, start, length, len(ids), base + sequences, at, size, group,
                                 ids[start:start + length].tobytes()))
                    at += length
                sequences += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) + 1)
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                     pa.int32(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[doc_id, *[n for n, _ in FIELDS]],
            )
            rows.clear()
            return out

        def settle() -> None:
            """Drop documents of which nothing waits."""
            waiting = {r[1] for runs in packer.waiting for r in runs}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]

        for batch in batches:
            id_type = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end_id))
                held[next_doc] = (key, ids)
                take(packer.add(next_doc, len(ids)))
                next_doc += 1
                gathered += len(ids)
                if gathered >= CHUNK_TOKENS:
                    take(packer.pack())
                    settle()
                    yield batch_of()
                    gathered = 0
        take(packer.flush())
        if rows:
            yield batch_of()

    return source.mapInArrow(work, schema)
