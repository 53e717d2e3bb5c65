"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding.  That
token is stored per prefix: token ``t`` ends prefix ``i`` if its bytes end there and it may
follow the stored last token of the prefix before it, that is, if encoding the two tokens'
bytes gives these two tokens again.  The encoding is read backwards from the last prefix.
The table makes appends exact (only new prefixes are filled in) and edits local (prefixes
after an edit are refilled until the table runs in step with the old one again).

Texts are first split by a pattern whose matches are encoded separately, without special
tokens.  The work per row is a small helper inside Arrow batches; rows are independent, so
there is no shuffle and a lost task is simply run again.

Defined cases: a NULL text encodes like an empty one, to no ids; very long texts are encoded
whole, in time linear in their length; NULL ids decode to NULL; an existing output column is
replaced and all others pass.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Encoded pieces remembered per Python worker; those not asked for lately are dropped beyond that.
REMEMBERED = 600_000
# Lists of ids that are decoded by one gather.
DECODED = 500


class Vocabulary:
    """Token bytes and ranks, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            self.tokens[rank] = data
        self._follows: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: the adjacent pair of lowest rank is merged first, leftmost on ties.

        Merges end at rank ``below``, if one is given.
        """
        below = len(self.tokens) if below is None else below
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)
            )
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, ...] | None:
        """The two tokens that a token is merged from; () for a byte, None if merging never gives it."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = tuple(self.merged(data, token)) if len(data) > 1 else ()
            self._halves[token] = parts if len(parts) in (0, 2) else None
        return self._halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens are encoded as these two.

        Both tokens' merges are undone from the last to the first.  At each step the parts at the
        seam must not have merged with each other before the merge that was just undone; at equal
        rank the left one comes first.
        """
        if len(self._follows) > REMEMBERED // 4:
            self._follows.clear()
        a, b, limit, known = left, right, len(self.tokens), None
        while known is None:
            of_a, of_b = self.halves(a), self.halves(b)
            if (
                of_a is None
                or of_b is None
                or self.ranks.get(self.tokens[a] + self.tokens[b], limit) < limit
            ):
                known = False
            elif of_a and (a > b or not of_b):
                limit, a = a, of_a[1]
            elif of_b:
                limit, b = b + 1, of_b[0]
            else:
                known = True
        self._follows[left, right] = known
        return known

    def fill(self, data: bytes, last: list[int], stop: int) -> None:
        """Extend ``last`` by the tokens that end the prefixes of up to ``stop`` bytes."""
        rank, known, longest = self.ranks.get, self._follows.get, self.longest
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if not start:
                    if self.halves(token) is None:
                        continue
                    break
                pair = known((last[start - 1], token))
                if pair or (pair is None and self.follows(last[start - 1], token)):
                    break
            else:
                raise ValueError("a byte of the text is no token of the vocabulary")
            last.append(token)


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.fill(self.data, self.last, len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start:stop``; the number of prefixes that were filled in anew."""
        old_last, old_size = self.last, len(self.data)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start]
        shift, same, filled = len(self.data) - old_size, 0, 0
        while len(self.last) < len(self.data):
            end = len(self.last) + 1
            self.vocabulary.fill(self.data, self.last, end)
            token = self.last[-1]
            filled += 1
            # A prefix depends on the `longest` ones before it and on as many bytes.
            old = end - shift
            unchanged = old > stop and token == old_last[old - 1]
            same = same + 1 if unchanged else 0
            if same >= self.vocabulary.longest:
                self.last.extend(old_last[old:])
                break
        return filled

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[self.last[end - 1]])
        return found[::-1]


class Pieces(dict):
    """Ids of pieces as 32-bit integers, found on first use; bounded in number and in size.

    When half of the bound is reached, what is held becomes the older half, from which pieces
    come back when they are asked for again; the half before it is dropped.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._encoded(piece.encode())
        if len(piece) <= 256:
            if len(self) >= REMEMBERED // 2:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[piece] = ids
        return ids

    def _encoded(self, data: bytes) -> bytes:
        whole = self.vocabulary.ranks.get(data)
        found = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
        return np.array(found, np.int32).tobytes()


class Encoder:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.known = Pieces(self.vocabulary)
        self.bytes = pa.array(self.vocabulary.tokens, pa.binary())

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """The ids of ``text + more`` from those of ``text``: only its last two pieces may change."""
        tail = self.pieces(text)[-2:]
        redo = "".join(tail)
        keep = len(ids) - sum(len(self.known[p]) // 4 for p in tail)
        return ids[:keep] + self.encode(redo + more)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def decoded(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of every list of ids: one gather of token bytes, cut at the lists' ends."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        taken = self.bytes.take(lists.flatten())
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
        ends = ends[np.cumsum([0, *sizes])].astype(np.int32)
        valid = None
        if lists.null_count:
            bits = np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
            valid = pa.py_buffer(bits.tobytes())
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(lists), [valid, pa.py_buffer(ends.tobytes()), data or pa.py_buffer(b"")],
            lists.null_count,
        )


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def _local(path: str) -> str:
    """The vocabulary file: a path present on every machine, or one shipped with ``addFile``."""
    return SparkFiles.get(path.removeprefix("files:")) if path.startswith("files:") else path


def _with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``df`` with ``ids`` (array<int>), the encoding of every whole text."""
    source = df.drop(ids) if ids != text else df

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(_local(ranks_path), pattern)
        for batch in batches:
            rows = [encoder.packed(t.as_py()) for t in batch.column(text)]
            offsets = (np.cumsum([0, *map(len, rows)]) // 4).astype(np.int32)
            values = np.frombuffer(b"".join(rows), np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            keep = [c for c in batch.schema.names if c != ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), column], names=[*keep, ids]
            )

    schema = _with_field(source, ids, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(work, schema)


def decode(
    df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", data: str = "decoded"
) -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of every list of ids."""
    source = df.drop(data)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(_local(ranks_path), pattern)
        for batch in batches:
            lists = batch.column(ids)
            parts = [encoder.decoded(lists.slice(at, DECODED))
                     for at in range(0, max(len(lists), 1), DECODED)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.concat_arrays(parts)],
                names=[*batch.schema.names, data],
            )

    return source.mapInArrow(work, _with_field(source, data, T.BinaryType()))
