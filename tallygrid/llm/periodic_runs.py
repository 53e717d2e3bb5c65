"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a maximal stretch of words with smallest period ``q`` whose length is at least
``repeats`` periods and ``least`` words.  Each word of a run occurs there once a period, so a
word that is rarer within its segment than the fewest occurrences a qualifying run gives it
cannot join one: it splits the segment, and the parts are counted anew until nothing splits
any more.  Ordinary prose falls apart at once.  In what survives every lag ``q`` is tried in
rising order on every ``q``-th word only, for a run of ``repeats`` periods holds
``repeats - 1`` such words in a row that equal the word one lag on; hits inside a run already
found repeat a shorter period and are skipped, all others are extended to both sides.

A text of m words takes about m log m comparisons beside the extensions; texts are handled
one by one inside a task, there is no shuffle, and memory is bounded by one Arrow batch and
the longest text.

Defined cases: NULL and empty texts have no words and no runs; repeated rows and repeated or
NULL ids are measured each for itself; an empty table gives no rows; of other columns only
those named in ``keep`` are carried, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

REPEATS = 4
LEAST = 6
# Runs of a text as three lists that belong together.
FIELDS = [
    ("n_words", T.LongType()),
    ("starts", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())),
    ("periods", T.ArrayType(T.LongType())),
    ("n_dropped", T.LongType()), ("collapsed", T.StringType()),
]


def word_ids(tokens: list) -> np.ndarray:
    """Small numbers for words, equal for equal words."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in tokens), np.int64, len(tokens))


def rarest(length: np.ndarray, repeats: int, least: int) -> np.ndarray:
    """Fewest occurrences that a word of a run has in a segment of so many words.

    A run of one word has ``least`` of it.  Of a longer period, ``repeats`` are the fewest, and
    it needs twice as many words.
    """
    one = max(repeats, least)
    return np.where(length < 2 * repeats, one, min(repeats, one))


def segments(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, end)`` of the stretches that no rare word splits any more."""
    n, shortest = len(ids), max(repeats, least)
    if n < shortest:
        return []
    stable: list[tuple[int, int]] = []
    at, segment = np.arange(n), np.zeros(n, np.int64)
    sizes = np.array([n])
    while len(at):
        keys, number, count = np.unique(
            segment * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        stays = count[number] >= rarest(sizes, repeats, least)[segment]
        split = np.bincount(segment, ~stays, len(sizes)) > 0
        done = ~split[segment]
        if done.any():
            firsts = np.flatnonzero(done & np.r_[True, segment[1:] != segment[:-1]])
            stable += [(int(at[f]), int(at[f] + sizes[segment[f]])) for f in firsts]
        go = stays & ~done
        at, before = at[go], segment[go]
        if not len(at):
            break
        opens = np.r_[True, (np.diff(at) > 1) | (np.diff(before) > 0)]
        segment = np.cumsum(opens) - 1
        sizes = np.bincount(segment)
        long = sizes[segment] >= shortest
        at, segment = at[long], segment[long]
        if len(at):
            used, segment = np.unique(segment, return_inverse=True)
            sizes = sizes[used]
    return sorted(stable)


def _reach(same_from: Callable[[int, int], np.ndarray], at: int, step: int, limit: int) -> int:
    """How many places from ``at`` on in the direction of ``step`` are all equal."""
    seen, size = 0, 64
    while seen < limit:
        size = min(size, limit - seen)
        same = same_from(at + step * seen, size)
        if not same.all():
            return seen + int(np.argmin(same))
        seen, size = seen + size, size * 2
    return seen


def scan(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of one segment, by rising period.

    A hit whose next two periods lie in a known run repeats that run's shorter period there,
    and with it everywhere.
    """
    m, found = len(ids), []
    covered = np.zeros(m + 1, np.int64)  # end of the longest known run over a place
    for q in range(1, m // max(repeats, 1) + 1):
        equal = ids[: m - q : q] == ids[q::q]
        # a row of repeats - 1 places on the grid, q words apart
        row = equal[: len(equal) - repeats + 2].copy()
        for k in range(1, repeats - 1):
            row &= equal[k : len(equal) - repeats + 2 + k]
        for at in (np.flatnonzero(row) * q).tolist():
            if covered[at] >= at + 2 * q:
                continue
            left = _reach(lambda i, k: (ids[i - k + 1 : i + 1] == ids[i - k + 1 + q : i + 1 + q])[::-1],
                          at, -1, at + 1)
            right = _reach(lambda i, k: ids[i : i + k] == ids[i + q : i + q + k], at, 1, m - q - at)
            start = at - left + 1
            length = left + right - 1 + q
            if length >= max(least, repeats * q):
                found.append((start, length, q))
                covered[start : start + length] = np.maximum(
                    covered[start : start + length], start + length)
    return found


def runs(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a text, by start and period."""
    return sorted(
        (a + start, length, q)
        for a, b in segments(ids, repeats, least)
        for start, length, q in scan(ids[a:b], repeats, least)
    )


def measure(tokens: list[bytes], repeats: int, least: int) -> tuple:
    found = runs(word_ids(tokens), repeats, least)
    kept = np.ones(len(tokens), bool)
    for start, length, q in found:
        kept[start + q : start + length] = False
    left = tokens if kept.all() else [w for w, k in zip(tokens, kept.tolist(), strict=True) if k]
    starts, lengths, periods = zip(*found, strict=True) if found else ((), (), ())
    return (len(tokens), list(starts), list(lengths), list(periods), len(tokens) - len(left),
            b" ".join(left))


def periodic_runs(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    repeats: int = REPEATS,
    least: int = LEAST,
    change: Callable[[list[bytes], tuple], list[bytes]] | None = None,
    digest: Callable[[tuple], tuple] | None = None,
    digest_fields: list[T.StructField] | None = None,
) -> DataFrame:
    """``keep`` and ``FIELDS`` for every row: the runs of its text and the text without repeats.

    ``collapsed`` holds the words that no run contains after its first period, joined by one
    space.  ``change`` may alter the words, given the row's ``keep`` values, before they are
    searched; ``digest`` may turn the measured tuple into the columns of ``digest_fields``
    where the texts themselves are not wanted.
    """
    if repeats < 3 or least < 1:
        raise ValueError("a run needs three periods and one word at least")
    source = docs.select(*keep, text)
    fields = [T.StructField(n, t) for n, t in FIELDS] if digest is None else digest_fields
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(T.StructType(fields))]
        for batch in batches:
            own = [batch.column(i) for i in range(len(keep))]
            values = zip(*(c.to_pylist() for c in own), strict=True) if keep else iter(())
            rows = []
            for value, text_value in zip(values, batch.column(len(keep)), strict=True):
                tokens = (text_value.as_py() or "").encode("utf-8", "surrogatepass").split()
                if change:
                    tokens = change(tokens, value)
                row = measure(tokens, repeats, least)
                if digest:
                    row = digest(row)
                else:
                    row = (*row[:-1], row[-1].decode("utf-8", "surrogatepass"))
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=schema.names)

    return source.mapInArrow(work, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
