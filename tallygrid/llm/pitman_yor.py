"""Hierarchical Pitman-Yor language model over words and the words before them.

Every context word is a restaurant whose dishes are the words after it.  All of them share
one parent, the restaurant of single words, whose customers are their tables; its own base is
uniform over the known words and one unknown.  Seatings are drawn by Gibbs sampling, and a
word's probability is the mean of its predictive probabilities under several samples.

The corpus is cut into blocks of documents and shards of contexts:

1. Blocks send their distinct pairs with their training counts to the pairs' shards.  Shards
   draw seatings and report, for each word, how many tables serve it.
2. The reports meet by word, in classes of words.  There the parent's seating is drawn; the
   parent is one restaurant, so before each sweep the tables of all classes are added up.  Every
   shard gets back, in the order of its own words, the parent's customers and tables of each
   sample.
3. Blocks send their pairs again, now with the documents they stand in.  Shards draw seatings
   against the parent, and answer every block with one row: the sums of its documents that have
   pairs there, packed.  A block's answers are added up.

Nothing is sampled or cut off: a word or pair seen once has its table.  Pairs of a context
that holds more than its share of the corpus are dealt to shards by classes of the second
word, for work only: it stays one restaurant.  Its shards meet before each sweep and after the
last, and add up its tables, so every draw and prediction is made with those of all shards.

Defined cases: a NULL or empty text is its end alone; NULL ids count as training documents,
repeated ids are scored row by row; without training documents every word is unknown; an
empty table gives no rows; extra columns are not carried.  Words are told apart by 56-bit
hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays
from .common import END, mixed, word_hashes
from .common import stored as kept
from .seating import Seating

SAMPLES = 2
SWEEPS = 2  # before each sample
DISCOUNTS = (0.6, 0.8)  # of the parent, of the contexts
STRENGTHS = (5.0, 1.0)
BLOCK_TOKENS = 1_500_000
BLOCK_DOCS = 60_000
KEY_BITS = 64  # of the number of a pair and its document within a block
WORD_ROOM = 8  # bits of a 64-bit number beside a word's hash
SHARD_BYTES = 12_000_000  # of text for each shard
PIECE_BYTES = 300_000  # of text that is cut into words at once, which then stays in the cache
FOLDS, HELD = 7, 2


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffles that it took are deleted at once.

    Spark would leave them until the driver collects its garbage.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return kept(df)
    finally:
        conf.set(name, before)


def _delete(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = table.sparkSession._jvm
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in table.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, False)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def _pack(h: np.ndarray) -> bytes:
    """56-bit hashes in seven bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.reshape(-1).view("<u8")


def _pack_runs(h: np.ndarray) -> bytes:
    """Sorted hashes, each once with how often it comes."""
    start = _runs(h) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(h))).astype(np.int32)
    return np.int32(len(start)).tobytes() + times.tobytes() + _pack(h[start])


def _unpack_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, and how often each comes."""
    n = int(np.frombuffer(data, np.int32, 1)[0])
    return _unpack(data[4 + 4 * n:]), np.frombuffer(data, np.int32, n, 4)


def _pairs(packed_v, packed_w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of packed rows in order, by context and word, and their places in the rows."""
    runs = [_unpack_runs(x) for x in packed_v]
    contexts, room = np.unique(np.concatenate([x for x, _ in runs]), return_inverse=True)
    w = np.concatenate([_unpack(x) for x in packed_w])
    # A pair is one number to sort: its context's number and as much of its word as there is room.
    bits = int(len(contexts) - 1).bit_length()
    left = np.uint64(min(64 - bits, 63))
    key = np.repeat(room.astype(np.uint64) << left, np.concatenate([times for _, times in runs]))
    key |= w >> np.uint64(max(0, bits - WORD_ROOM))
    order = np.argsort(key)
    key, w = key[order], w[order]
    if ((key[1:] == key[:-1]) & (w[1:] != w[:-1])).any():
        again = np.lexsort((w, key))
        w, order = w[again], order[again]
    return contexts[key >> left], w, order


def _chain(text: str | None) -> np.ndarray:
    """End, words, end as 56-bit hashes: neighbours are the pairs."""
    return np.concatenate([[END], word_hashes(text), [END]]).astype(np.uint64) >> np.uint64(8)


def _chains(texts: pa.Array) -> list[np.ndarray]:
    """``_chain`` of many texts at once."""
    words, sizes = word_arrays.word_hashes(texts)
    found = np.full(len(words) + 2 * len(texts), END)
    found[np.arange(len(words)) + 2 * np.repeat(np.arange(len(texts)), sizes) + 1] = words
    return np.split(found >> np.uint64(8), np.cumsum(sizes + 2)[:-1])


class Plan:
    """Which shard a pair belongs to."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, np.sort(hot)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, self.hot) if len(self.hot) else np.zeros(len(v), bool)

    def word_class(self, w: np.ndarray) -> np.ndarray:
        return w % np.uint64(self.shards)

    def shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        spread = np.where(self.is_hot(v), v + self.word_class(w), v)
        # Small numbers are sorted faster.
        return (mixed(spread) % np.uint64(self.shards)).astype(np.min_scalar_type(self.shards))

    def ends(self, shard: np.ndarray) -> np.ndarray:
        """Where every shard's rows start in rows by shard, and where the last one's end."""
        return np.append(0, np.cumsum(np.bincount(shard, minlength=self.shards)))


class _Block:
    """Documents that are sent together."""

    def __init__(self):
        self.ids: list = []
        self.chains: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> bool:
        return self.take(doc_id, _chain(text))

    def take(self, doc_id, chain: np.ndarray) -> bool:
        """Add a document; whether the block is full."""
        self.ids.append(doc_id)
        self.chains.append(chain)
        self.size += len(chain)
        return self.size >= BLOCK_TOKENS or len(self.ids) >= BLOCK_DOCS

    def counted(self):
        """``(v, w, documents, place, times)``: the distinct pairs by context and word, in how many
        documents each stands, and these documents' numbers in the block with how often.

        Words are numbered within the block, so that a pair and its document are one number to sort.
        """
        sizes = [len(c) for c in self.chains]
        words, code = _numbered(np.concatenate(self.chains))
        code = code.astype(np.uint64)
        word_bits, doc_bits = (np.uint64(max(1, int(n - 1).bit_length()))
                               for n in (len(words), len(self.ids)))
        inside = np.ones(len(code) - 1, bool)  # not from one document's end to the next one's
        inside[np.cumsum(sizes)[:-1] - 1] = False
        place = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[:-1][inside]
        if 2 * word_bits + doc_bits <= KEY_BITS:
            key = code[:-1][inside] << word_bits
            key |= code[1:][inside]
            key <<= doc_bits
            key |= place
            del code, place, inside
            key.sort()
            start = _runs(key)
            times = np.diff(np.append(start, len(key))).astype(np.int32)
            key = key[start]
            place = (key & ((np.uint64(1) << doc_bits) - np.uint64(1))).astype(np.uint16)
            key >>= doc_bits
            pair = _runs(key)
            documents = np.diff(np.append(pair, len(key))).astype(np.int32)
            key = key[pair]
            v = words[key >> word_bits]
            w = words[key & ((np.uint64(1) << word_bits) - np.uint64(1))]
            return v, w, documents, place, times
        # A very long text has so many words that their numbers do not fit beside each other.
        v, w = code[:-1][inside], code[1:][inside]
        order = np.lexsort((place, w, v))
        v, w, place = v[order], w[order], place[order].astype(np.uint16)
        start = _runs(v, w, place)
        times = np.diff(np.append(start, len(v))).astype(np.int32)
        v, w, place = v[start], w[start], place[start]
        pair = _runs(v, w)
        documents = np.diff(np.append(pair, len(v))).astype(np.int32)
        return words[v[pair]], words[w[pair]], documents, place, times

    def contexts(self) -> np.ndarray:
        return np.concatenate([c[:-1] for c in self.chains])

    def training(self) -> np.ndarray:
        return np.array([not held_out(i) for i in self.ids], bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        ids, texts = batch.columns[:2]
        before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(before // PIECE_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            chains = _chains(texts.slice(a, b - a)) if b > a else []
            for doc_id, chain in zip(ids.slice(a, b - a).to_pylist(), chains, strict=True):
                if block.take(doc_id, chain):
                    yield block
                    block = _Block()
    if block.ids:
        yield block


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value's place among them."""
    code, values = pd.factorize(x)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[code]


def _rooms(v: np.ndarray) -> np.ndarray:
    """The numbers of sorted contexts, from 0."""
    return np.cumsum(np.append([False], v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def hot_contexts(docs: DataFrame, shards: int) -> np.ndarray:
    """Words with more than half of a shard's share of all tokens; at most ``2 * shards``."""
    schema = pa.schema([("word", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            word, c = np.unique(block.contexts(), return_counts=True)
            often = c * 4 * shards >= block.size
            word, c = np.append(word[often].view(np.int64), -1), np.append(c[often], c.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(c.astype(np.int64))], schema=schema)

    rows = docs.mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(
        F.sum("c").alias("c")).orderBy(F.desc("c")).limit(2 * shards + 1).collect()
    total = next((r["c"] for r in rows if r["word"] == -1), 0)
    return np.array(
        [r["word"] for r in rows if r["word"] != -1 and 2 * shards * r["c"] > total], np.int64
    ).view(np.uint64)


def _send_pairs(docs: DataFrame, plan: Plan) -> DataFrame:
    """``(shard, v, w, c)``: a block's distinct pairs with their training counts, packed."""
    schema = pa.schema([("shard", pa.int32()), ("v", pa.binary()), ("w", pa.binary()),
                        ("c", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            v, w, documents, place, times = block.counted()
            first = np.cumsum(documents) - documents
            c = np.add.reduceat(np.where(block.training()[place], times, 0), first)
            shard = plan.shard(v, w)
            order = np.argsort(shard, kind="stable")
            v, w, c, ends = v[order], w[order], c[order], plan.ends(shard)
            rows = []
            for s in np.unique(shard).tolist():
                a, b = ends[s], ends[s + 1]
                rows.append({"shard": s, "v": _pack_runs(v[a:b]), "w": _pack(w[a:b]),
                             "c": c[a:b].astype(np.int32).tobytes()})
            yield _rows(rows, schema)

    return docs.mapInArrow(work, "shard int, v binary, w binary, c binary")


def _seat(plan: Plan, seed: int):
    """Step 1 in a shard: seat against the shard's own word frequencies, report tables."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        v, w, order = _pairs(part["v"], part["w"])
        c = np.concatenate([np.frombuffer(x, np.int32) for x in part["c"]]).astype(np.int64)[order]
        start = _runs(v, w)
        v, w, c = v[start], w[start], np.add.reduceat(c, start)
        words, of = np.unique(w, return_inverse=True)
        learned = np.bincount(of, c, len(words)).astype(np.int64)
        hot = plan.is_hot(v)
        # Hot contexts bring only some classes of words here, so they say nothing of frequencies.
        told = np.bincount(of, c * ~hot, len(words))
        base = (told + 0.5) / (told.sum() + 0.5 * len(words))
        known, shared = np.flatnonzero((c > 0) & ~hot), np.flatnonzero((c > 0) & hot)
        served = np.zeros((SAMPLES, len(words)), np.int32)
        if len(known):
            seating = Seating(c[known], _rooms(v[known]),
                              DISCOUNTS[1], STRENGTHS[1], np.random.default_rng([seed, shard]))
            for k in range(SAMPLES):
                for _ in range(SWEEPS):
                    seating.sweep(base[of[known]])
                served[k] = np.bincount(of[known], seating.tables, len(words))
        rows, classes = [], plan.word_class(words)
        for r in np.unique(classes):
            mine = classes == r
            rows.append({"root": int(r), "shard": shard, "w": _pack(words[mine]),
                         "c": learned[mine].tobytes(), "tables": served[:, mine].tobytes()})
        if len(shared):
            # The parent answers word by word, class after class.
            place = np.argsort(np.argsort(classes, kind="stable"))[of[shared]]
            rows.append({"root": -1, "shard": shard, "w": _pack(w[shared]), "c": np.stack(
                [c[shared], np.searchsorted(plan.hot, v[shared]), place]).astype(np.int64).tobytes(),
                "tables": base[of[shared]].tobytes()})
        return pd.DataFrame(rows, columns=["root", "shard", "w", "c", "tables"])

    return work


def _sweeps(c: np.ndarray, row: np.ndarray, base: np.ndarray, whole, seed: list[int]):
    """Tables of a shard's dishes of hot contexts: at first, and after each sweep.

    ``whole`` holds, for each sweep, the tables of every hot context in all shards before it.
    """
    seating = Seating(c, row, DISCOUNTS[1], STRENGTHS[1], np.random.default_rng([*seed, 1]))
    yield seating.tables.copy()
    for tables in whole:
        seating.other = np.asarray(tables)[:seating.size] - seating.totals()
        seating.sweep(base)
        yield seating.tables.copy()


def _whole(parts: DataFrame, contexts: int, chains: int, rounds: int, seed: int):
    """Customers of the hot contexts, and their tables in all shards before and after sweeps.

    One job for each round; ``parts`` has a row per shard with a base for each chain.  What a
    shard drew in earlier rounds it draws again from the same seed.
    """
    guests, tables = np.zeros(contexts, np.int64), np.zeros((chains, 0, contexts), np.int64)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, numbers, bases in zip(frame["shard"], frame["c"], frame["base"], strict=True):
                c, row, _ = np.frombuffer(numbers, np.int64).reshape(3, -1)
                rows = np.unique(row)
                for k, base in enumerate(np.frombuffer(bases).reshape(chains, -1)):
                    *_, last = _sweeps(c, row, base, tables[k], [seed, shard, k])
                    yield pd.DataFrame({
                        "k": k, "context": rows, "guests": np.bincount(row, c)[rows].astype(np.int64),
                        "tables": np.bincount(row, last)[rows].astype(np.int64)})

    for _ in range(rounds):
        now = np.zeros((chains, 1, contexts), np.int64)
        for r in parts.mapInPandas(
            work, "k int, context int, guests bigint, tables bigint"
        ).groupBy("k", "context").agg(F.sum("guests"), F.sum("tables")).collect():
            guests[r[1]], now[r[0], 0, r[1]] = r[2], r[3]
        tables = np.concatenate([tables, now], axis=1)
    return guests, tables


def _report_hot(plan: Plan, whole: np.ndarray, seed: int):
    """The end of step 1 for hot contexts: how many of their tables serve each word."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, w, numbers, base in frame[["shard", "w", "c", "base"]].itertuples(index=False):
                c, row, _ = np.frombuffer(numbers, np.int64).reshape(3, -1)
                words, of = np.unique(_unpack(w), return_inverse=True)
                drawn = list(_sweeps(c, row, np.frombuffer(base), whole[0], [seed, shard, 0]))
                served = np.stack([np.bincount(of, t, len(words))
                                   for t in drawn[SWEEPS::SWEEPS]]).astype(np.int32)
                classes = plan.word_class(words)
                for r in np.unique(classes):
                    mine = classes == r
                    # The shard itself has reported these words and their customers.
                    yield pd.DataFrame([{
                        "root": int(r), "shard": -1, "w": _pack(words[mine]),
                        "c": np.zeros(mine.sum(), np.int64).tobytes(),
                        "tables": served[:, mine].tobytes()}])

    return work


def _rebase(parent: Parent):
    """A shard's dishes of hot contexts with the parent's probabilities of each sample."""

    def work(part: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["shard", "c", "base"])
        reply = reply.sort_values("root")
        of = np.frombuffer(part["c"].iloc[0], np.int64).reshape(3, -1)[2]
        served, tables = (
            np.concatenate([np.frombuffer(x, np.int32).reshape(SAMPLES, -1) for x in reply[c]],
                           axis=1)[:, of].astype(np.int64) for c in ("served", "roots"))
        base = np.stack([parent.base(served[k], tables[k], k) for k in range(SAMPLES)])
        return part.assign(base=[base.tobytes()])[["shard", "c", "base"]]

    return work


def _parent_class(part: pd.DataFrame):
    """A class of words: the lists of its reports, its words, where the lists' words are in them,
    their customers in the training texts, and those in the parent in each sample."""
    lists = [_unpack(x) for x in part["w"]]
    words, of = np.unique(np.concatenate(lists), return_inverse=True)
    count = lambda x: np.bincount(of, x, len(words)).astype(np.int64)
    c = count(np.concatenate([np.frombuffer(x, np.int64) for x in part["c"]]))
    parts = [np.frombuffer(x, np.int32).reshape(SAMPLES, -1) for x in part["tables"]]
    customers = np.stack([count(np.concatenate([p[k] for p in parts])) for k in range(SAMPLES)])
    return lists, words, of, c, customers


def _parent_customers(part: pd.DataFrame) -> pd.DataFrame:
    """The known words' customers of a class, for the parent's sweeps."""
    *_, c, customers = _parent_class(part)
    known = c > 0
    return pd.DataFrame([{"root": int(part["root"].iloc[0]), "known": int(known.sum()),
                          "customers": customers[:, known].tobytes()}])


def _parent_sweeps(customers: np.ndarray, known: int, whole, seed: list[int]) -> np.ndarray:
    """The parent's tables of a class of words, after a sweep for each of ``whole``.

    ``known`` counts the words of all classes; ``whole`` holds all their tables before each sweep.
    """
    if not len(customers):
        return np.zeros(0, np.int64)
    seating = Seating(customers, np.zeros(len(customers), np.int64), DISCOUNTS[0], STRENGTHS[0],
                      np.random.default_rng(seed))
    base = np.full(len(customers), 1 / (known + 1))
    for tables in whole:
        seating.other = tables - seating.totals()
        seating.sweep(base)
    return seating.tables


def _parent_tables(classes: DataFrame, seed: int) -> tuple[int, np.ndarray]:
    """The known words of all classes, and the parent's tables before each sweep of each sample.

    One job for each sweep but the last, over the classes' customers alone.
    """
    known = int(classes.agg(F.sum("known")).first()[0] or 0)
    whole = np.full((SAMPLES, 1), known, np.int64)  # at first each word has one table

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, packed in zip(frame["root"], frame["customers"], strict=True):
                customers = np.frombuffer(packed, np.int64).reshape(SAMPLES, -1)
                yield pd.DataFrame([
                    {"k": k, "tables": int(
                        _parent_sweeps(customers[k], known, whole[k], [seed, root, k]).sum())}
                    for k in range(SAMPLES)])

    for _ in range(SWEEPS - 1):
        now = np.zeros((SAMPLES, 1), np.int64)
        for k, tables in classes.mapInPandas(work, "k int, tables bigint").groupBy("k").agg(
            F.sum("tables")
        ).collect():
            now[k] = tables
        whole = np.concatenate([whole, now], axis=1)
    return known, whole


def _root(known_words: int, whole: np.ndarray, seed: int):
    """Step 2 for a class of words: the parent's customers and tables, back to every shard."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        root = int(part["root"].iloc[0])
        lists, _, of, c, customers = _parent_class(part)
        tables = np.zeros_like(customers)
        known = np.flatnonzero(c)
        for k in range(SAMPLES):
            tables[k, known] = _parent_sweeps(
                customers[k][known], known_words, whole[k], [seed, root, k])
        ends = np.cumsum([len(x) for x in lists])
        rows = []
        for shard, a, b in zip(part["shard"], ends - [len(x) for x in lists], ends, strict=True):
            if shard < 0:
                continue
            at = of[a:b]
            rows.append({"root": root, "shard": shard, "c": c[at].tobytes(),
                         "served": customers[:, at].astype(np.int32).tobytes(),
                         "roots": tables[:, at].astype(np.int32).tobytes()})
        sums = [c.sum(), len(known), *customers.sum(axis=1), *tables.sum(axis=1)]
        rows.append({"root": root, "shard": -1, "c": np.array(sums, np.int64).tobytes()})
        return pd.DataFrame(rows, columns=["root", "shard", "c", "roots", "served"])

    return work


class Parent:
    """What all shards know: the parent's totals and class masses, the hot contexts' totals."""

    def __init__(self, reply: DataFrame, plan: Plan):
        sums = {r["root"]: np.frombuffer(r["c"], np.int64)
                for r in reply.filter("shard = -1").select("root", "c").collect()}
        total = sum(sums.values(), np.zeros(2 + 2 * SAMPLES, np.int64))
        self.tokens, self.words = int(total[0]), int(total[1])
        self.customers, self.tables = total[2:2 + SAMPLES], total[2 + SAMPLES:]
        opened = STRENGTHS[0] + DISCOUNTS[0] * self.tables
        #: A word that no training document holds, per sample.
        self.unknown = opened / (STRENGTHS[0] + self.customers) / (self.words + 1)
        mass = np.zeros((SAMPLES, plan.shards))
        for r, s in sums.items():
            mass[:, r] = ((s[2:2 + SAMPLES] - DISCOUNTS[0] * s[2 + SAMPLES:])
                          / (STRENGTHS[0] + self.customers) + s[1] * self.unknown)
        self.mass = mass
        # Hot contexts are at most twice as many as shards: customers, and in each sample the
        # tables before each sweep and after the last.
        self.guests = np.zeros(len(plan.hot), np.int64)
        self.opened = np.zeros((SAMPLES, SWEEPS + 1, len(plan.hot)), np.int64)

    def base(self, served: np.ndarray, tables: np.ndarray, sample: int) -> np.ndarray:
        own = served - DISCOUNTS[0] * tables
        return own / (STRENGTHS[0] + self.customers[sample]) + self.unknown[sample]


_SENT = ("shard int, block bigint, v binary, w binary, places binary, times binary, out binary, "
         "ids array<bigint>, n_tokens array<bigint>, held array<boolean>")


def _send_documents(docs: DataFrame, plan: Plan) -> DataFrame:
    """Step 3: a block's distinct (pair, document) with their numbers, and its documents.

    ``out`` has a bit for each document of the block: whether it is held out.
    """
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int64()), ("v", pa.binary()), ("w", pa.binary()),
        ("places", pa.binary()), ("times", pa.binary()), ("out", pa.binary()), ("ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in _blocks(batches):
            v, w, documents, place, times = block.counted()
            learned = block.training()
            out = np.packbits(~learned).tobytes()
            of_pair = plan.shard(v, w)
            shard = np.repeat(of_pair, documents)
            order = np.argsort(shard, kind="stable")
            place, times, ends = place[order], times[order], plan.ends(shard)
            order = np.argsort(of_pair, kind="stable")
            v, w, documents, pair_ends = v[order], w[order], documents[order], plan.ends(of_pair)
            rows = []
            for s in range(plan.shards):
                a, b = ends[s], ends[s + 1]
                p, q = pair_ends[s], pair_ends[s + 1]
                own = s == number % plan.shards
                if a == b and not own:
                    continue
                rows.append({
                    "shard": s, "block": number, "v": _pack_runs(v[p:q]), "w": _pack(w[p:q]),
                    "places": place[a:b].tobytes(),
                    "times": np.concatenate([documents[p:q], times[a:b]]).tobytes(), "out": out,
                    "ids": block.ids if own else None,
                    "n_tokens": [len(c) - 1 for c in block.chains] if own else None,
                    "held": (~learned).tolist() if own else None})
            yield _rows(rows, schema)
            number += 1

    return docs.mapInArrow(work, _SENT)


_ANSWER = ("block bigint, shard int, places binary, known binary, base binary, score binary, "
           "ids array<bigint>, n_tokens array<bigint>, held array<boolean>")


def _score(plan: Plan, parent: Parent, seed: int):
    """Step 3 in a shard: seat against the parent, and sum over each document that has pairs."""
    names = [c.split()[0] for c in _ANSWER.split(", ")]

    def work(sent: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return pd.DataFrame(columns=names)
        shard = int(sent["shard"].iloc[0])
        v, w, order = _pairs(sent["v"], sent["w"])
        blocks = []
        own = []
        for places, times, held, pairs in zip(
            sent["places"], sent["times"], sent["out"], (len(x) // 7 for x in sent["w"]), strict=True,
        ):
            place, numbers = np.frombuffer(places, np.uint16), np.frombuffer(times, np.int32)
            blocks.append((place, numbers[pairs:], numbers[:pairs]))
            learned = np.unpackbits(np.frombuffer(held, np.uint8))[place] == 0
            own.append(np.bincount(np.repeat(np.arange(pairs), numbers[:pairs]),
                                   numbers[pairs:] * learned, pairs))
        own = np.concatenate(own).astype(np.int64)
        start = _runs(v, w)
        kind = np.empty(len(v), np.int32)
        kind[order] = np.repeat(
            np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(v))))
        c = np.bincount(kind, own, len(start)).astype(np.int64)
        v, w = v[start], w[start]
        del own, order, start

        words, of = np.unique(w, return_inverse=True)
        of = of.astype(np.int32)
        del w
        classes = plan.word_class(words)
        total = np.zeros(len(words), np.int64)
        served, tables = (np.zeros((SAMPLES, len(words)), np.int64) for _ in range(2))
        for root, c_, s_, r_ in zip(reply["root"], reply["c"], reply["served"], reply["roots"],
                                    strict=True):
            mine = classes == np.uint64(root)
            total[mine] = np.frombuffer(c_, np.int64)
            served[:, mine] = np.frombuffer(s_, np.int32).reshape(SAMPLES, -1)
            tables[:, mine] = np.frombuffer(r_, np.int32).reshape(SAMPLES, -1)

        room = _rooms(v).astype(np.int32)
        is_hot = plan.is_hot(v)
        guests = np.bincount(room, c).astype(np.int64)[room]
        seen, shared = np.flatnonzero((c > 0) & ~is_hot), np.flatnonzero((c > 0) & is_hot)
        hot = np.flatnonzero(is_hot)
        row = np.searchsorted(plan.hot, v[hot])
        guests[hot] = parent.guests[row]
        where_shared = np.searchsorted(plan.hot, v[shared])
        del v, is_hot
        probability = np.zeros(len(c))
        for k in range(SAMPLES):
            base = parent.base(served[k], tables[k], k)[of]
            base = np.where(total[of] > 0, base, parent.unknown[k])
            # Pairs that are not in the training texts have no tables, only the parent's part.
            opened = np.zeros(len(c))
            eaten = np.zeros(len(c))
            if len(seen):
                rooms, room_of = np.unique(room[seen], return_inverse=True)
                seating = Seating(c[seen], room_of, DISCOUNTS[1], STRENGTHS[1],
                                  np.random.default_rng([seed, shard, k]))
                for _ in range(SWEEPS):
                    seating.sweep(base[seen])
                by_room = np.zeros(room.max() + 1)
                by_room[rooms] = seating.totals()
                opened = by_room[room]
                eaten[seen] = seating.tables
                del seating, rooms, room_of, by_room
            if len(shared):
                *_, eaten[shared] = _sweeps(
                    c[shared], where_shared, base[shared],
                    parent.opened[k, :SWEEPS], [seed, shard, k])
            opened[hot] = parent.opened[k, SWEEPS, row]
            p = (c - DISCOUNTS[1] * eaten + (STRENGTHS[1] + DISCOUNTS[1] * opened) * base) / (
                STRENGTHS[1] + guests)
            probability += p / SAMPLES
        score = np.log10(probability)
        base10 = np.log10((total + 1) / (parent.tokens + parent.words + 1))[of]
        known = (total > 0)[of]
        del probability, of, room, guests, c

        rows, at = [], 0
        for (place, times, documents), ids, n_tokens, held, block in zip(
            blocks, sent["ids"], sent["n_tokens"], sent["held"], sent["block"], strict=True
        ):
            pair = np.repeat(kind[at:at + len(documents)], documents)
            at += len(documents)
            number = np.zeros(place.max(initial=0) + 1, np.int64)  # of documents with pairs here
            number[place] = 1
            there = np.flatnonzero(number).astype(np.uint16)
            number[there] = np.arange(len(there))
            of_place = number[place]
            add = lambda x: np.bincount(of_place, x[pair] * times, len(there))  # noqa: E731, B023
            rows.append({
                "block": block, "shard": shard, "places": there.tobytes(),
                "known": add(known).astype(np.int32).tobytes(), "base": add(base10).tobytes(),
                "score": add(score).tobytes(), "ids": _ids(ids), "n_tokens": n_tokens, "held": held})
        return pd.DataFrame(rows, columns=names)

    return work


def _ids(ids) -> list[int | None] | None:
    """A list of ids, whose NULLs pandas may have made NaN."""
    return None if ids is None else [None if x is None or x != x else int(x) for x in ids]


_SUMS = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
         "score double")


def _add_up(part: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, with the sums of all shards that have pairs of theirs."""
    part = part.sort_values("shard")
    own = part[part["ids"].notna()].iloc[0]
    n = len(own["ids"])
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for places, k, b, s in zip(
        part["places"], part["known"], part["base"], part["score"], strict=True
    ):
        there = np.frombuffer(places, np.uint16)
        known[there] += np.frombuffer(k, np.int32)
        base[there] += np.frombuffer(b)
        score[there] += np.frombuffer(s)
    return pd.DataFrame({
        "doc_id": pd.array(_ids(own["ids"]), "Int64"), "held_out": pd.array(own["held"], "boolean"),
        "n_tokens": own["n_tokens"], "n_known": known, "base_score": base, "score": score})


def documents(sums: DataFrame) -> DataFrame:
    """The documents with their sums, a row for each."""
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of all rows.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of single
    words with one added to every count.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    plan = Plan(shards, hot_contexts(docs, shards) if shards > 1 else np.zeros(0, np.uint64))
    schema = "root int, shard int, w binary, c binary, tables binary"
    reports = _send_pairs(docs, plan).groupBy("shard").applyInPandas(_seat(plan, seed), schema)
    reports = stored(reports)
    used = [reports]
    if len(plan.hot):
        parts = stored(reports.filter("root < 0").select(
            "shard", "w", "c", F.col("tables").alias("base")))
        _, whole = _whole(parts, len(plan.hot), 1, SAMPLES * SWEEPS, seed)
        used.append(stored(parts.mapInPandas(_report_hot(plan, whole, seed), schema)))
        reports = reports.filter("root >= 0").unionByName(used[1])
    known, tables = _parent_tables(stored(reports.groupBy("root").applyInPandas(
        _parent_customers, "root int, known bigint, customers binary")), seed)
    reply = stored(reports.groupBy("root").applyInPandas(
        _root(known, tables, seed), "root int, shard int, c binary, roots binary, served binary"))
    for table in used:
        _delete(table)
    parent = Parent(reply, plan)
    answers = reply.filter("shard >= 0")
    if len(plan.hot):
        based = stored(parts.select("shard", "c").groupBy("shard").cogroup(
            answers.groupBy("shard")).applyInPandas(
            _rebase(parent), "shard int, c binary, base binary"))
        parent.guests, parent.opened = _whole(
            based, len(plan.hot), SAMPLES, SWEEPS + 1, seed + 1)
    scored = _send_documents(docs, plan).groupBy("shard").cogroup(
        answers.groupBy("shard")).applyInPandas(_score(plan, parent, seed + 1), _ANSWER)
    rows = documents(scored.groupBy("block").applyInPandas(_add_up, _SUMS))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known",
                       F.lit(parent.tokens).cast("bigint").alias("train_tokens"),
                       "base_score", "score")
