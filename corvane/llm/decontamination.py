"""Benchmark decontamination by SimHash over item-sized windows.

A window is as long as the item it is held against (a text shorter than that is one window), and there is one from every
word on. Each has a 64-bit SimHash of its words, ASCII letters in lower case. A multi-index over BLOCKS blocks of bits, probed with
all values up to NEAR bits away, gives all items within RADIUS = BLOCKS * NEAR + BLOCKS - 1 bits: of so many differing bits
some block has NEAR at most. What lies within the radius is verified by the exact similarity of weighted shingles (five words;
weight: characters), sum of minima over sum of maxima.

A window is skipped only where it cannot be similar: the shingles that it shares with the items of its size, all together,
must weigh at least ``least`` of its own. So texts without benchmark words cost one look-up a word.

The benchmark is held by every task in blocks of BLOCK_BYTES on average. A benchmark of one block takes one map over the
documents, without a shuffle. For a larger one, a first map leaves the documents that hold a window of enough shared shingles
(a bit map of at most 2**MOST_BITS bits tells), and the blocks go over these alone.

Defined results: null or empty texts and items match nothing; null ids are returned as null; repeated rows of documents or
items give a row each; texts of any length are read whole; of equally similar windows the first counts; ids may be of any
type; empty tables give an empty result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, Words, bounded_batches, checkpointed, chunks, grams, table, texts_of

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, NEAR = 4, 3
RADIUS = BLOCKS * NEAR + BLOCKS - 1
BLOCK_BYTES, MOST_BITS = 8 << 20, 30
_BITS = 64 // BLOCKS
_NEARBY = np.array([sum(1 << b for b in some) for k in range(NEAR + 1) for some in combinations(range(_BITS), k)])
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
SCHEMA = "item_id {item}, start long, n_words long, hamming int, similarity double"


def fingerprints(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of the words [start, start + size) of each window, each word counting once wherever it stands."""
    out = np.zeros(len(start), U64)
    width = 2048
    for a in range(0, len(start), width):
        s, n = start[a : a + width], size[a : a + width]
        at = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bits = np.unpackbits(h[at].view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        total = np.add.reduceat(bits, np.cumsum(n) - n, axis=0)
        out[a : a + width] = np.packbits(total > 0, axis=1).view(U64).ravel()
    return out


def weighted(g: np.ndarray, w: np.ndarray) -> dict[int, float]:
    out: dict[int, float] = {}
    for k, x in zip(g.tolist(), w.tolist(), strict=True):
        out[k] = out.get(k, 0.0) + x
    return out


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    shared = sum(min(x, b[k]) for k, x in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class Text:
    """Folded word hashes, word lengths in characters and shingles of some texts."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        self.h = w.hashes(_FOLD)
        points = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum((w.buf & 0xC0) != 0x80, out=points[1:])
        self.chars = points[w.ends] - points[w.starts]
        self.at = np.zeros(w.n + 1, np.int64)
        np.cumsum(self.chars, out=self.at[1:])
        self.g = grams(self.h, SHINGLE)

    def shingles(self, start: int, size: int) -> dict[int, float]:
        """Weighted shingles of a range of words; one alone if it is shorter."""
        n = size - SHINGLE + 1
        if n <= 0:
            key = int(grams(self.h[start : start + size], size)[0]) ^ size if size else 0
            return {key: float(self.at[start + size] - self.at[start])}
        a = np.arange(start, start + n)
        return weighted(self.g[a], self.at[a + SHINGLE] - self.at[a])


class Items:
    """A block of the benchmark: its shingles, fingerprints and their multi-index."""

    def __init__(self, texts: list[bytes]):
        t = Text(texts)
        of = t.words.of
        self.size = np.diff(of)
        self.shingles = [t.shingles(int(of[i]), int(self.size[i])) for i in range(len(texts))]
        self.print = np.zeros(len(texts), U64)
        full = np.flatnonzero(self.size)
        self.print[full] = fingerprints(t.h, of[full], self.size[full])
        self.sizes = np.unique(self.size[self.size >= SHINGLE])
        self.short = np.unique(self.size[(self.size > 0) & (self.size < SHINGLE)])
        pairs = [(k, n) for x, n in zip(self.shingles, self.size.tolist(), strict=True) for k, w in x.items() if w]
        self.key, at = np.unique(np.array([k for k, _ in pairs], U64), return_inverse=True)
        self._wide = int(self.size.max(initial=0)) + 1
        self._of_size = np.unique(at * self._wide + np.array([n for _, n in pairs], np.int64))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.key >> U64(42)).astype(np.int64)] = True
        self.index = []
        for b in range(BLOCKS):
            value = self._block(self.print[full], b)
            order = np.argsort(value, kind="stable")
            self.index.append((np.searchsorted(value[order], np.arange((1 << _BITS) + 1)), full[order]))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U64(b * _BITS)) & U64((1 << _BITS) - 1)).astype(np.int64)

    def candidates(self, mark: int) -> np.ndarray:
        """The items of which some block of bits is NEAR bits at most from the fingerprint's."""
        got = []
        for b, (edge, items) in enumerate(self.index):
            value = ((mark >> (b * _BITS)) & ((1 << _BITS) - 1)) ^ _NEARBY
            lo, hi = edge[value], edge[value + 1]
            some = np.flatnonzero(hi > lo)
            got += [items[x:y] for x, y in zip(lo[some].tolist(), hi[some].tolist(), strict=True)]
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)

    def near(self, mark: int) -> np.ndarray:
        """The items within RADIUS bits of a fingerprint."""
        one = self.candidates(mark)
        return one[np.bitwise_count(self.print[one] ^ U64(mark)) <= RADIUS]

    def of_size(self, g: np.ndarray, n: int) -> np.ndarray:
        """Which of some known shingles an item of n words has."""
        pair = np.searchsorted(self.key, g) * self._wide + n
        return self._of_size[np.minimum(np.searchsorted(self._of_size, pair), len(self._of_size) - 1)] == pair

    def known(self, g: np.ndarray) -> np.ndarray:
        """True for the shingles that some item has."""
        out = self.maybe[(g >> U64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.key[np.minimum(np.searchsorted(self.key, g[at]), len(self.key) - 1)] == g[at]
        return out


def windows(t: Text, known, of_size, sizes: np.ndarray, short: np.ndarray, least: float) -> np.ndarray:
    """Columns (text, first word, words, words of the item) of all windows that can be similar to an item of these sizes."""
    of, doc = t.words.of, t.words.docs()
    out = [np.zeros((4, 0), np.int64)]
    for n in short.tolist():
        g = grams(t.h, n) ^ U64(n)
        at = np.flatnonzero(known(g)) if len(g) else np.zeros(0, np.int64)
        at = at[at + n <= of[doc[at] + 1]]
        at = at[of_size(g[at], n)] if len(at) else at
        out.append(np.stack([doc[at], at, np.full(len(at), n), np.full(len(at), n)]))
    at = np.flatnonzero(known(t.g)) if len(sizes) and len(t.g) else np.zeros(0, np.int64)
    at = at[at + SHINGLE <= of[doc[at] + 1]]
    if not len(at):
        return np.concatenate(out, axis=1)
    weight = t.at[SHINGLE:] - t.at[:-SHINGLE]  # of the shingle from each word on
    total = np.zeros(len(weight) + 1, np.int64)
    np.cumsum(weight, out=total[1:])
    for n in sizes.tolist():
        mine = at[of_size(t.g[at], n)]
        if not len(mine):
            continue
        shared = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(weight[mine], out=shared[1:])
        # the starts from which a shared shingle is in reach, as ranges that do not overlap
        lo, hi = np.maximum(mine - n + SHINGLE, of[doc[mine]]), mine + 1
        lo[1:] = np.maximum(lo[1:], hi[:-1])
        many = np.maximum(hi - lo, 0)
        start = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, end = of[doc[start]], of[doc[start] + 1]
        size = np.minimum(n, end - first)
        start, size = (x[start + size <= end] for x in (start, size))
        stop = start + size - SHINGLE + 1
        held = shared[np.searchsorted(mine, stop)] - shared[np.searchsorted(mine, start)]
        enough = held >= least * (total[stop] - total[start]) - 1e-9
        start, size = start[enough], size[enough]
        out.append(np.stack([doc[start], start, size, np.full(len(start), n)]))
    return np.concatenate(out, axis=1)


def find(texts: list[bytes], items: Items, least: float) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, first word, words, bits apart, similarity) of the best window of each text and item that are similar."""
    if not len(items.key):
        return []
    t = Text(texts)
    d, start, size, n = windows(t, items.known, items.of_size, items.sizes, items.short, least)
    if not len(d):
        return []
    marks = fingerprints(t.h, start, size)
    of = t.words.of
    best: dict[tuple[int, int], tuple] = {}
    near: dict[int, np.ndarray] = {}
    for k, mark in enumerate(marks.tolist()):
        if mark not in near:
            near[mark] = items.near(mark)
        some = near[mark]
        for item in some[items.size[some] == n[k]].tolist():
            s = similarity(t.shingles(int(start[k]), int(size[k])), items.shingles[item])
            key = (int(d[k]), item)
            if s >= least and (key not in best or s > best[key][-1]):
                best[key] = (int(start[k] - of[d[k]]), int(size[k]), int(np.bitwise_count(U64(mark) ^ items.print[item])), s)
    return [(*key, *x) for key, x in sorted(best.items())]


def _shingle_bits(texts: list[bytes], bits: int) -> np.ndarray:
    t = Text(texts)
    keys = np.array([k for i in range(len(texts)) for k, w in t.shingles(int(t.words.of[i]), int(t.words.of[i + 1] - t.words.of[i])).items() if w], U64)
    return np.unique(keys >> U64(64 - bits)).astype(np.int64)


def _suspects(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that hold a window of which the shingles known to the whole benchmark weigh enough, and the others."""
    bits = min(MOST_BITS, max(16, int(8 * size).bit_length()))
    parts = 64

    def mark(batches):
        held = np.zeros(1 << bits, bool)
        lengths: set[int] = set()
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                held[_shingle_bits(texts[a:b], bits)] = True
                lengths |= set(np.diff(Words(texts[a:b]).of).tolist())
        packed = np.packbits(held.reshape(parts, -1), axis=1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "held": pa.array([zstandard.compress(x.tobytes(), 1) for x in packed], pa.binary()), "lengths": pa.array([sorted(lengths)] + [[]] * (parts - 1), pa.list_(pa.int64()))})

    def join(t: pa.Table) -> pa.Table:
        held = reduce(np.bitwise_or, (np.frombuffer(zstandard.decompress(x), np.uint8) for x in t["held"].to_pylist()))
        lengths = sorted({n for x in t["lengths"].to_pylist() for n in x})
        return pa.table({"part": t["part"][:1], "held": pa.array([zstandard.compress(held.tobytes(), 1)], pa.binary()), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    schema = "part int, held binary, lengths array<long>"
    rows = benchmark.select(item_text_col).mapInArrow(mark, schema).groupBy("part").applyInArrow(join, schema).collect()  # 2**MOST_BITS bits at most
    lengths = np.array(sorted({n for r in rows for n in r.lengths}), np.int64)
    held = docs.sparkSession.sparkContext.broadcast([bytes(r.held) for r in sorted(rows, key=lambda r: r.part)])

    def keep(batches, wanted: bool):
        table_ = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in held.value])
        known = lambda g: (table_[(i := (g >> U64(64 - bits)).astype(np.int64)) >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1
        sizes, short = lengths[lengths >= SHINGLE], lengths[(lengths > 0) & (lengths < SHINGLE)]
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            got = {a + x for a, b in chunks(texts) for x in windows(Text(texts[a:b]), known, lambda g, n: np.ones(len(g), bool), sizes, short, least)[0].tolist()}
            yield batch.filter(pa.array([(k in got) == wanted for k in range(len(texts))], pa.bool_()))

    return checkpointed(docs.mapInArrow(partial(keep, wanted=True), docs.schema)), docs.mapInArrow(partial(keep, wanted=False), docs.schema)


def _blocks(benchmark: DataFrame, size: int, block_bytes: int):
    """The benchmark (i, t) in blocks of block_bytes on average: an iterator of (texts, ids)."""
    blocks = max(1, -(-2 * size // block_bytes))
    kind = to_arrow_type(benchmark.schema["i"].dataType)
    for block in range(blocks):
        mine = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block)
        rows = mine.orderBy("i", "t").collect()  # a block of the benchmark
        yield [(r.t or "").encode() for r in rows], pa.array([r.i for r in rows], kind)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, least: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, n_words (of the most similar window), hamming, similarity: one row per document and item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA.format(item=benchmark.schema[item_col].dataType.simpleString())}"
    held = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if 2 * size > block_bytes:
        rows, _ = _suspects(rows, held, "text", "t", size, least)
    out = []
    for block in _blocks(held, size, block_bytes):
        items = spark.sparkContext.broadcast(block)

        def run(batches, items=items):
            texts, ids = items.value
            block_ = Items(texts)
            for batch in batches:
                texts = texts_of(batch.column(1))
                got = [(a + x[0], *x[1:]) for a, b in chunks(texts) for x in find(texts[a:b], block_, least)]
                row, item, start, n, apart, s = zip(*got, strict=True) if got else ([],) * 6
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), ids.take(pa.array(item, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(apart, pa.int32()), pa.array([round(x, 6) for x in s], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "start", "n_words", "hamming", "similarity"])

        out.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", *, least: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark item, judged row by row. Each of several blocks sees only what the one before left."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = benchmark.select(F.lit(0).alias("i"), F.col(item_text_col).alias("t"))
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    several, clean = 2 * size > block_bytes, None
    if several:
        docs, clean = _suspects(docs, held, text_col, "t", size, least)
        held = held.distinct()
    for texts, _ in _blocks(held, size, block_bytes):
        items = spark.sparkContext.broadcast(texts)

        def run(batches, items=items):
            block_ = Items(items.value)
            for batch in batches:
                texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
                bad = {a + x[0] for a, b in chunks(texts) for x in find(texts[a:b], block_, least)}
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
        docs = checkpointed(docs) if several else docs
    return docs.union(clean) if several else docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
