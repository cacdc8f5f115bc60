"""Best-fit packing with exact complements.

Texts are tokenised, end with one end id, and only those longer than ``capacity`` are cut. The histogram of piece lengths
(``capacity`` rows at most, whatever the input) goes to the driver, which plans in whole multiplicities: for each length,
longest first, it looks up its gap among single lengths and in an index of the sums of pairs and triples, and consumes
combinations that fill the gap exactly as often as the counts allow; what is left is packed by best fit, longest first. The
index holds each pair of lengths once, by its sum, and is read on from where the counts have run out. A plan is a list of
runs (length, first rank, count, pieces a sequence, first sequence, place); its size follows from the lengths, not the rows.

Pieces of one length are ranked without a gap by counts over (length, salt), so that a length which holds a third of all
rows is dealt over many tasks; a piece's rank finds its run.

Tokens: white-space-parted chunks never share a token, so each distinct chunk is tokenised once a worker; chunks of ASCII
and Latin-1 letters are cut into the tokenizer's pieces, of which new ones go to the model; all other chunks
go through the whole tokenizer. The caches of chunks and pieces are bounded.

Defined results: a null or empty text is its end id alone; null ids are returned as null; repeated rows are packed each
for itself; texts of any length are packed whole; an empty table gives an empty result; extra columns of documents play no
part, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, bounded_batches, checkpointed, chunks, shuffle_partitions, table, texts_of

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
_CACHE_ROWS = 1_500_000
_CACHE_PIECES = 400_000
#: The tokenizer file's own pattern, for chunks parted by single spaces, underscores counting as neither letter nor digit.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+| ")
#: Letters of ASCII and Latin-1 and ASCII signs: lower case and composition act on each alone here.
_PLAIN = re.compile(r"[ !-~À-ÖØ-öø-ÿ]+")


class Tokens:
    """Ids of white-space-parted chunks, each distinct one tokenised once; a bounded cache by a 64-bit hash that no text can aim at."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(0xC0, 0x100)]}
        self.clear()
        self.clear_pieces()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def clear_pieces(self) -> None:
        self.pieces = {" ": 0}  # the rows of piece_at and piece_size; a space ends a chunk
        self.piece_ids = np.zeros(0, np.uint32)
        self.piece_at = self.piece_size = np.zeros(1, np.int64)

    def chunks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, each of which a space ends, and how many each has."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        texts = text.split(" ")[:-1]
        plain = [bool(_PLAIN.fullmatch(x)) and "<|" not in x for x in texts]
        odd = [self.whole.encode(x, add_special_tokens=False).ids for x, p in zip(texts, plain, strict=True) if not p]
        ids, size = self._plain("".join(f"{x} " for x, p in zip(texts, plain, strict=True) if p))
        is_plain, sizes = np.array(plain, bool), np.zeros(len(texts), np.int64)
        sizes[is_plain], sizes[~is_plain] = size, [len(x) for x in odd]
        out, mine = np.empty(sizes.sum(), np.uint32), np.repeat(is_plain, sizes)
        out[mine], out[~mine] = ids, [t for x in odd for t in x]
        return out, sizes

    def _plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = _PRE.findall(text.lower())
        if len(self.pieces) > _CACHE_PIECES:
            self.clear_pieces()
        new = [p for p in dict.fromkeys(found) if p not in self.pieces]
        if new:
            got = [[t.id for t in self.model.tokenize(p.translate(self.level))] for p in new]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.piece_at = np.concatenate([self.piece_at, len(self.piece_ids) + np.cumsum(size) - size])
            self.piece_size = np.concatenate([self.piece_size, size])
            self.piece_ids = np.concatenate([self.piece_ids, np.array([x for ids in got for x in ids], np.uint32)])
            self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
        row = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ids, bounds = _gathered(self.piece_ids, self.piece_at[row], self.piece_size[row])
        return ids, np.diff(bounds[np.flatnonzero(row == 0)], prepend=0)

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and for each word boundary its place in them."""
        keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE_ROWS:
            self.clear()
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[i] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            start, end = w.starts[first[new]], w.ends[first[new]]
            got, size = self.chunks(_gathered(w.buf, start, end + 1 - start)[0].tobytes().decode())
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, got])
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.at, self.size = np.insert(self.keys, where, keys[new]), np.insert(self.at, where, at), np.insert(self.size, where, size)
            i = np.searchsorted(self.keys, keys)
        row = i[inverse]
        return _gathered(self.flat, self.at[row], self.size[row])


def _gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat from at on, one after the other, and their bounds."""
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    return flat[np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])], bounds


_tokens: dict[str, Tokens] = {}


def _pieces(path: str, capacity: int, end: int, want_ids: bool):
    def run(batches):
        tokens = _tokens.get(path)
        if tokens is None:
            tokens = _tokens[path] = Tokens(path)
        last = np.array([end], np.uint32)
        for batch in batches:
            texts, ids = texts_of(batch.column(1)), batch.column(0)
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                flat, bounds = tokens.of(w) if w.n else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
                edge = bounds[w.of].tolist()
                for k in range(b - a):
                    mine = np.concatenate([flat[edge[k] : edge[k + 1]], last])
                    for piece, at in enumerate(range(0, len(mine), capacity)):
                        part = mine[at : at + capacity]
                        out["row"].append(a + k)
                        out["piece"].append(piece)
                        out["start"].append(at)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part.astype("<u4").tobytes()))
                        if want_ids:
                            out["ids"].append(part.astype(np.int32))
            got = {"doc_id": ids.take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
            got |= {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")}
            if want_ids:
                got["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(got)

    return run


class Sums:
    """An index of length sums: by each sum the pairs, and by pairs the triples, that have it, longest first. Counts only fall, so a
    combination that has run out is never looked at again: each sum keeps the place up to which its list is used up."""

    def __init__(self, left: np.ndarray, most: int):
        self.left = left
        lengths = np.flatnonzero(left[: most + 1])
        i, j = np.triu_indices(len(lengths))
        small, large = lengths[i], lengths[j]
        fits = small + large <= most
        small, large = small[fits], large[fits]
        order = np.lexsort((-large, small + large))
        self.larger = large[order]
        self.edge = np.searchsorted((small + large)[order], np.arange(most + 2))
        self.at = self.edge[:-1].copy()
        self.lengths = lengths[::-1]  # longest first
        self.third = np.zeros(most + 1, np.int64)  # by sum: how many of the lengths have no pair left

    def pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """A pair with this sum that is to be had, none longer than ``longest``."""
        while self.at[total] < self.edge[total + 1]:
            a = int(self.larger[self.at[total]])
            b = total - a
            if a <= longest and self.left[a] > 0 and self.left[b] > (a == b):
                return a, b
            self.at[total] += 1
        return None

    def triple(self, total: int, longest: int) -> tuple[int, int, int] | None:
        """A triple with this sum that is to be had, its first the longest."""
        while self.third[total] < len(self.lengths):
            a = int(self.lengths[self.third[total]])
            if 3 * a < total:
                return None
            if a <= longest and a < total and self.left[a] > 0:
                self.left[a] -= 1
                rest = self._pair_up_to(total - a, a)
                self.left[a] += 1
                if rest:
                    return a, *rest
            self.third[total] += 1
        return None

    def _pair_up_to(self, total: int, longest: int) -> tuple[int, int] | None:
        """As pair, but pairs with a longer piece stay in the list: another first piece may take them."""
        for k in range(self.at[total], self.edge[total + 1]):
            a = int(self.larger[k])
            b = total - a
            if a <= longest and self.left[a] > 0 and self.left[b] > (a == b):
                return a, b
            gone = (a != longest and self.left[a] == 0) or (b != longest and self.left[b] == 0)  # of the first piece one is only lent
            if gone and k == self.at[total]:
                self.at[total] += 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces}, multiplicity) that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, k in histogram.items():
        left[length] = k
    patterns: list[tuple[dict[int, int], int]] = []

    def consume(*lengths: int) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        m = min(int(left[x]) // k for x, k in need.items())
        patterns.append((need, m))
        for x, k in need.items():
            left[x] -= k * m

    if left[capacity]:
        consume(capacity)
    sums = Sums(left, capacity - 1)
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while left[length]:
            left[length] -= 1  # this piece is taken: what fills its gap must be there besides
            single = (gap,) if gap <= length and left[gap] else None
            found = single or sums.pair(gap, length) or sums.triple(gap, length)
            left[length] += 1
            if not found:
                break
            consume(length, *found)
    patterns += _best_fit(left, capacity)
    return patterns


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of all that is left; bins of equal content go together."""
    bins: dict[int, list[list]] = defaultdict(list)  # by free room: [content, multiplicity]
    for length in range(capacity, 0, -1):
        k = int(left[length])
        while k:
            room = min((r for r, x in bins.items() if r >= length and x), default=0)
            if room:
                content, m = bins[room].pop()
                each = min(room // length, max(1, k // m))
                used = min(m, k // each)
                if used < m:
                    bins[room].append([content, m - used])
                bins[room - each * length].append([{**content, length: content.get(length, 0) + each}, used])
                k -= each * used
            else:
                each = min(k, capacity // length)
                used = k // each
                bins[capacity - each * length].append([{length: each}, used])
                k -= each * used
    return [(content, m) for some in bins.values() for content, m in some]


def _runs(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, place), by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for content, m in patterns:
        place = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, rank[length], each, sequence, place))
            rank[length] += each * m
            place += each * length
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(runs: np.ndarray):
    key = (runs[:, 0] << 48) | runs[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            i = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            _, first, each, sequence, place = runs[i].T
            new = {"sequence_id": sequence + (rank - first) // each, "offset": place + (rank - first) % each * length}
            keep = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(x, pa.int64()) for x in new.values())], [*keep, *new])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, want_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. tokenizer: a file's path; by
    default that of the public vocabulary, looked up where it is installed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * want_ids
    pieces = checkpointed(docs.select(id_col, text_col).mapInArrow(_pieces(tokenizer, capacity, end, want_ids), schema))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    salts = max(4 * shuffle_partitions(spark), sum(histogram.values()) // 50_000)
    keyed = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = keyed.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("__k", F.row_number().over(order) - 1).join(before, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", (F.col("__k") + F.col("__before")).cast("long")).select(*pieces.columns, "__rank")
    return ranked.mapInArrow(_place(_runs(plan(histogram, capacity))), f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
