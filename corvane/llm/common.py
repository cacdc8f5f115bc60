"""What the training-data operators share: numpy tokenising and hashing of text batches, and session helpers.

Words are the runs of bytes other than space and \\x09-\\x0D. A word of up to PLACES bytes is hashed eight bytes at a time, each
step a bijection of its state mixed with them, so that words of up to eight bytes never collide; a longer one by xxh3. Short
runs of words are hashed by polynomials modulo 2**64 over the words' hashes, so that any range follows from two prefix sums;
these stay sound for runs of tens of words, and longer ranges are hashed as sums over (window, place), see ``range_marks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.iterate import cut as checkpointed  # noqa: F401

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACES = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
BATCH_BYTES = 16 << 20
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most: the operators' memory in Python follows the batch. All operators ask for the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that none of those taken equals, capitals aside, as Spark compares them."""
    held = {c.lower() for c in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def without(df: DataFrame, added) -> DataFrame:
    """df less the columns named like an added one, capitals aside."""
    held = {c.lower() for c in added}
    return df.drop(*[c for c in df.columns if c.lower() in held])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = _BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    got = _pows.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        got = _pows[base] = (both[0], both[1])
    return got


def prefix(symbols: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Prefix sums of symbols[i] * base**i, with a leading 0."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(len(symbols), base)[0][: len(symbols)], out=out[1:])
    return out


def ranges(sums: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Hashes of the ranges [a, b), wherever they stand."""
    return (sums[b] - sums[a]) * powers(len(sums), base)[1][a]


def grams(symbols: np.ndarray, n: int, base: int = _BASES[0]) -> np.ndarray:
    """Mixed hashes of all n consecutive symbols; as many as there are starts (none if too short)."""
    k = len(symbols) - n + 1
    if k <= 0:
        return np.zeros(0, U64)
    sums = prefix(symbols, base)
    return mix((sums[n:] - sums[:k]) * powers(len(sums), base)[1][:k])


def range_marks(windows: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of windows [first, first + size), given the windows' hashes: sums over (window, place), no polynomial."""
    total = int(size.sum())
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    got = mix(windows[np.repeat(first, size) + place] ^ mix(place.astype(U64) + U64(1)))
    sums = np.zeros(total + 1, U64)
    np.cumsum(got, out=sums[1:])
    end = np.cumsum(size)
    return mix(sums[end] - sums[end - size])


class Words:
    """The words of some texts: one buffer in which single spaces part words, word spans and, by text, word ranges."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = _SEP):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        sep = separators[joined]
        keep = ~sep
        keep[1:] |= ~sep[:-1]  # the first separator after a word stays
        self.buf = np.where(sep[keep], np.uint8(32), joined[keep])
        gap = np.flatnonzero(self.buf == 32)
        self.ends = gap
        self.starts = np.zeros(len(gap), np.int64)
        self.starts[1:] = gap[:-1] + 1
        kept = np.zeros(len(joined) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        self.of = np.searchsorted(self.starts, kept[at])  # words of text i: of[i] up to of[i + 1]
        self.n = len(gap)

    def hashes(self, byte_map: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; byte_map folds bytes first."""
        buf = self.buf if byte_map is None else byte_map.astype(np.uint8)[self.buf]
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
        out = np.empty(self.n, U64)
        step = 1 << 17  # words at a time: the temporary arrays stay in the cache
        for i in range(0, self.n, step):
            start, size = self.starts[i : i + step], self.ends[i : i + step] - self.starts[i : i + step]
            h = mix(size.astype(U64) * U64(_BASES[1]))
            h = mix(h ^ (eight[start] & _FIRST_BYTES[np.minimum(size, 8)]))
            for k in range(8, PLACES, 8):
                at = np.flatnonzero(size > k)
                if not len(at):
                    break
                h[at] = mix(h[at] ^ (eight[start[at] + k] & _FIRST_BYTES[np.minimum(size[at] - k, 8)]))
            for k in np.flatnonzero(size > PLACES).tolist():
                h[k] = xxhash.xxh3_64_intdigest(buf[start[k] : start[k] + size[k]].tobytes(), seed=int(size[k]))
            out[i : i + step] = h
        return out

    def docs(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def joined(self, a: int, b: int) -> bytes:
        """The words [a, b), parted by single spaces."""
        return self.buf[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts; null reads as empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def longs_of(column: pa.Array | pa.ChunkedArray, null: int) -> np.ndarray:
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes each (one text at least); small ones keep what is sorted and looked up in the cache."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield a, i
            a, held = i, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(of: np.ndarray, n: int) -> np.ndarray:
    """True where n consecutive words from here on stay in one text, for all starts that fit the batch."""
    total = int(of[-1])
    if total < n:
        return np.zeros(0, bool)
    last = np.repeat(of[1:], np.diff(of))
    return np.arange(total - n + 1) + n <= last[: total - n + 1]
