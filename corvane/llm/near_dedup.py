"""Near-duplicate classes: improved consistent weighted sampling over tf-idf shingles, banded and verified.

Shingles are five consecutive words (a shorter text is one shingle). A shingle's weight is (1 + ln tf) * idf. Its idf is taken
from its words, LEAST_IDF + (1 - LEAST_IDF) times the mean of theirs, since a shingle's own document frequency is that of
its group of copies. A word's idf is ln((1 + N) / (1 + df)) / ln(1 + min(N, RARE)), 1 at most, in 256 steps; df is counted
exactly over all documents, and only words in one document of RARE or more are told apart, which bounds the broadcast by RARE times the words of
an average text at any input.

1. One pass counts the words' documents; one pass draws BANDS * ROWS consistent samples a text and emits one key a band.
2. Equal texts are one node. In each bucket every node meets one leader, chosen anew in each band. Pairs of which at least
   least_agreeing of all samples agree (one at the threshold is missed with probability MISSED at most) are verified by exact
   weighted Jaccard similarity of the whole texts. Then the leader leaves, having met all; nodes linked to it stay, since the hub
   of a group may be among them. A bucket whose nodes are all linked to one leader is done. The second and third leaders are
   the nodes with most links, which finds hubs.
3. What is left in a bucket, unless it is one component already, is met in full: salted blocks compare the samples of all pairs of
   different components, then blocks with texts verify the likely ones. A bucket of n unlinked nodes costs n**2 / 2 comparisons.
4. Components of the verified links come from alternating large and small stars. The class id is the least doc_id.

Defined results: equal texts share a class, empty texts too; a null text is a class of its own per id; a null id counts as
larger than all others; repeated rows share a class and one of them is kept; texts of any length are compared whole; extra columns are
passed on, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, bounded_batches, checkpointed, chunks, free_name, grams, mix, prefix, ranges, segments, shuffle_partitions, table, texts_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
LEAST_IDF, RARE = 0.25, 4096
MISSED = 1e-6
LEADERS, SIGN_BLOCK, TEXT_BLOCK = 3, 2_048, 256
_BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
_SIGN_COLUMNS = [f"s{i}" for i in range(BANDS * ROWS // 8)]
PAIRS_A_TASK, _WORDS_HELD = 1_000, 1_000_000
_BITS = 46
_MASK, _CODE = U64((1 << _BITS) - 1), U64(0xFF)
_rng = np.random.default_rng(1913)
_MUL = (_rng.integers(0, 2**31, (BANDS * ROWS, 4), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
#: Quantiles of Gamma(2, 1), for r and for ln c, by bisection of its distribution function 1 - (1 + x) e**-x.


def _gamma2(n: int) -> np.ndarray:
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_R = _gamma2(1 << 12).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_gamma2(1 << 16)).astype(np.float32)


class Idf:
    """The idf of words in 256 steps: those of the given hashes (_BITS bits), and 255 of all others."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], codes[order].astype(np.uint8)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> U64(_BITS - 20)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        h = h & _MASK
        out = np.full(len(h), 255, np.int64)
        at = np.flatnonzero(self.maybe[(h >> U64(_BITS - 20)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[i] == h[at]
            out[at[same]] = self.codes[i[same]]
        return out


NO_IDF = Idf(np.zeros(0, U64), np.zeros(0, np.uint8))


def shingles(texts: list[bytes], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text's index, hash and count of each distinct shingle, by text and hash. A hash's low byte is the mean of its words' idf."""
    w = Words(texts)
    h = w.hashes()
    n = np.diff(w.of)
    codes = np.zeros(w.n + 1, np.int64)
    np.cumsum(idf.of(h), out=codes[1:])
    coded = lambda g, a, k: (g & _MASK & ~_CODE) | ((codes[a + k] - codes[a]) // k).astype(U64)
    ok = np.flatnonzero(segments(w.of, SHINGLE))
    doc = w.docs()
    g, d = coded(grams(h, SHINGLE)[ok], ok, SHINGLE) if len(ok) else np.zeros(0, U64), doc[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        a = w.of[short]
        g = np.concatenate([g, coded(mix(ranges(prefix(h), a, w.of[short + 1]) + U64(1)), a, n[short])])
        d = np.concatenate([d, short])
    s = np.sort((d.astype(U64) << U64(_BITS)) | g)
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    f = np.flatnonzero(first)
    return (s[f] >> U64(_BITS)).astype(np.int64), s[f] & _MASK, np.diff(np.append(f, len(s)))


def weights(h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf of shingles."""
    return (1 + np.log(tf)) * (LEAST_IDF + (1 - LEAST_IDF) / 255 * (h & _CODE).astype(np.float64))


def _documents_of_words(batches):
    """(word, n): documents that hold the word; word 0 stands for all documents. Sums go out whenever _WORDS_HELD words are held."""
    words, counts, held = [], [], 0

    def merged():
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        return word, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        texts = texts_of(batch.column(0))
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            pair = np.sort(((w.hashes() & _MASK) << U64(64 - _BITS)) | w.docs().astype(U64))  # a batch has fewer than 2**18 rows
            word = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]] >> U64(64 - _BITS)
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            word, n = word[edge], np.diff(np.append(edge, len(word)))
            words.append(np.append(0, word.astype(np.int64)))
            counts.append(np.append(b - a, n))
            held += len(n)
            if held > _WORDS_HELD:
                word, n = merged()
                words, counts, held = [word], [n], len(n)
                if held > _WORDS_HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])
                    words, counts, held = [], [], 0
    if words:
        word, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])


def idf_of_words(docs: DataFrame, text_col: str) -> Idf:
    """The idf of the words that one document of RARE or more holds: RARE times the words of an average text at most."""
    df = checkpointed(docs.select(text_col).mapInArrow(_documents_of_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n = (df.where("word = 0").first() or [0, 0])[1]
    common = df.where((F.col("word") != 0) & (F.col("n") * RARE >= n)).toArrow() if n else None
    if common is None or not common.num_rows:
        return NO_IDF
    some = common["n"].to_numpy()
    idf = np.minimum(1, np.log((1 + n) / (1 + some)) / np.log(1 + min(n, RARE)))
    return Idf(common["word"].to_numpy().astype(U64), np.round(255 * np.maximum(idf, 0)))


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys for each text, from BANDS * ROWS consistent weighted samples (0 for a text without shingles), and a byte of each sample."""
    out, signs = np.zeros((texts, BANDS), U64), np.zeros((texts, BANDS * ROWS), np.uint8)
    if not len(doc):
        return out, signs
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(starts, len(doc)))
    owner = np.repeat(np.arange(len(starts)), size)
    x = mix(h + U64(1))
    lo, hi = x.astype(np.uint32), (x >> U64(32)).astype(np.uint32)
    ln_w = np.log(weight).astype(np.float32)
    key = np.zeros((len(starts), BANDS), U64)
    for i, (a1, b1, a2, b2) in enumerate(_MUL):
        u = lo * a1 + hi * b1
        u ^= u >> np.uint32(15)
        u *= np.uint32(0x2C1B3C6D)
        at = u >> np.uint32(20)
        beta = (u & np.uint32(0xFFFFF)).astype(np.float32) * np.float32(2**-20)
        t = np.floor(ln_w * _INV_R[at] + beta)
        v = lo * a2 + hi * b2
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x297A2D39)
        cost = _LN_C[v >> np.uint32(16)] - _R[at] * (t - beta + np.float32(1))
        best = np.flatnonzero(cost == np.minimum.reduceat(cost, starts)[owner])
        who = owner[best]
        best = best[np.append(True, who[1:] != who[:-1])]
        drawn = mix(x[best] ^ mix(t[best].astype(np.int64).view(U64) + U64(i)))
        signs[doc[starts], i] = drawn >> U64(56)
        band = i // ROWS
        key[:, band] = mix(key[:, band] + drawn + U64(band + 1))
    out[doc[starts]] = key | U64(1)
    return out, signs


def _sign(idf):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            keys, signs = [np.zeros((0, BANDS), U64)], [np.zeros((0, BANDS * ROWS), np.uint8)]
            for a, b in chunks(texts, 512 << 10):  # what the draws work on stays in the cache
                doc, h, tf = shingles(texts[a:b], idf.value)
                key, sign = samples(doc, h, weights(h, tf), b - a)
                keys.append(key)
                signs.append(sign)
            longs = np.concatenate([np.concatenate(keys).view(np.int64), np.concatenate(signs).view(np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in longs.T)], ["key", *_BAND_COLUMNS, *_SIGN_COLUMNS])

    return run


def similarities(left: list[bytes], right: list[bytes], idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (da, ha, ta), (db, hb, tb) = shingles(left, idf), shingles(right, idf)
    wa, wb = weights(ha, ta), weights(hb, tb)
    total = np.bincount(da, wa, len(left)) + np.bincount(db, wb, len(left))
    s = np.concatenate([(d.astype(U64) << U64(_BITS)) | h for d, h in ((da, ha), (db, hb))])
    w = np.concatenate([wa, wb])
    order = np.argsort(s, kind="stable")
    s, w = s[order], w[order]
    both = np.flatnonzero(s[1:] == s[:-1])
    shared = np.bincount((s[both] >> U64(_BITS)).astype(np.int64), np.minimum(w[both], w[both + 1]), len(left))
    return np.where(total > 0, shared / np.maximum(total - shared, 1e-12), 1.0)


def least_agreeing(similarity: float) -> int:
    """The most samples that may be asked to agree: fewer do so with probability MISSED at most, at this similarity."""
    n, below = BANDS * ROWS, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > MISSED:
            return k
    return n


def _likely(least: int):
    """Pairs of which at least so many samples agree."""

    def run(batches):
        for batch in batches:
            left, right = (np.stack([batch.column(k).to_numpy() for k in range(at, at + len(_SIGN_COLUMNS))], axis=1).view(np.uint8) for at in (2, 2 + len(_SIGN_COLUMNS)))
            agree = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(agree), batch.column(1).filter(agree)], ["head", "other"])

    return run


def _verify(idf):
    def run(batches):
        for batch in batches:
            left, right = texts_of(batch.column(2)), texts_of(batch.column(3))
            got = [similarities(left[a:b], right[a:b], idf.value) for a, b in chunks([x + y for x, y in zip(left, right, strict=True)], 2 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(got) if got else np.zeros(0))], ["a", "b", "similarity"])

    return run


def _candidates(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block, of different components, of which at least so many samples agree; each in the first band it shares."""
    matrix = lambda names: np.stack([t[c].to_numpy() for c in names], axis=1)
    signs, bands = np.ascontiguousarray(matrix(_SIGN_COLUMNS)).view(np.uint8), matrix(_BAND_COLUMNS)
    label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    salt, band = t["salt"].to_numpy(), t["band"][0].as_py()
    left, right = np.flatnonzero(salt == t["i"][0].as_py()), np.flatnonzero(salt == t["j"][0].as_py())
    same = t["i"][0].as_py() == t["j"][0].as_py()
    got = [(left[:0], right[:0])]
    for at in range(0, len(left), 256):
        l = left[at : at + 256]
        agree = np.zeros((len(l), len(right)), np.uint8)
        for k in range(BANDS * ROWS):
            agree += signs[l, k][:, None] == signs[right, k]
        x, y = np.nonzero((agree >= least) & (label[l][:, None] != label[right]))
        x, y = l[x], right[y]
        if same:
            x, y = x[x < y], y[x < y]
        for c in range(0, len(x), 1 << 16):
            u, v = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
            mine = (bands[u] == bands[v]).argmax(axis=1) == band
            got.append((u[mine], v[mine]))
    return np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])


def _partners(least: int):
    """The nodes of a block that have a likely pair there."""
    return lambda t: t.take(np.unique(np.concatenate(_candidates(t, least)))).select(["bucket", "key"])


def _verify_block(idf, similarity: float):
    def run(t: pa.Table) -> pa.Table:
        x, y = _candidates(t, least_agreeing(similarity))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        doc, h, tf = shingles(texts_of(t["text"]), idf.value)
        weight = weights(h, tf)
        ids = np.unique(h, return_inverse=True)[1]
        of = np.searchsorted(doc, np.arange(len(t) + 1))
        total = np.bincount(doc, weight, len(t))
        dense = np.zeros(len(h))
        part = t["label"].combine_chunks().dictionary_encode().indices.to_numpy().copy()  # components, as the block's links join them
        a, b = [], []
        for u, end in zip(*np.unique(x, return_counts=True), strict=True):
            first = np.searchsorted(x, u)
            mine = y[first : first + end]
            mine = mine[part[mine] != part[u]]
            own = slice(of[u], of[u + 1])
            dense[ids[own]] = weight[own]
            for v in mine.tolist():
                if part[v] == part[u]:
                    continue
                other = slice(of[v], of[v + 1])
                shared = np.minimum(weight[other], dense[ids[other]]).sum()
                if shared >= similarity * (total[u] + total[v] - shared):
                    a.append(u)
                    b.append(v)
                    part[part == part[v]] = part[u]
            dense[ids[own]] = 0
        keys = t["key"].combine_chunks()
        return pa.table({"a": keys.take(pa.array(a, pa.int64())), "b": keys.take(pa.array(b, pa.int64()))})

    return run


def _blocks(rows: DataFrame, each: int) -> DataFrame:
    """rows of buckets with more than one component, once in every block (bucket, i, j) of pairs of salts they belong to."""
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    salts = F.ceil(F.col("n") / each).cast("int")
    salted = rows.join(size.select("bucket", salts.alias("salts")), "bucket").withColumn("salt", F.pmod(F.xxhash64("key", "bucket", F.lit(1)), F.col("salts")).cast("int"))
    paired = salted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return paired.withColumn("i", F.least("salt", "with")).withColumn("j", F.greatest("salt", "with")).drop("salts", "with")


def met_in_full(rows: DataFrame, marks: DataFrame, texts: DataFrame, links: DataFrame | None, idf, similarity: float, n: int) -> DataFrame:
    """The links (a, b) among the nodes left in the buckets of rows (key, bucket, band), n of them, that join components of links."""
    rows = sized(rows.join(marks, "key"), n)
    if links is not None:
        rows = sized(rows.join(components(links).toDF("key", "label"), "key", "left"), n)
    else:
        rows = rows.withColumn("label", F.lit(None).cast("binary"))
    rows = checkpointed(rows.withColumn("label", F.coalesce("label", "key")))
    some = _blocks(rows, SIGN_BLOCK).groupBy("bucket", "i", "j").applyInArrow(_partners(least_agreeing(similarity)), "bucket long, key binary").distinct()
    some = checkpointed(some)
    of_texts = _blocks(rows.join(some, ["bucket", "key"], "left_semi"), TEXT_BLOCK).join(texts, "key")
    return checkpointed(of_texts.groupBy("bucket", "i", "j").applyInArrow(_verify_block(idf, similarity), "a binary, b binary").distinct())


def with_texts(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, ta, tb) of pairs (head, other): the other's text first, then the head's, dealt over a salt for PAIRS_A_TASK pairs, so
    that the text of a head with many pairs is copied once a salt."""
    many = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("salts"))
    others = sized(pairs.join(texts.toDF("other", "tb"), "other"), n, 2_000).join(many, "head")
    others = others.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int")).drop("salts")
    heads = many.join(texts.toDF("head", "ta"), "head").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return others.join(heads, ["head", "salt"]).select("head", "other", "ta", "tb")


def sized(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in as many partitions as so many rows need: small rounds leave few files."""
    return df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), rows // each + 1)))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b), the label being the least node of the component; by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = checkpointed(edges), None
    rows = edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = checkpointed(sized(sized(large, rows).distinct(), rows))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").union(least.select(F.col("u").alias("x"), "m"))
        edges = checkpointed(sized(sized(small.select(F.col("x").alias("u"), F.col("m").alias("v")), rows).distinct(), rows))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, rows = now, now[0]


def key_of(id_col: str, text_col: str):
    """Equal for equal texts, another for each null text's id."""
    alone = F.concat(F.lit("null text of "), F.coalesce(F.col(id_col).cast("string"), F.lit("no id")))
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("text "), F.col(text_col)), alone).cast("binary")))


def classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(key, label) of all keys. docs: id, key, text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    idf = spark.sparkContext.broadcast(idf_of_words(docs, "text"))
    bands, columns = _BAND_COLUMNS, [*_BAND_COLUMNS, *_SIGN_COLUMNS]
    drawn = docs.select("key", "text").mapInArrow(_sign(idf), f"key binary, {', '.join(f'{b} long' for b in columns)}")
    signed = checkpointed(drawn.where("b0 <> 0").groupBy("key").agg(*(F.first(b).alias(b) for b in columns)))
    rows = signed.select("key", F.posexplode(F.array(*bands)).alias("band", "part")).select("key", F.xxhash64("band", "part").alias("bucket"), "band")
    texts, links, degree, level, n = None, None, None, 0, None
    while True:
        fit = (lambda df, n=n: df) if n is None else (lambda df, n=n: sized(df, n))
        ranked = rows.withColumn("degree", F.lit(0)) if degree is None else rows.join(degree, "key", "left")
        first = F.min(F.struct(-F.coalesce("degree", F.lit(0)), F.xxhash64("key", "bucket").alias("o"), "key")).alias("head")
        heads = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), first)
        heads = checkpointed(fit(heads.where("n > 1").select("bucket", F.col("head.key").alias("head"))))
        met = checkpointed(fit(rows.join(heads, "bucket").where("key <> head").select("bucket", "band", "key", "head")))
        n = met.count()
        if not n:
            break
        met = sized(met, n)
        if texts is None:  # the marks and texts of all nodes that ever meet another
            nodes = met.select("key").union(met.select(F.col("head").alias("key"))).distinct()
            nodes = checkpointed(sized(nodes, n))
            marks = checkpointed(sized(signed.join(nodes, "key", "left_semi"), n))
            texts = docs.select("key", "text").join(nodes, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
            texts = checkpointed(sized(texts, n, 2_000))
        pairs = sized(met.select("head", F.col("key").alias("other")).distinct(), n)
        signs = marks.select("key", *_SIGN_COLUMNS)
        left, right = ([f"{x}{c}" for c in _SIGN_COLUMNS] for x in "lr")
        likely = sized(pairs.join(signs.toDF("head", *left), "head"), n).join(signs.toDF("other", *right), "other")
        likely = likely.select("head", "other", *left, *right).mapInArrow(_likely(least_agreeing(similarity)), "head binary, other binary")
        likely = checkpointed(sized(likely, n))
        tested = with_texts(likely, texts, n).mapInArrow(_verify(idf), "a binary, b binary, similarity double")
        tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
        found = checkpointed(sized(tested.where(F.col("similarity") >= similarity).select("a", "b"), n, 2_000))
        links = found if links is None else links.union(found)
        degree = checkpointed(sized(links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("degree")), n))
        apart = met.withColumn("a", F.least("key", "head")).withColumn("b", F.greatest("key", "head")).join(found, ["a", "b"], "left_anti")
        rest = met.join(apart.select("bucket").distinct(), "bucket", "left_semi")  # elsewhere all are linked to the leader
        level += 1
        rows = checkpointed(sized(rest.select("key", "bucket", "band"), n))
        if level == LEADERS:
            n = rows.count()
            if n:
                links = links.union(met_in_full(rows, marks, texts, links, idf, similarity, n))
            break
    if links is None:
        links = spark.createDataFrame([], "a binary, b binary")
    keys = docs.select("key").distinct().join(components(links).toDF("key", "label"), "key", "left")
    return keys.select("key", F.coalesce("label", "key").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), kept (doc_id is class_id)."""
    rows = docs.select(F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    label = classes(rows, similarity=similarity)
    ids = rows.groupBy("key").agg(F.min("id").alias("least")).join(label, "key")
    named = checkpointed(ids.select("key", "label", "least"))
    by_label = named.groupBy("label").agg(F.min("least").alias("class_id"))
    of_key = named.join(by_label, "label").select("key", "class_id")
    got = rows.select("key", F.col("id").alias("doc_id")).join(of_key, "key")
    return got.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with one row of each class left: that of the least doc_id."""
    rows = docs.select(F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    label = classes(rows, similarity=similarity)
    counted = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).join(label, "key")
    best = counted.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("x"))
    best = best.select("x.key", "x.id", "x.n").alias("best")
    key = free_name("__key", docs.columns)
    keyed = docs.withColumn(key, key_of(id_col, text_col)).alias("docs")
    same = (F.col(f"docs.`{key}`") == F.col("best.key")) & F.col(f"docs.`{id_col}`").eqNullSafe(F.col("best.id"))
    columns = [F.col(f"docs.`{c}`") for c in docs.columns]
    once = keyed.join(best.where("n = 1"), same).select(columns)
    again = keyed.join(best.where("n > 1"), same).select(*columns, F.col(f"docs.`{key}`")).dropDuplicates([key]).drop(key)
    return once.union(again)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
