"""Substring dedup by super-k-mers.

Each run of consecutive windows of ``window`` words that share a minimiser (the least hash of ``gram`` consecutive words)
is one packed string, a super-k-mer. It goes to the bucket of its minimiser; there all windows are hashed, sorted and
counted, and equal hashes are compared as text. Four steps:

1. One pass over the texts counts minimisers in a table of fixed size. Slots that hold far more than their share are
   hot: their minimisers lose to all others, so that a line found everywhere gathers no bucket. Windows made of
   nothing but hot minimisers go into no bucket: their groups send digests of them, whose least doc_id two salted sums find.
2. The documents are dealt into groups of some MB. Each group sends each distinct super-k-mer once, with the least and
   the largest doc_id that hold it: copies inside a group cost nothing.
3. Each bucket finds, for each window, the least doc_id of all groups, and answers the groups whose largest doc_id is larger.
4. Each group reads its texts again and removes what is covered by windows with a smaller doc_id elsewhere.

Words and runs are told apart by 64-bit hashes that no text can aim at (see ``common``); in the buckets, where all groups
meet, equal hashes of windows are compared as text too, and hot windows are told apart by 128-bit BLAKE2 digests of their words.

Defined results: ids are whole numbers (others raise a TypeError); null text has no words; a null id counts as larger than
all ids (2**63 - 1 is taken for it) and is returned as null; repeated rows (equal id) are never removed in favour of each
other; texts under ``window`` words stay whole, texts of any length are read whole; an empty table gives an empty result;
extra columns are passed on, but for those named like an added column (capitals aside), which are dropped.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import U64, Words, bounded_batches, chunks, free_name, grams, longs_of, range_marks, segments, shuffle_partitions, sliding_min, table, texts_of, without

ADDED = ("n_words", "n_removed", "kept_text", "kept_sha256")
_TOP = U64(1 << 63)
_SLOTS = 1 << 18
_NULL_ID = (1 << 63) - 1


class _Runs:
    """The super-k-mers of some texts: key, word range, windows, text's index and content hash of each."""

    def __init__(self, texts: list[bytes], window: int, gram: int, hot: np.ndarray | None):
        self.words = w = Words(texts)
        h = w.hashes()
        ok = segments(w.of, window)
        n = len(ok)
        if not ok.any():
            self.key = self.doc = np.zeros(0, U64)
            self.a = self.windows = np.zeros(0, np.int64)
            self.content = np.zeros(0, U64)
            return
        whole = grams(h, window)
        least = grams(h, gram) >> U64(1)
        if hot is not None:
            least = np.where(hot[least >> U64(63 - 18)], least | _TOP, least)
        key = sliding_min(least, window - gram + 1)[:n]
        if hot is not None and (all_hot := key >= _TOP).any():
            i = np.flatnonzero(all_hot)
            key[i] = whole[i] | _TOP
        doc = w.docs()[:n]
        at = np.flatnonzero(ok)
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        if hot is not None:
            first |= key[at] >= _TOP  # hot windows stand alone
        r = np.flatnonzero(first)
        self.windows = np.diff(np.append(r, len(at)))
        self.a = at[r]
        self.key, self.doc = key[self.a], doc[self.a]
        self.content = range_marks(whole, self.a, self.windows)


def _count_slots(window: int, gram: int):
    def run(batches):
        total, counts = 0, np.zeros(_SLOTS, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            total += sum(map(len, texts))
            for a, b in chunks(texts):
                runs = _Runs(texts[a:b], window, gram, None)
                counts += np.bincount((runs.key >> U64(63 - 18)).astype(np.int64), minlength=_SLOTS)
        z = zstandard.ZstdCompressor()
        parts = counts.reshape(16, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "total": pa.array([total] + [0] * 15, pa.int64()), "counts": pa.array([z.compress(p.tobytes()) for p in parts], pa.binary())})

    return run


def _sum_slots(t: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in t["counts"].to_pylist())
    return pa.table({"part": t["part"][:1], "total": pa.array([sum(t["total"].to_pylist())], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _pack(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays) + text, 1)


def _unpack(blob: bytes, kinds: list[type]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:]


def _send(window: int, gram: int, hot: np.ndarray, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        group = t["__g"][0].as_py()
        ids, texts = longs_of(t["id"], _NULL_ID), texts_of(t["text"])
        out: dict[str, list] = {"__b": [], "__g": [], "blob": []}
        for x, y in chunks(texts, 4 << 20):  # what repeats inside goes out once
            runs = _Runs(texts[x:y], window, gram, hot)
            if not len(runs.key):
                continue
            words, of = runs.words, ids[x:y][runs.doc.astype(np.int64)]
            cold = np.flatnonzero(runs.key < _TOP)
            if not len(cold):
                continue
            order = cold[np.lexsort((runs.content[cold], runs.key[cold]))]
            key, content, of = runs.key[order], runs.content[order], of[order]
            first = np.ones(len(order), bool)
            first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            f = np.flatnonzero(first)
            low, high, one = np.minimum.reduceat(of, f), np.maximum.reduceat(of, f), order[f]
            a, windows = words.starts[runs.a[one]], runs.windows[one]
            b = words.ends[runs.a[one] + windows + window - 2]
            bucket = (key[f] % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[by])) + 1
            buf = words.buf.tobytes()
            for mine in np.split(by, cut):
                text = b" ".join(buf[i:j] for i, j in zip(a[mine].tolist(), b[mine].tolist(), strict=True))
                out["__b"].append(int(bucket[mine[0]]))
                out["__g"].append(group)
                out["blob"].append(_pack([windows[mine].astype(np.int32), low[mine], high[mine]], text))
        return pa.table({"__b": pa.array(out["__b"], pa.int32()), "__g": pa.array(out["__g"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _send_hot(window: int, gram: int, hot: np.ndarray):
    """Each distinct window of hot minimisers alone, once for 4 MB of a group."""

    def run(t: pa.Table) -> pa.Table:
        ids, texts = longs_of(t["id"], _NULL_ID), texts_of(t["text"])
        digests, marks, lows, highs = [], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in chunks(texts, 4 << 20):
            runs = _Runs(texts[x:y], window, gram, hot)
            at = np.flatnonzero(runs.key >= _TOP)
            if not len(at):
                continue
            at = at[np.argsort(runs.content[at], kind="stable")]
            content, of = runs.content[at], ids[x:y][runs.doc[at].astype(np.int64)]
            f = np.flatnonzero(np.append(True, content[1:] != content[:-1]))
            marks.append(content[f])
            lows.append(np.minimum.reduceat(of, f))
            highs.append(np.maximum.reduceat(of, f))
            digests += [hashlib.blake2b(runs.words.joined(a, a + window), digest_size=16).digest() for a in runs.a[at[f]].tolist()]
        group = pa.array([t["__g"][0].as_py()] * len(digests), pa.int32())
        mark, low, high = np.concatenate(marks).view(np.int64), np.concatenate(lows), np.concatenate(highs)
        return pa.table({"__g": group, "digest": pa.array(digests, pa.binary()), "mark": mark, "low": low, "high": high})

    return run


def _hot_answers(rows: DataFrame, salts: int = 64) -> DataFrame:
    """The least id of each digest for the groups that hold a larger one. A digest that all groups hold is summed and answered in salts parts."""
    rows = rows.withColumn("salt", F.pmod("__g", F.lit(salts))).repartition("digest", "salt")
    part = rows.groupBy("digest", "salt").agg(F.min("low").alias("low"))
    least = part.groupBy("digest").agg(F.min("low").alias("least"), F.collect_set("salt").alias("salt"))
    told = least.select("digest", F.explode("salt").alias("salt"), "least")
    return rows.join(told, ["digest", "salt"]).where("least < high").select("__g", F.lit(None).cast("binary").alias("blob"), "mark", "least")


def _least_ids(hashes: np.ndarray, low: np.ndarray, word: np.ndarray, same) -> np.ndarray:
    """For each window the least id of its equals. word: its first word; same(i, j, n): n windows from i and from j on are equal as text."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    f = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    rep = np.empty(len(s), np.int64)
    rep[order] = order[f][group]
    least = np.empty(len(s), np.int64)
    least[order] = np.minimum.reduceat(low[order], f)[group]
    i = np.flatnonzero(rep != np.arange(len(s)))
    if len(i):  # equal hashes: compare runs of them as text
        j = rep[i]
        start = np.ones(len(i), bool)
        start[1:] = (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(word[i]) != 1) | (np.diff(word[j]) != 1)
        at = np.flatnonzero(start)
        n = np.diff(np.append(at, len(i)))
        for x, y, k in zip(i[at].tolist(), j[at].tolist(), n.tolist(), strict=True):
            if not same(x, y, k):
                return _least_exactly(low, same)
    return least


def _least_exactly(low: np.ndarray, same) -> np.ndarray:
    """The same by the windows' own text, for a bucket in which two differing windows share a hash."""
    text, got = same.text, {}
    for i in range(len(low)):
        t = text(i)
        got[t] = min(got.get(t, _NULL_ID), int(low[i]))
    return np.fromiter((got[text(i)] for i in range(len(low))), np.int64, len(low))


def _count(window: int):
    def run(t: pa.Table) -> pa.Table:
        groups = t["__g"].to_numpy()
        texts, windows, low, high, where = [], [], [], [], []
        for g, blob in zip(groups, t["blob"].to_pylist(), strict=True):
            (n, lo, hi), text = _unpack(blob, [np.int32, np.int64, np.int64])
            texts.append(text)
            windows.append(n)
            low.append(lo)
            high.append(hi)
            where.append(np.full(len(n), g))
        n, lo, hi, where = (np.concatenate(x) for x in (windows, low, high, where))
        words = Words(texts)
        whole = grams(words.hashes(), window)
        length = n.astype(np.int64) + window - 1  # in words
        start = np.cumsum(length) - length
        content = range_marks(whole, start, n.astype(np.int64))
        skm = np.repeat(np.arange(len(n)), n)
        at = np.cumsum(n) - n
        word = start[skm] + np.arange(len(skm)) - at[skm]
        hashes = whole[word]
        buf, starts, ends = words.buf.tobytes(), words.starts, words.ends

        def same(i: int, j: int, k: int) -> bool:
            a, b = word[i], word[j]
            return buf[starts[a] : ends[a + k + window - 2]] == buf[starts[b] : ends[b + k + window - 2]]

        same.text = lambda i: buf[starts[word[i]] : ends[word[i] + window - 1]]
        least = _least_ids(hashes, lo[skm], word, same)
        tell = np.flatnonzero(np.minimum.reduceat(least, at) < hi)
        by = defaultdict(list)
        for k in tell.tolist():
            by[int(where[k])].append(k)
        out = {"__g": [], "blob": []}
        for g, ks in by.items():
            out["__g"].append(g)
            out["blob"].append(_pack([content[ks], n[ks], np.concatenate([least[at[k] : at[k] + n[k]] for k in ks])]))
        return pa.table({"__g": pa.array(out["__g"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _remove(id_col: str, text_col: str, window: int, gram: int, hot: np.ndarray, passed: list[str], want_text: bool):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        ids, texts = longs_of(docs[id_col], _NULL_ID), texts_of(docs[text_col])
        told = [_unpack(b, [np.uint64, np.int32, np.int64])[0] for b in hits["blob"].to_pylist() if b is not None]
        single = hits.filter(hits["mark"].is_valid())
        if len(single):
            told.append([longs_of(single["mark"], 0).view(U64), np.ones(len(single), np.int32), longs_of(single["least"], 0)])
        if told:
            content, n, least = (np.concatenate(x) for x in zip(*told, strict=True))
            order = np.argsort(content, kind="stable")
            at = np.cumsum(n) - n
            content, n, at = content[order], n[order], at[order]
        n_words, n_removed, kept, digest = [], [], [], []
        for x, y in chunks(texts):
            runs = _Runs(texts[x:y], window, gram, hot)
            words = runs.words
            gone = np.zeros(words.n, bool)
            if told and len(runs.key):
                i = np.minimum(np.searchsorted(content, runs.content), len(content) - 1)
                found = np.flatnonzero((content[i] == runs.content) & (n[i] == runs.windows))
                if len(found):
                    size = runs.windows[found]
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    smaller = least[np.repeat(at[i[found]], size) + step] < np.repeat(ids[x:y][runs.doc[found].astype(np.int64)], size)
                    first = (np.repeat(runs.a[found], size) + step)[smaller]
                    change = np.zeros(words.n + window + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + window, -1)
                    gone = np.cumsum(change)[: words.n] > 0
            removed = np.zeros(words.n + 1, np.int64)
            np.cumsum(gone, out=removed[1:])
            buf = words.buf.tobytes()
            for k in range(y - x):
                a, b = int(words.of[k]), int(words.of[k + 1])
                less = int(removed[b] - removed[a])
                if less:
                    left = (np.flatnonzero(~gone[a:b]) + a).tolist()
                    text = b" ".join(buf[words.starts[i] : words.ends[i]] for i in left)
                else:
                    text = buf[words.starts[a] : words.ends[b - 1]] if b > a else b""
                n_words.append(b - a)
                n_removed.append(less)
                digest.append(hashlib.sha256(text).hexdigest())
                if want_text:
                    kept.append(text if less else texts[x + k])
        out = {c: docs[c] for c in passed} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        if want_text:
            out["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out | {"kept_sha256": pa.array(digest, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, gram: int = 4, group_bytes: int = 4 << 20, want_text: bool = True) -> DataFrame:
    """The columns of docs and n_words, n_removed, kept_text (the text itself where nothing goes, else the words kept, parted
    by single spaces) and kept_sha256 (of the words kept, parted by single spaces)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers: their order decides what goes")
    docs = without(docs, ADDED)
    if not want_text:
        docs = docs.select(id_col, text_col)
    g = free_name("__g", docs.columns)
    counted = docs.select(text_col).mapInArrow(_count_slots(window, gram), "part int, total long, counts binary")
    counted = counted.groupBy("part").applyInArrow(_sum_slots, "part int, total long, counts binary").collect()  # 16 rows, 2 MB, at any input
    counts = np.zeros((16, _SLOTS // 16), np.int64)
    for row in counted:
        counts[row.part] = np.frombuffer(row.counts, np.int64)
    counts = counts.ravel()
    hot = counts > max(64, counts.sum() / 2048)
    size, parts = sum(row.total for row in counted), shuffle_partitions(spark)
    groups, buckets = max(2 * parts, size // group_bytes), max(8 * parts, 3 * size // (8 << 20))
    dealt = docs.withColumn(g, F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).cast("int")).repartition(g)
    mine = dealt.select(F.col(g).alias("__g"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = mine.groupBy("__g").applyInArrow(_send(window, gram, hot, int(buckets)), "__b int, __g int, blob binary")
    none = F.lit(None).cast("long")
    hits = sent.groupBy("__b").applyInArrow(_count(window), "__g int, blob binary").select("__g", "blob", none.alias("mark"), none.alias("least"))
    if hot.any():
        rows = mine.groupBy("__g").applyInArrow(_send_hot(window, gram, hot), "__g int, digest binary, mark long, low long, high long")
        hits = hits.union(_hot_answers(rows))
    passed = [c for c in docs.columns if want_text or c != text_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in passed)
    more = "n_words long, n_removed long, " + "kept_text string, " * want_text + "kept_sha256 string"
    removed = _remove(id_col, text_col, window, gram, hot, passed, want_text)
    return dealt.groupBy(g).cogroup(hits.groupBy("__g")).applyInArrow(removed, f"{fields}, {more}")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), want_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, hash(list_slice(ws, i, i + 49)) AS h1, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h2
  FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
least AS (SELECT h1, h2, min(doc_id) AS m FROM win GROUP BY h1, h2),
bad AS (SELECT doc_id, i FROM win JOIN least USING (h1, h2) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM bad, unnest(range(0, 50)) AS t(j)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r,
    CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
      ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ps, k)), lambda k: ws[k]), ' ') END AS t
  FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
