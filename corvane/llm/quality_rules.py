"""Quality rules by repetition coverage.

For several lengths n, rolling hashes of all n consecutive words of a text are sorted in numpy; the characters of the words
that lie in an n-gram found twice or more are the n-gram's coverage. Lines are measured likewise. A text is kept if it
passes the base rules, no coverage exceeds its share of the text's characters, and symbols are few.

One map over Arrow batches, without a shuffle; memory follows the batch. Defined results: a null or empty text has no
words and fails the base rule on length; null ids are returned as null; repeated rows are judged each for itself, so that
equal texts get equal verdicts; texts of any length are read whole; an empty table gives an empty result; extra columns are
passed on, but for those named like an added column (capitals aside), which are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Words, bounded_batches, chunks, grams, mix, segments, table, texts_of, without

#: Word n-grams: the most that characters inside duplicated ones may be of all, in per cent.
GRAMS = {3: 45, 5: 35, 10: 30}
BASE_GRAM, BASE_SHARE, LEAST_WORDS = 8, 30, 20
LINE_SHARE, SYMBOL_SHARE = 30, 10
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"dup_chars_{n}" for n in GRAMS), "dup_line_chars")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"dup_chars_{n} long" for n in GRAMS) + ", dup_line_chars long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = b" \t\n\v\f\r"


def covered(hashes: np.ndarray, words: Words, doc: np.ndarray, n: int) -> np.ndarray:
    """True for the words in n-grams that stand twice or more in their text."""
    out = np.zeros(words.n, bool)
    ok = segments(words.of, n)
    if not ok.any():
        return out
    at = np.flatnonzero(ok)
    h = (grams(hashes, n) ^ mix(doc[: len(ok)].astype(U64) + U64(1)))[at]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return out
    i = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    first = at[twice[i] == h]
    change = np.zeros(words.n + n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n, -1)
    return np.cumsum(change)[: words.n] > 0


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of the words in all lines found twice or more."""
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0, 0
    count: dict[bytes, int] = {}
    for x in lines:
        count[x] = count.get(x, 0) + 1
    again = chars = 0
    for x, k in count.items():
        if k > 1 and (bare := x.translate(None, _SPACES)):
            again += k - 1
            chars += k * len(bare.decode("utf-8", "replace"))
    return again, chars


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = Words(texts)
    of = w.of
    h, doc = w.hashes(), w.docs()
    n = np.diff(of)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    points = total((w.buf & 0xC0) != 0x80)
    chars = points[w.ends] - points[w.starts]
    by_word = total(chars)
    per_doc = lambda sums: sums[of[1:]] - sums[of[:-1]]
    symbols = total(_SYMBOL[w.buf])
    edge = np.append(w.starts, len(w.buf))
    out = {"n_words": n, "word_chars": per_doc(by_word), "n_symbols": symbols[edge[of[1:]]] - symbols[edge[of[:-1]]]}
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    out["n_dup_lines"] = lines[:, 0]
    out["n_repeat_words"] = per_doc(total(covered(h, w, doc, BASE_GRAM)))
    out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > BASE_SHARE * n)
    bad = out["base_failed"] | (100 * out["n_symbols"] > SYMBOL_SHARE * n) | (100 * lines[:, 1] > LINE_SHARE * out["word_chars"])
    more = {}
    for k, share in GRAMS.items():
        more[f"dup_chars_{k}"] = per_doc(total(np.where(covered(h, w, doc, k), chars, 0)))
        bad |= 100 * more[f"dup_chars_{k}"] > share * out["word_chars"]
    return out | {"kept": ~bad} | more | {"dup_line_chars": lines[:, 1]}


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs and those of SCHEMA."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            parts = [measure(texts[a:b]) for a, b in chunks(texts, 512 << 10)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if parts:
                new = [pa.array(np.concatenate([p[c] for p in parts])) for c in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, {SCHEMA}")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.drop("text")


_COVERED = ", ".join(f"({n})" for n in (*GRAMS, BASE_GRAM))
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT unnest AS n FROM unnest([{", ".join(str(n) for n in (*GRAMS, BASE_GRAM))}])),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM d, n, unnest(range(1, len(ws) - n + 2)) AS t(i)),
twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM g) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, n, i + j AS p FROM twice, unnest(range(0, n)) AS t(j)),
c AS (SELECT doc_id, n, count(*) AS k, sum(length(ws[p])) AS chars FROM cov JOIN d USING (doc_id) GROUP BY doc_id, n),
l AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dl AS (SELECT doc_id, sum(k - 1) AS again, sum(CASE WHEN k > 1 THEN k * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) ELSE 0 END) AS chars FROM l GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(again, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce((SELECT k FROM c WHERE c.doc_id = d.doc_id AND n = {BASE_GRAM}), 0) AS BIGINT) AS n_repeat_words,
    {", ".join(f"CAST(coalesce((SELECT chars FROM c WHERE c.doc_id = d.doc_id AND n = {n}), 0) AS BIGINT) AS dup_chars_{n}" for n in GRAMS)},
    CAST(coalesce(dl.chars, 0) AS BIGINT) AS dup_line_chars
  FROM d LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR 100 * n_symbols > {SYMBOL_SHARE} * n_words OR 100 * dup_line_chars > {LINE_SHARE} * word_chars
  OR {" OR ".join(f"100 * dup_chars_{n} > {s} * word_chars" for n, s in GRAMS.items())}) AS kept FROM b
"""
