"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words is trained in numpy from confirmed toxic texts (P) and unlabelled ones (U), whose
labels it never sees, by the non-negative risk  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the logistic
loss l; where the bracket turns negative, its gradient is stepped back. pi, the class prior, is the toxic share of the
labelled rows. The risk alone decides on the weights, and so on the order of the scores. Their scale comes from cross-fitting: each of three folds
is scored by a model of the other two, and the logit that parts its labelled rows best is put at THRESHOLD. Labelled rows set that one
number, since the cut that the PU risk implies moves with pi, and the share among labelled rows need not be that among all. Rows whose
crc32(doc_id as text) mod 4 is HELD_OUT lend neither labels nor text to the training.

Features are the words found in LEAST_DF toxic texts at least (the VOCABULARY most frequent) that are more frequent there than among all
documents; their frequencies are counted over all held-in documents in one pass. The gradient uses samples drawn by hash: POSITIVES
and LABELLED labelled rows and about UNLABELLED unlabelled ones at most, of which only feature numbers reach the driver.
Every text is scored whole, in one map.

Words are runs of letters and digits (and of all bytes beyond ASCII), ASCII letters in lower case. Defined results: null and
empty texts get the score of a text without a known word; null ids are held in and returned as null; a label without 0 or 1
or without a doc_id is passed over, of repeated labels the largest holds, of repeated ids the least text is the labelled one; without toxic
labels, or texts for them, all scores are 0; repeated rows get equal scores; texts of any length are read whole; an empty table gives an empty
result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bounded_batches, checkpointed, chunks, table, texts_of

POSITIVES, LABELLED, UNLABELLED, VOCABULARY = 6_000, 12_000, 18_000, 50_000
THRESHOLD, HELD_OUT, FOLDS = 0.3, 2, (0, 1, 3)
LEAST_DF, SHRINK, LEAST_LIFT = 3, 2.0, 0.5
ROUNDS, MOMENTUM, DECAY = 150, 0.9, 1e-5
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text's index and hash of each word."""
    w = Words(texts, _NOT_WORD)
    return w.docs(), w.hashes(_FOLD)


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text's index and hash of each distinct word of each text."""
    doc, h = word_hashes(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], h[first]


def _words_in(batches):
    """(word, n): texts of a batch that hold the word."""
    for batch in batches:
        texts = texts_of(batch.column(0))
        for a, b in chunks(texts):
            word, n = np.unique(distinct_words(texts[a:b])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


class Known:
    """Places of hashes in a sorted vocabulary."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)]) if len(self.vocabulary) else np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, h[at]), max(len(self.vocabulary) - 1, 0))
        same = np.flatnonzero(self.vocabulary[i] == h[at]) if len(at) else at
        return at[same], i[same]

    def presence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text's index and place of each known word of each text, once."""
        doc, h = word_hashes(texts)
        at, i = self.find(h)
        width = max(len(self.vocabulary), 1)
        one = np.unique(doc[at] * width + i)
        return one // width, one % width


def _count_known(vocabulary):
    """(place, n): texts of a task that hold the word of the vocabulary; place -1 stands for all texts."""

    def run(batches):
        known, texts_seen = Known(vocabulary.value), 0
        counts = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            texts_seen += len(texts)
            for a, b in chunks(texts):
                counts += np.bincount(known.presence(texts[a:b])[1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(texts_seen, counts[some]))], ["place", "n"])

    return run


def _features(vocabulary):
    def run(batches):
        known = Known(vocabulary.value)
        for batch in batches:
            texts = texts_of(batch.column(2))
            out = []
            for a, b in chunks(texts):
                doc, i = known.presence(texts[a:b])
                at = np.searchsorted(doc, np.arange(b - a + 1))
                out += [i[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["mod", "part", "places"])

    return run


class Sparse:
    """Rows of feature values. rows: the places of each row's features; value: of each feature."""

    def __init__(self, rows: list[np.ndarray], value: np.ndarray):
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.feature = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        use = value[self.feature] != 0
        self.row, self.feature = self.row[use], self.feature[use]
        self.value = value[self.feature]
        self.n, self.width = len(rows), len(value)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature] * self.value, self.n)

    def gradient(self, each: np.ndarray) -> np.ndarray:
        """Of the weights and, last, of the bias."""
        return np.append(np.bincount(self.feature, each[self.row] * self.value, self.width), each.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def risk(p: Sparse, u: Sparse, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * E_P[l(g)] and the bracket E_U[l(-g)] - prior * E_P[l(-g)], with the gradient of each (bias last)."""
    zp, zu = p.times(w) + b, u.times(w) + b
    gp, gu = _sigmoid(zp), _sigmoid(zu)
    positive = prior * np.mean(np.logaddexp(0, -zp))
    bracket = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp)) if u.n else -prior * np.mean(np.logaddexp(0, zp))
    return float(positive), float(bracket), prior * p.gradient((gp - 1) / p.n), u.gradient(gu / max(u.n, 1)) - prior * p.gradient(gp / p.n)


def lifts(in_toxic: np.ndarray, toxic: int, in_all: np.ndarray, all_: int) -> np.ndarray:
    """How much more often, as a logarithm, each word stands in toxic texts than in all, shrunk towards 0; 0 for those that are no feature."""
    q = (in_all + 0.5) / (all_ + 1)
    lift = np.log((in_toxic + SHRINK * q) / (toxic + SHRINK) / q)
    return np.where((in_toxic >= LEAST_DF) & (lift > LEAST_LIFT), lift, 0.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], df: np.ndarray, documents: int, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) of the least non-negative risk, by gradient descent with momentum. Rows are places of known words; df
    counts the documents of each word among all documents. A feature's value is its lift."""
    in_toxic = np.bincount(np.concatenate(positive), minlength=len(df)) if positive else np.zeros(len(df), np.int64)
    value = lifts(in_toxic, len(positive), df, documents)
    p, u = Sparse(positive, value), Sparse(unlabelled, value)
    w, b = np.zeros(len(value)), float(np.log(prior / (1 - prior)))
    x = np.ones(len(w) + 1)
    for _ in range(8):  # the largest curvature, by power iteration
        x /= np.linalg.norm(x) or 1.0
        top = prior * p.gradient(p.times(x[:-1]) + x[-1]) / max(p.n, 1) + u.gradient(u.times(x[:-1]) + x[-1]) / max(u.n, 1)
        x, most = top, np.linalg.norm(top)
    rate, speed = 1 / (0.25 * most + DECAY), np.zeros(len(w) + 1)
    for _ in range(ROUNDS):
        _, bracket, toward, away = risk(p, u, w, b, prior)
        g = toward + away if bracket >= 0 else -away
        g[:-1] += DECAY * w
        speed = MOMENTUM * speed - rate * g
        w, b = w + speed[:-1], b + speed[-1]
    return w * value, b


def logits(rows: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return Sparse(rows, np.ones(len(w))).times(w) + b


def best_cut(found: np.ndarray, toxic: np.ndarray) -> float:
    """The logit in the middle of the gap at which F1 is largest."""
    order = np.argsort(-found, kind="stable")
    g, y = found[order], toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][g[1:] == g[:-1]] = -1  # no cut between ties
    k = int(np.argmax(f1))
    return float(g[k] + (g[k + 1] if k + 1 < len(g) else g[k] - 1)) / 2


def _mod(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(4)).cast("int")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, float] | None:
    """(vocabulary, weights, bias, cut, scale); None without a toxic label. docs: id, text; labels: id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & (_mod("id") != HELD_OUT)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("o", F.xxhash64("id"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic:
        return None
    prior = min(0.95, toxic / n)
    first = lambda label, most, part: known.where(F.col("toxic") == label).orderBy("o", "id").limit(most).select("id", F.lit(part).alias("part"))
    some = first(1, POSITIVES, "p").union(first(0, LABELLED, "n"))
    held_in = docs.where(_mod("id") != HELD_OUT).select(_mod("id").alias("mod"), "id", "text")
    labelled = checkpointed(held_in.join(F.broadcast(some), "id").groupBy("id", "mod", "part").agg(F.min("text").alias("text")))  # POSITIVES + LABELLED rows at most
    frequent = labelled.where("part = 'p'").select("text").mapInArrow(_words_in, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DF)
    frequent = frequent.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()  # VOCABULARY rows at most
    words, in_toxic = frequent["word"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(words)
    vocabulary, in_toxic = words[order], in_toxic[order]
    held = spark.sparkContext.broadcast(vocabulary)
    counts = held_in.select("text").mapInArrow(_count_known(held), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, count = counts["place"].to_numpy(), counts["n"].to_numpy()
    documents, df = int(count[place < 0].sum()), np.zeros(len(vocabulary), np.int64)
    df[place[place >= 0]] = count[place >= 0]
    use = lifts(in_toxic, labelled.where("part = 'p'").count(), df, documents) > 0
    vocabulary, df = vocabulary[use], df[use]
    held = spark.sparkContext.broadcast(vocabulary)
    steps = 1 << 40
    share = min(steps, int(steps * min(1.0, UNLABELLED / max(1, documents))))
    mark = F.xxhash64(F.lit(8), "id", "text")
    drawn = held_in.withColumn("h", mark).where(F.pmod("h", F.lit(steps)) < share).dropDuplicates(["h"]).select("mod", F.lit("u").alias("part"), "text")
    rows = labelled.select("mod", "part", "text").union(drawn).mapInArrow(_features(held), "mod int, part string, places binary").collect()
    by = {k: [] for k in "pnu"}
    for r in sorted(rows, key=lambda r: (r.part, r.mod, bytes(r.places))):
        by[r.part].append((r.mod, np.frombuffer(bytes(r.places), np.int32)))
    if not by["p"]:
        return None
    got, truth = [], []
    for fold in FOLDS if len({m for m, _ in by["p"]}) > 1 else FOLDS[:0]:
        model = fit([x for m, x in by["p"] if m != fold], [x for m, x in by["u"] if m != fold], df, documents, prior)
        for part, y in (("p", 1), ("n", 0)):
            mine = [x for m, x in by[part] if m == fold]
            got.append(logits(mine, *model))
            truth.append(np.full(len(mine), y))
    final = fit([x for _, x in by["p"]], [x for _, x in by["u"]], df, documents, prior)
    if not got:  # too few toxic texts to leave a fold out: the model's own rows set the cut
        got, truth = [logits([x for _, x in by[part]], *final) for part in "pn"], [np.full(len(by[part]), y) for part, y in (("p", 1), ("n", 0))]
    g, truth = np.concatenate(got), np.concatenate(truth)
    return vocabulary, *final, best_cut(g, truth), max(float(np.std(g)), 1e-3)


def _score(model):
    def run(batches):
        vocabulary, w, b, cut, scale = model.value
        use = w != 0
        known, w = Known(vocabulary[use]), w[use]
        for batch in batches:
            texts = texts_of(batch.column(2))
            out = [np.zeros(0)]
            for x, y in chunks(texts):
                doc, i = known.presence(texts[x:y])
                g = np.bincount(doc, w[i], y - x) + b
                out.append(_sigmoid((g - cut) / scale + np.log(THRESHOLD / (1 - THRESHOLD))))
            score = np.concatenate(out)
            predicted = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD) of each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train(texts, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")))
    rows = texts.select(F.col("id").alias("doc_id"), (_mod("id") == HELD_OUT).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
