"""Token counts by dynamic programming over a trie.

A text's pre-tokens are its words, each after the space mark. The distinct pre-tokens of a batch, sorted, are a trie: a node
is a prefix, and belongs to the first word that has it. For each node the best unigram score of its prefix is the best sum of
an ancestor's score and that of the piece between them; it is computed once for all words below, level by level in numpy,
with the number of its tokens. A word's count is that of its last node.

The pieces are those of a public vocabulary; their log probabilities follow Zipf's law, -ln(1 + rank). A character that no
piece covers costs UNKNOWN and counts a token for each of its bytes. Of equal scores the one with fewer tokens holds.

One map over the documents; memory follows the batch. Defined results: null and empty texts have no tokens; null ids are
returned as null; repeated rows are counted each for itself; words over LONG characters are scored one by one; an empty
table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Words, bounded_batches, chunks, mix, powers, table, texts_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -20.0
LONG, WIDTH = 48, 16
_PART = 40_000


class Pieces:
    """The pieces of a vocabulary file and their scores, by hash."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.score = {s: -float(np.log(1 + rank)) for rank, s in enumerate(names, 1) if len(s) <= WIDTH}
        keys = np.array([self._hash(s) for s in self.score], U64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.score.values()))[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> U64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(s: str) -> int:
        at = mix(np.array([ord(c) for c in s], U64)) * powers(len(s))[0][: len(s)]
        return int(mix(np.array([at.sum(dtype=U64)]))[0])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their scores."""
        at = np.flatnonzero(self.maybe[(hashes >> U64(42)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[i] == hashes[at]
        return at[same], self.values[i[same]]

    def count(self, word: str) -> int:
        """The tokens of one word."""
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            options = [(best[d - 1][0] + UNKNOWN, -best[d - 1][1] - len(word[d - 1].encode()))]
            for n in range(1, min(WIDTH, d) + 1):
                s = self.score.get(word[d - n : d])
                if s is not None:
                    options.append((best[d - n][0] + s, -best[d - n][1] - 1))
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]


def _trie_counts(words: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The tokens of sorted distinct words, as numpy strings."""
    n, width = len(words), words.dtype.itemsize // 4
    points = words.view(np.uint32).reshape(n, width)
    length = np.char.str_len(words)
    differs = points[1:] != points[:-1]
    shared = np.full(n, -1)
    shared[1:] = np.argmax(differs, axis=1)
    forward, backward = (p[: width + 1] for p in powers(width + 1))
    sums = np.zeros((width + 1, n), U64)
    np.cumsum((mix(points.astype(U64)) * forward[:width]).T, axis=0, out=sums[1:])
    size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    score = np.zeros((width + 1, n))
    count = np.zeros((width + 1, n), np.int64)
    owner = [np.zeros(n, np.int64)]
    rows = np.arange(n)
    for d in range(1, width + 1):
        owner.append(np.maximum.accumulate(np.where(shared < d, rows, 0)))
        node = np.flatnonzero((shared < d) & (length >= d))
        if not len(node):
            continue
        up = owner[d - 1][node]
        best, used = score[d - 1][up] + UNKNOWN, count[d - 1][up] + size[node, d - 1]
        for k in range(1, min(WIDTH, d) + 1):
            at, s = pieces.find(mix((sums[d][node] - sums[d - k][node]) * backward[d - k]))
            if not len(at):
                continue
            up = owner[d - k][node[at]]
            new, tokens = score[d - k][up] + s, count[d - k][up] + 1
            better = (new > best[at]) | ((new == best[at]) & (tokens < used[at]))
            best[at[better]], used[at[better]] = new[better], tokens[better]
        score[d][node], count[d][node] = best, used
    last = np.array([owner[k][i] for i, k in enumerate(length.tolist())])
    return count[length, last]


def count_words(words: list[str], pieces: Pieces) -> np.ndarray:
    """The tokens of each of some distinct words."""
    marked = np.array([MARK + w for w in words], object)
    out = np.zeros(len(words), np.int64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    for i in np.flatnonzero((size > LONG) | np.fromiter(("\0" in w for w in words), bool, len(words))).tolist():
        out[i] = pieces.count(marked[i])
        size[i] = 0
    rest = np.flatnonzero(size)
    order = rest[np.argsort(marked[rest], kind="stable")]
    for a in range(0, len(order), _PART):
        mine = order[a : a + _PART]
        out[mine] = _trie_counts(marked[mine].astype(str), pieces)
    return out


_pieces: dict[str, Pieces] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens. vocabulary: a file's path; by default that of the public one, looked up where it is installed."""
    bounded_batches(docs.sparkSession)  # words repeat: larger batches have fewer distinct ones a text
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = _pieces.get(vocabulary)
        if pieces is None:
            pieces = _pieces[vocabulary] = Pieces(vocabulary)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in chunks(texts, 8 << 20):
                w = Words(texts[a:b])
                _, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                buf, starts, ends = w.buf.tobytes(), w.starts[first].tolist(), w.ends[first].tolist()
                counts = count_words([buf[x:y].decode() for x, y in zip(starts, ends, strict=True)], pieces)
                n.append(np.diff(w.of))
                tokens.append(np.bincount(w.docs(), counts[inverse], b - a).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(tokens))], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
