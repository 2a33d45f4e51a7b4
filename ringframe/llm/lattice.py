"""LM scoring: the probability of a text as the sum over all its segmentations into pieces of a public vocabulary."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, checkpoint, documents, sliced

FOLDS = 10
SMOOTHING = 0.1
ROUNDS = 3
# The vocabulary's own scores count as so many uses for each of its pieces.
PRIOR = 0.1
# Words this share of all tokens or more are broadcast, so at most 1 / HOT_SHARE of them; the others are joined by a shuffle.
HOT_SHARE = 1e-6
VECTOR_LENGTH = 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces as bytes (a space marks a word's begin) and their log-probabilities by the vocabulary's own scores.

    The file's scores are ranks, which count as frequency ranks: probability in proportion to 1 / (1 + rank). The single
    bytes are among the pieces, so every text has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mass: dict[bytes, float] = defaultdict(float)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        mass[raw] += 1e-6 if model.is_byte(i) else 1 / (1 - model.get_score(i))
    pieces = sorted(mass)
    p = np.array([mass[x] for x in pieces])
    return pieces, np.log(p / p.sum())


def prior_of(pieces: list[bytes], logp: np.ndarray) -> np.ndarray:
    """What the vocabulary's scores say of pieces inside a word (first half) and at its end (second half): as likely there as here.

    A word is a piece that begins with a space, then pieces that don't: either kind has probabilities of sum 1.
    """
    return by_kind(pieces, np.concatenate([np.exp(logp), np.exp(logp)]))


def by_kind(pieces: list[bytes], mass: np.ndarray) -> np.ndarray:
    """Probabilities in proportion to `mass`, with sum 1 for the pieces that begin with a space and for the others."""
    begins = np.array([x[:1] == b" " for x in pieces] * 2)
    return np.where(begins, mass / max(mass[begins].sum(), 1e-300), mass / max(mass[~begins].sum(), 1e-300))


class Lattice:
    """Forward and backward recursions in log space over all segmentations of words, many words of a length at once.

    `logp` has two scores for each piece: with more of the word to come, and as the word's last one.
    """

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self.ids = {x: i for i, x in enumerate(pieces)}
        self.lengths = sorted({len(x) for x in pieces}, reverse=True)
        self.longest = self.lengths[0]
        keys = np.array([self.key_of(x) for x in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)

    @staticmethod
    def key_of(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + c + 1) % (1 << 64)
        h = (h + len(piece)) * int(MIX) % (1 << 64)
        return (h ^ (h >> 29)) * int(MIX) % (1 << 64)

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words as rows of bytes: (from, to, rows, scores' places) of all places where pieces fit, by ascending end."""
        m, n = words.shape
        h = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            h[j + 1] = h[j] * BASE + words[:, j] + np.uint64(1)
        for j in range(1, n + 1):
            last = len(self.pieces) if j == n else 0
            for length in self.lengths:
                i = j - length
                if i < 0:
                    continue
                key = (h[j] - h[i] * self.powers[length] + np.uint64(length)) * MIX
                key = (key ^ (key >> np.uint64(29))) * MIX
                rows = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                    hit = self.keys[at] == key[rows]
                    if hit.any():
                        yield i, j, rows[hit], self.order[at[hit]] + last

    def forward(self, words: np.ndarray, keep: list | None = None) -> np.ndarray:
        m, n = words.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, ids in self.arcs(words):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[ids])
            if keep is not None:
                keep.append((i, j, rows, ids))
        return alpha

    def expected(self, words: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores' places, expected uses) over all segmentations, times the words' weights."""
        arcs: list = []
        alpha = self.forward(words, arcs)
        n = words.shape[1]
        beta = np.full_like(alpha, -np.inf)
        beta[n] = 0.0
        for i, j, rows, ids in reversed(arcs):
            through = beta[j, rows] + self.logp[ids]
            yield ids, weights[rows] * np.exp(alpha[i, rows] + through - alpha[n, rows])
            beta[i, rows] = np.logaddexp(beta[i, rows], through)

    def long_arcs(self, word: bytes) -> list[list[tuple[int, int]]]:
        get, size, v = self.ids.get, len(word), len(self.pieces)
        return [
            [(i, k + v * (j == size)) for i in range(max(0, j - self.longest), j) if (k := get(word[i:j])) is not None] for j in range(1, size + 1)
        ]

    def long_forward(self, word: bytes, arcs: list[list[tuple[int, int]]]) -> list[float]:
        alpha, logp = [0.0], self.logp
        for into in arcs:
            terms = [alpha[i] + logp[k] for i, k in into]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def long_expected(self, word: bytes, weight: float) -> tuple[np.ndarray, np.ndarray]:
        arcs = self.long_arcs(word)
        alpha = self.long_forward(word, arcs)
        beta = [-math.inf] * len(alpha)
        beta[-1] = 0.0
        ids, uses = [], []
        for j in range(len(word), 0, -1):
            for i, k in arcs[j - 1]:
                through = beta[j] + self.logp[k]
                ids.append(k)
                uses.append(weight * math.exp(alpha[i] + through - alpha[-1]))
                low, high = sorted((beta[i], through))
                beta[i] = high + (math.log1p(math.exp(low - high)) if low > -math.inf else 0.0)
        return np.array(ids), np.array(uses)

    def grouped(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Row numbers and byte matrices of the words (a space before each) by length; no matrix for a long word."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n < VECTOR_LENGTH:
                yield rows, np.frombuffer(b"".join(b" " + words[r] for r in rows), np.uint8).reshape(len(rows), n + 1)
            else:
                for r in rows:
                    yield np.array([r]), None

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, matrix in self.grouped(words):
            if matrix is None:
                word = b" " + words[rows[0]]
                out[rows] = self.long_forward(word, self.long_arcs(word))[-1]
            else:
                out[rows] = self.forward(matrix)[-1]
        return out / math.log(10)

    def uses(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """The expected uses of each score over all segmentations of the words, times their weights."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, matrix in self.grouped(words):
            if matrix is None:
                parts.append(self.long_expected(b" " + words[rows[0]], float(weights[rows[0]])))
            else:
                parts += self.expected(matrix, weights[rows])
        if not parts:
            return np.zeros(len(self.logp))
        return np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(self.logp))


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """The fold of crc32 of the id as text; a null id's text is empty, so it is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): each distinct word's count in training documents and in all; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(train.keys() | held.keys())
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                c = [train[w] for w in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(c, pa.int64()), pa.array([x + held[w] for x, w in zip(c, part, strict=True)], pa.int64())],
                    names=["word", "c", "n"],
                )
            train.clear()
            held.clear()

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (held if is_held_out(doc_id) else train).update((text or "").encode().lower().split())
            if len(train) + len(held) > 600_000:
                yield from flush()
        yield from flush()

    partial = docs.mapInArrow(run, "word binary, c long, n long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` words: words of a length go through the lattice together, so more at a time cost less."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def train(words: DataFrame, pieces: list[bytes], logp: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Re-estimate the scores by expectation maximisation over the training words, each as often as it occurs.

    A round is one pass over the distinct words; what comes back is two numbers for each of the vocabulary's pieces.
    """
    start = prior_of(pieces, logp)
    prior, scores = PRIOR * len(pieces) * start, np.log(start)
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], scores: np.ndarray = scores) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(pieces, scores), np.zeros(len(scores))
            for batch in gathered(batches):
                into += lattice.uses(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            used = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(into[used])], names=["place", "uses"])

        uses = np.zeros(len(scores))
        for r in known.mapInArrow(run, "place int, uses double").groupBy("place").agg(F.sum("uses").alias("uses")).collect():
            uses[r["place"]] = r["uses"]
        scores = np.log(by_kind(pieces, prior + uses))
    return scores


PARTS = "key long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, score double"


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learn from the documents (doc_id, text) of the training folds, and score all of them, whole.

    Tokens are the words between ASCII white space, A-Z in lower case, and one end. `base_score` sums log10 of smoothed word
    frequencies; `score` sums log10 of the words' marginal probabilities, over all segmentations into pieces of the public
    vocabulary, plus the end's. The pieces' scores start from the vocabulary's and are learned from the training words.

    Null and empty texts are the end alone. Null doc_ids are held out. Repeated rows are scored each. With no training
    documents every count is 0 and the lattice keeps the vocabulary's own scores, with an even chance of the end. An empty
    table gives no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = Tables(spark)
    words = t.keep("words", word_counts(docs))
    sums = words.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % FOLDS == 0
    ends = docs.where(~held).count()
    tokens, distinct = (sums["c"] or 0) + ends, sums["v"] + (ends > 0)
    below = tokens + SMOOTHING * (distinct + 1)

    pieces, logp = vocabulary(path or default_vocabulary())
    scores = train(words, pieces, logp) if tokens else np.log(prior_of(pieces, logp))
    stop = ends / tokens if tokens > ends else 0.5  # without a word to learn from, an end is as likely as a word
    end, goes_on = math.log10(stop), math.log10(1 - stop)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, scores)
        for batch in gathered(batches):
            rated = lattice.log10(batch.column(0).to_pylist()) + goes_on
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rated)], names=["word", "c", "n", "lattice"])

    rated = t.keep("rated", words.mapInArrow(rate, "word binary, c long, n long, lattice double"))
    t.drop("words")
    often = max(2, math.ceil(HOT_SHARE * ((sums["n"] or 0) + 1)))
    hot = {bytes(r["word"]): (r["c"], r["lattice"]) for r in rated.where(F.col("n") >= often).select("word", "c", "lattice").collect()}
    hot_base = {w: math.log10((c + SMOOTHING) / below) for w, (c, _) in hot.items()}
    shared = spark.sparkContext.broadcast(({w: (hot_base[w], x, c > 0) for w, (c, x) in hot.items()}))
    end_base = math.log10((ends + SMOOTHING) / below)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        key = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["key", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"]
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key += 1
                counts = Counter((text or "").encode().lower().split())
                base, score, n_known, n = end_base, end, int(ends > 0), 1
                for w, times in counts.items():
                    n += times
                    if (x := known.get(w)) is None:
                        rows.append((key, None, None, w, times, None, None, None, None))
                    else:
                        base += times * x[0]
                        score += times * x[1]
                        n_known += times * x[2]
                # a word with a space is in no text: the document's own row meets no count, and such rows are spread evenly
                rows.append((key, doc_id, is_held_out(doc_id), b" %d" % key, 0, n, n_known, base, score))
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000], strict=True), types, strict=True)], names=names)

    cold = rated.where(F.col("n") < often).select(F.col("word").alias("_word"), "c", "lattice")
    joined = docs.mapInArrow(parts, PARTS).join(cold, F.col("word") == F.col("_word"), "left")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    summed = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times")), zero)).alias("n_known"),
        F.sum(F.coalesce("base", F.col("times") * F.log10((F.col("c") + SMOOTHING) / below), none)).alias("base_score"),
        F.sum(F.coalesce("score", F.col("times") * F.col("lattice"), none)).alias("score"),
    )
    out = checkpoint(summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"))
    t.drop("rated")
    return out


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
