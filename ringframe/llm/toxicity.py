"""Toxicity by a weighted finite-state pattern grammar: insult, threat, target, negation and reported-speech transducers, composed."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpoint, documents, sliced

# Seed words of the grammar's classes.
INSULTS = "idiot moron scum trash loser stupid pathetic worthless disgusting clown imbecile dumb filth vermin".split()
THREATS = "kill hurt destroy stab shoot strangle murder beat burn smash".split()
TARGETS = "you your yourself u ur he she they them him her we people du ihr sie tu vous toi usted ustedes".split()
NEGATIONS = "not never no isn't aren't wasn't don't nobody without nicht kein keine jamais nunca".split()
REPORTS = "said says called calls wrote claimed claims reported quoted told allegedly sagte dijo".split()

# Bounds of what is learned: labelled rows of each class (about), and a term's documents, places, words and ratio.
MOST_TOXIC, MOST_CLEAN, LEAST_DOCS, LEAST_PLACES, LEAST_WORDS, LEAST_RATIO = 20_000, 40_000, 2, 5, 3, 8.0
# Candidate terms are broadcast up to so many, and joined by a shuffle beyond; places are sent on when a task holds so many.
BROADCAST_TERMS, PLACES = 200_000, 500_000
STEMS = (4, 5, 6)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n;:,]")
FOLDS = 5

Arcs = dict[tuple[int, str], tuple[int, str]]


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer from symbols to symbols; an arc missing for a symbol is looked up under its first letter."""

    arcs: Arcs
    states: int

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        to, out = self.arcs[state, symbol[0]]
        return to, symbol + out


# Symbols: I insult, H threat, T target, N negation, R report, W any other word, C clause end, S sentence end.
WORDS = "IHTNRW"


def flagging(opens: str, closes: str, flag: str, reach: int = 0) -> Transducer:
    """After a symbol in `opens`, insults and threats get `flag` until one in `closes`, or for `reach` words if that is set."""
    last = reach or 1
    arcs: Arcs = {}
    for state, symbol in product(range(last + 1), WORDS + "CS"):
        out = flag if state and symbol in "IH" else ""
        to = last if symbol in opens else 0 if symbol in closes else max(0, state - 1) if reach else state
        arcs[state, symbol] = (to, out)
    return Transducer(arcs, last + 1)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the first one's output to the second: states are pairs."""
    arcs: Arcs = {}
    for a, b, symbol in product(range(first.states), range(second.states), WORDS + "CS"):
        to_a, said = first.step(a, symbol)
        to_b, out = second.arcs[b, said[0]]
        arcs[a * second.states + b, symbol] = (to_a * second.states + to_b, said[1:] + out)
    return Transducer(arcs, first.states * second.states)


def grammar() -> Transducer:
    """Insults and threats marked r in reported speech (to the sentence's end), n after a negation (three words), t after a target (clause)."""
    return compose(compose(flagging("R", "S", "r"), flagging("N", "CS", "n", 3)), flagging("T", "CS", "t"))


@dataclass
class Lexicon:
    """The innermost transducer, from words to weighted symbols: fixed classes, learned words and learned stems."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def classes(self) -> dict[str, tuple[str, float]]:
        named = {}
        for symbol, group, weight in (("W", "", 0), ("R", REPORTS, 0), ("N", NEGATIONS, 0), ("T", TARGETS, 0), ("H", THREATS, 2.0), ("I", INSULTS, 3.0)):
            named.update({w: (symbol, float(weight)) for w in group})
        for w, x in self.words.items():
            symbol, fixed = named.get(w, ("I", 0.0))
            if symbol in "IH":  # a seed keeps its class, and a target or negation never insults
                named[w] = (symbol, max(x, fixed))
        return named

    def symbol(self, word: str) -> tuple[str, float]:
        for n in reversed(STEMS):
            if len(word) > n and word[:n] in self.stems:
                return "I", self.stems[word[:n]]
        return "W", 0.0


class Scorer:
    """Runs the composed grammar over texts, clause by clause; features of a text are log(1 + weight) of its matched clauses by kind.

    A clause has one match: its insult or threat of the gravest kind (of the weightiest of these, if there are more). A kind
    is what the transducers say of the word's place in the clause, so the same words in another order may match otherwise.
    """

    KINDS = ("plain", "targeted", "negated", "reported", "threat", "threat at target")
    # The gravest kind of a clause counts.
    GRAVITY = (3, 4, 1, 0, 2, 5)

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.machine = lexicon, grammar()
        self.known: dict[str, tuple[str, float]] = lexicon.classes()
        self.known.update({x: ("C", 0.0) for x in ",;:"} | {x: ("S", 0.0) for x in ".!?\n"})
        self.fixed = len(self.known)

    def symbols(self, tokens: list[str]) -> list[tuple[str, float]]:
        known, symbol = self.known, self.lexicon.symbol
        if len(known) > self.fixed + 200_000:
            for w in list(known)[self.fixed :]:
                del known[w]
        out = []
        for w in tokens:
            s = known.get(w)
            if s is None:
                s = known[w] = symbol(w)
            out.append(s)
        return out

    @staticmethod
    def kind(symbol: str, flags: str) -> int:
        if "r" in flags:
            return 3
        if "n" in flags:
            return 2
        return (5 if "t" in flags else 4) if symbol == "H" else 1 if "t" in flags else 0

    def clauses(self, text: str | None) -> list[tuple[int, float]]:
        """(kind, weight) of each clause that matches."""
        symbols = self.symbols(TOKEN.findall((text or "").lower()))
        found: list[tuple[int, float]] = []
        if any(w for _, w in symbols):
            state, arcs, gravest = 0, self.machine.arcs, (-1, 0.0, 0)
            for symbol, weight in (*symbols, ("S", 0.0)):
                state, flags = arcs[state, symbol]
                if weight:
                    kind = self.kind(symbol, flags)
                    gravest = max(gravest, (self.GRAVITY[kind], weight, kind))
                elif symbol in "CS" and gravest[0] >= 0:
                    found.append((gravest[2], gravest[1]))
                    gravest = (-1, 0.0, 0)
        return found

    def features(self, text: str | None) -> list[float]:
        found = [0.0] * len(self.KINDS)
        for kind, weight in self.clauses(text):
            found[kind] += weight
        return [math.log1p(x) for x in found]


def word_features(text: str | None) -> set[tuple[str, bool]]:
    """The distinct words of a text, and their stems: (string, is a stem)."""
    words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 2}
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold: about MOST_TOXIC and MOST_CLEAN rows at most, chosen by a hash.

    The chosen label rows are bounded, so they are broadcast and texts are not shuffled.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.crc32(F.encode(F.col("_id").cast("string"), "utf-8")) % FOLDS != 0)
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(MOST_TOXIC / max(n.get(1, 0), MOST_TOXIC))).otherwise(F.lit(MOST_CLEAN / max(n.get(0, 0), MOST_CLEAN)))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def learn_lexicon(train: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Words and stems that mark toxic texts, with their log-odds.

    A term is a candidate if toxic documents hold it LEAST_RATIO times as often as clean ones; it is kept if the places where
    it stands (the words before and after it) are as varied as its documents, since words of copied texts stand in one place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in sliced(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(word_features(text))
        # a clean-only term can't be a candidate anywhere unless another task sees it in toxic texts, so it is sent too
        terms = list(found[0].keys() | found[1].keys())
        for at in range(0, len(terms), 20_000):
            part = terms[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part]), pa.array([s for _, s in part]), pa.array([found[1][t] for t in part]), pa.array([found[0][t] for t in part])],
                names=["term", "stem", "a", "b"],
            )

    counts = train.mapInArrow(count, "term string, stem boolean, a long, b long").groupBy("term", "stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    often = (F.col("a") + 0.5) / (toxic + 1) >= LEAST_RATIO * (F.col("b") + 0.5) / (clean + 1)
    candidates = checkpoint(counts.where((F.col("a") >= LEAST_DOCS) & often))
    small = candidates.count() <= BROADCAST_TERMS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bool, int, int]] = set()

        def sent() -> Iterator[pa.RecordBatch]:
            found = list(seen)
            seen.clear()
            for at in range(0, len(found), 20_000):
                t, s, w, c = zip(*found[at : at + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s), pa.array(w, pa.int64()), pa.array(c, pa.int64())], names=["term", "stem", "word", "place"])

        for batch in sliced(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not label:
                    continue
                words = ["", *TOKEN.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    if len(w) > 2:
                        word, place = zlib.crc32(w.encode()), zlib.crc32(f"{words[i - 1]} {w} {words[i + 1]}".encode())
                        seen.update((term, stem, word, place) for term, stem in ((w, False), *((w[:n], True) for n in STEMS if len(w) > n)))
                if len(seen) > PLACES:
                    yield from sent()
        yield from sent()

    places_of = train.mapInArrow(places, "term string, stem boolean, word long, place long")
    asked = candidates.select("term", "stem")
    places_of = places_of.join(F.broadcast(asked) if small else asked, ["term", "stem"], "left_semi")
    words_of = places_of.groupBy("term", "stem", "word", "place").agg(F.lit(1)).groupBy("term", "stem", "word").agg(F.count(F.lit(1)).alias("n"))
    varied = words_of.groupBy("term", "stem").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("words"))
    # a stem stands for a family of words; a single word is a term itself
    family = ~F.col("stem") | (F.col("words") >= LEAST_WORDS)
    kept = varied.join(candidates, ["term", "stem"]).where(family & (F.col("count") >= F.greatest(F.lit(float(LEAST_PLACES)), 0.5 * F.col("a"))))
    lexicon = Lexicon()
    for r in kept.select("term", "stem", "count", "b").collect():
        odds = math.log((r["count"] + 0.5) / (toxic + 1)) - math.log((r["b"] + 0.5) / (clean + 1))
        (lexicon.stems if r["stem"] else lexicon.words)[r["term"]] = min(8.0, max(1.0, odds))
    return lexicon


# Weights of intercept and clause kinds before any label is seen.
UNLEARNED = np.array([-2.0, 2.0, 2.5, 0.0, 0.0, 1.0, 2.5])
# What the grammar says of kinds, whatever the labels: the first weighs no less than the second.
ORDER = (("targeted", "plain"), ("plain", "negated"), ("plain", "reported"), ("threat at target", "threat"))


def newton(x: np.ndarray, y: np.ndarray, times: np.ndarray, start: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Logistic regression (intercept first) by Newton steps, each row counted `times`; the ridge draws to `start`."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = start.copy(), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (times * (y - p)) - penalty @ (w - start))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of intercept and kinds under ORDER: kinds that the labels put in the wrong order share one weight, and all are fitted anew.

    Kinds that no labelled row has keep the unlearned weights, as far as the order allows.
    """
    kinds, group = Scorer.KINDS, list(range(len(Scorer.KINDS)))
    while True:
        names = sorted(set(group))
        merged = np.column_stack([x[:, [k for k, g in enumerate(group) if g == name]].sum(axis=1) for name in names])
        start = [UNLEARNED[0], *(np.mean([UNLEARNED[1 + k] for k, g in enumerate(group) if g == name]) for name in names)]
        w = newton(merged, y, times, np.array(start), ridge, rounds)
        full = np.array([w[0], *(w[1 + names.index(g)] for g in group)])
        gaps = [(full[1 + kinds.index(b)] - full[1 + kinds.index(a)], kinds.index(a), kinds.index(b)) for a, b in ORDER]
        gap, a, b = max(gaps)
        if gap <= 1e-9:
            return full
        group = [group[a] if g == group[b] else g for g in group]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the lexicon and the weights of the clause kinds from labelled rows outside the held-out fold."""
    train = training_rows(docs, labels)
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(Lexicon(), UNLEARNED)
    lexicon = learn_lexicon(train, n[1], n[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in sliced(batches):
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = train.mapInArrow(measure, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    return Model(lexicon, fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["count"] for r in rows], float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add `score` (0 to 1) to any table with a text column; it depends on the text alone.

    Null and empty texts have no clauses and get the intercept's score. Rows are scored one by one, whole; other columns are
    kept, one named like `score` is replaced. An empty table gives no rows.
    """
    docs = docs.drop(score)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    lexicon, weights = model.lexicon, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in sliced(batches):
            x = np.array([scorer.features(t) for t in batch.column(text).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % FOLDS  # a null id is held out
    return score_toxicity(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
