"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, places kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, sliced

K = 12
WINDOW = 21  # any match of K + WINDOW - 1 = 32 code points is found
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
POWERS: list[np.ndarray] = []  # powers of BASE and of its inverse, as far as they were asked for


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not POWERS or len(POWERS[0]) < size:
        n = max(size, 1 << 16)
        POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64)))) for x in (BASE, INVERSE)]
    return POWERS[0][:size], POWERS[1][:size]


def kgram_hashes(chars: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hashes (32 bits) of all k-grams, rolled in one pass; the whole text if it is shorter than k.

    The rolling sum of a text, each value times a power of the base, gives a k-gram as a difference that is turned back by
    the power of its place: the base is odd, so it has an inverse.
    """
    k = min(k, len(chars))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(chars) - k + 1
    values = (chars.astype(np.uint64) + np.uint64(1)) * MIX
    values ^= values >> np.uint64(31)
    up, down = powers(len(chars))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[:n]
    h ^= h >> np.uint64(29)
    h *= MIX
    return h >> np.uint64(32)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimum of each window, the rightmost of equal ones, each place once.

    Window minima come from running minima inside blocks of `window`, forwards and backwards, so the work is
    linear; a key has the hash above and the distance from the right below, which settles ties.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    w = min(window, n)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    grid = blocks.reshape(-1, w)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: n - w + 1], forward[w - 1 : n])
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (low - (chosen & low)).astype(np.int64), (chosen >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint as hex, 4 bytes of hash and 1 byte of distance from the place before (of 0) for each; the set of hashes.

    Neighbouring places are at most WINDOW apart, so a byte holds the distance.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places, hashes = winnow(kgram_hashes(chars))
    packed = np.zeros((len(places), 5), np.uint8)
    packed[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    packed[:, 4] = np.diff(places, prepend=0)
    return packed.tobytes().hex(), np.unique(hashes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


# Ranges at most; beyond, they have more rows, which are sorted with spilling and read one by one.
MOST_RANGES = 32_768


def with_next(docs: DataFrame, rows_per_range: int = 1500) -> DataFrame:
    """Ranges of documents in descending doc_id, each followed by a copy of the first document of the next non-empty range.

    Ranges are cut at quantiles of doc_id. Adds _range (ascending means later), _ahead (the copy) and _key (null doc_id as
    null); the least range's copy closes the ring. The copies are one or a few documents a range; the table of ranges, at
    most MOST_RANGES rows, is the only thing that meets in one place.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k")).first()
    parts = max(1, min(MOST_RANGES, ids["n"] // rows_per_range))
    cuts = [0.0]
    if ids["k"]:
        found = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0]
        cuts = sorted(set(found))
    splits = [-float("inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_cut", handleInvalid="keep")
    ranged = cut.transform(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
    last = len(splits) - 1
    # null doc_ids, the invalid ones, come after all others
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), last + 1).otherwise(F.lit(last) - F.col("_cut")).cast("int"))
    heads = ranged.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    heads = checkpoint(heads)
    table = sorted(heads.collect(), key=lambda r: r["_range"])
    ring = {b["_range"]: a["_range"] for a, b in zip([table[-1], *table[:-1]] if table else [], table, strict=True)}
    if not ring:
        return ranged.withColumn("_ahead", F.lit(False)).drop("_id", "_cut")
    spark = docs.sparkSession
    copies = spark.createDataFrame([(r["_range"], r["_head"], ring[r["_range"]]) for r in table], "_at int, _head long, _before int")
    joined = ranged.join(
        F.broadcast(copies), (F.col("_range") == F.col("_at")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_head")), "left"
    )
    both = F.when(F.col("_at").isNotNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("a")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("a"))))
    one = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("a")))
    return (
        joined.withColumn("_copy", F.explode(F.coalesce(both, one)))
        .withColumn("_range", F.col("_copy.r"))
        .withColumn("_ahead", F.col("_copy.a"))
        .drop("_copy", "_at", "_head", "_before", "_id", "_cut")
    )


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the text that comes after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see edited() and with_next().

    Documents are ordered by descending doc_id, then by text; after the last comes the first (a lone document follows
    itself). Null texts are empty and have an empty fingerprint; null doc_ids come last; repeated rows are each other's
    neighbours. An empty table gives no rows. Only doc_id and text are read; a row at a time is held, with its neighbour.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = with_next(base)
    dealt = ranged.repartition("_range").sortWithinPartitions("_range", "_ahead", F.col("doc_id").desc_nulls_last(), "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose neighbour is still to come: doc_id, text, range, fingerprint, hashes
        for batch in sliced(batches, 128):
            rows = []
            for doc_id, text, where, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_ahead")), strict=True):
                if ahead and held is None:
                    continue  # a further copy of a repeated doc_id
                code, hashes = fingerprint(text)
                if held is not None:
                    other = edited(held[1], text)
                    code2, hashes2 = fingerprint(other)
                    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((held[0], len(held[1]), digest, held[3], code2, likeness(held[4], hashes2), likeness(held[4], hashes)))
                held = None if ahead else (doc_id, text, where, code, hashes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.select("doc_id", "text", "_range", "_ahead").mapInArrow(run, OUT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(documents(spark, sf_dir))
