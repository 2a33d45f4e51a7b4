"""Best-fit packing: gaps filled exactly by single, pair and triple lengths, then best fit for what is left."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, numbered, process_cache

CAPACITY = 2048
END_ID = 0
# Words of which a Python worker remembers the ids; then it begins anew.
REMEMBERED = 400_000
AT_ONCE = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, n_pieces int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Signs that end a word here; those of special tokens are not among them.
CLOSING = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


class WordIds:
    """Ids of texts as bytes (little-endian, 32 bits). White space always ends a token, so ids are remembered word by word.

    A word of letters alone is one group of the tokenizer's pre-tokenizer, so its model can be called at once; signs that
    close a word after a letter are a group of their own. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        shown = iter(range(256, 512))
        # the byte-level alphabet: printable Latin-1 as itself, other bytes from 256 on, in order
        self.alphabet = {c: c if c in plain else next(shown) for c in range(256)}

    def ids(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or word == word.lower() and unicodedata.is_normalized("NFC", word)):
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def learn(self, word: bytes) -> bytes:
        text = word.decode()
        bare = text.rstrip(CLOSING)
        if bare != text and bare and bare[-1].isalpha() and bare[-1] == bare[-1].lower():
            parts = bare.encode(), text[len(bare) :].encode()
            found = b"".join(self.known.get(x) or self.known.setdefault(x, self.ids(x.decode())) for x in parts)
        else:
            found = self.ids(text)
        self.known[word] = found
        return found

    @staticmethod
    def split(raw: bytes) -> list[bytes]:
        if b"<|" not in raw:
            return raw.lower().split()
        return [w if b"<|" in w else w.lower() for w in raw.split()]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # the tokenizer lower-cases; doing so for A-Z here makes more words alike, but special tokens are found before that
        words = [self.split((t or "").encode()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for new in set().union(*words) - self.known.keys():
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, add the end id and cut what is longer than `capacity`: a row per piece, with its ids on demand."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("n_pieces", pa.int32())]
        + [("ids", pa.binary())] * keep_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = process_cache("word ids")
        coder = cache.get(tokenizer) or cache.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = -(-len(ids) // (4 * capacity))
                    for k in range(n):
                        cut = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                        rows.append((doc_id, k, k * capacity, len(cut) // 4, zlib.crc32(cut), n, *([cut] if keep_ids else [])))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with the number of sequences of each, for a histogram of lengths below `capacity`.

    The histogram has at most `capacity` entries whatever the corpus, so this small table is planned on the driver.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    found: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        times = min(int(have[x]) // n for x, n in Counter(pattern).items())
        for x in pattern:
            have[x] -= times
        found.append((pattern, times))

    for longest in range(capacity - 1, 0, -1):
        while have[longest]:
            pattern = exact_complement(have, longest, capacity - longest)
            if pattern is None:
                break
            use((longest, *pattern))
    patterns = found + best_fit(have, capacity)
    return [(tuple(sorted(Counter(p).items(), reverse=True)), n) for p, n in patterns if n]


def exact_complement(have: np.ndarray, longest: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths, none above `longest`, that sum to `gap`; the sums of pairs index the triples."""
    free = have.copy()
    free[longest] -= 1
    top = min(longest, gap)
    if gap <= longest and free[gap] > 0:
        return (gap,)
    a = np.flatnonzero(free[: top + 1] > 0)[::-1]

    def pair(of: int, free: np.ndarray, most: int) -> tuple[int, int] | None:
        a = np.flatnonzero(free[: min(most, of - 1) + 1] > 0)[::-1] if of > 1 else np.array([], int)
        a = a[2 * a >= of]
        b = of - a
        ok = (b > 0) & (free[b] > (a == b))
        return (int(a[ok][0]), int(b[ok][0])) if ok.any() else None

    if two := pair(gap, free, top):
        return two
    present = (free > 0).astype(np.float64)
    sums = np.rint(np.convolve(present[: gap + 1], present[: gap + 1])[: gap + 1]) if gap <= 512 else None
    for x in map(int, a):
        if 3 * x < gap:
            break
        if x >= gap or sums is not None and not sums[gap - x]:
            continue
        free[x] -= 1
        two = pair(gap - x, free, x)
        free[x] += 1
        if two:
            return (x, *two)
    return None


def best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, lengths decreasing, over groups of alike sequences: the least room that still fits takes the next length."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if not times:
            return
        if not room:
            done.append((pattern, times))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([pattern, times])

    for length in range(capacity - 1, 0, -1):
        n = int(have[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                put((length,) * fit, n // fit, capacity - fit * length)
                put((length,) * (n % fit), min(1, n % fit), capacity - n % fit * length)
                break
            room = rooms[k]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            fit = min(room // length, max(1, n // times))
            used = min(times, n // fit)
            put(pattern, times - used, room)
            put(pattern + (length,) * fit, used, room - fit * length)
            n -= used * fit
    return done + [(p, n) for g in groups.values() for p, n in g]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Which items of a length, by their rank, go to which sequences and offsets: sorted ranges of ranks."""
    begun: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, begun[length], each, sequence, offset))
            begun[length] += times * each
            offset += length * each
        sequence += times
    rows.sort()
    table = {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "each", "sequence", "offset"))}
    return table | {"total": np.array([sequence], np.int64)}


PLACED = ["sequence_id", "offset"]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (length in 1..capacity) into sequences of `capacity`; adds sequence_id and offset.

    Pieces of full length are sequences of their own. The others are counted by length; the plan for that histogram gives,
    for each length, ranges of ranks with their sequence and offset. Ranks are dense for each length and counted in hashed
    buckets (of the row and its place in the checkpoint), so that a length or a row with many copies is not one task's work.

    `pieces` should be a checkpoint, as it is read several times. Other columns are kept (sequence_id and offset excepted);
    equal pieces may be swapped among their places. An empty table gives no rows.
    """
    pieces = pieces.drop(*PLACED)
    counts = {r["length"]: r["count"] for r in pieces.where(F.col("length") < capacity).groupBy("length").count().collect()}
    table = slots(plan(counts, capacity))
    buckets = 1 << max(6, (sum(counts.values()) // 100_000).bit_length())
    full = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns,
        (F.monotonically_increasing_id() + F.lit(int(table["total"][0]))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    short = pieces.where(F.col("length") < capacity).withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *pieces.columns), F.lit(buckets)))
    ranked = numbered(short, ["length"], "_bucket", [F.xxhash64(*pieces.columns)], "_rank").drop("_bucket")
    shift = np.int64(1) << 44
    keys = table["length"] * shift + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, length * shift + rank, "right") - 1
            which = rank - table["first"][k]
            sequence = table["sequence"][k] + which // table["each"][k]
            offset = table["offset"][k] + which % table["each"][k] * length
            kept = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept.schema.names, *PLACED]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return full.unionByName(ranked.select(*pieces.columns, "_rank").mapInArrow(run, schema))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents (doc_id, text): a row per piece with its place, and its ids if `keep_ids`.

    Null and empty texts are the end id alone. Rows that share doc_id are packed each. Other columns are not read.
    """
    return pack(checkpoint(token_pieces(docs, tokenizer or default_tokenizer(), capacity, keep_ids=keep_ids)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
