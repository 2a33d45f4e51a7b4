"""N-gram Jaccard join: adaptive multi-match prefixes find candidates, which are verified exactly; groups are connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Tables, checkpoint, documents, sliced

# How far a prefix may be lengthened: so many shared tokens can be asked for.
LENGTHS = (1, 2, 4, 8, 16)
# What verifying a candidate costs, in posting entries read.
VERIFY_COST = 8.0
# A token in so many documents of a chunk of about CHUNK tokens is frequent; the order of tokens puts the HOT most frequent ones last.
CHUNK, FREQUENT, HOT = 1_000_000, 4, 200_000
# Cold tokens' document counts are exact up to this.
RUN = 10_000
# Document ids whose sets are to be verified are broadcast up to so many (some 10 MB); beyond, texts are shuffled to them.
BROADCAST_IDS = 300_000
# 64-bit words of the sketches in the join (folded), of those that candidates are tested by, and of those made from whole sets.
FOLDED, SKETCH, LARGE_SKETCH = 8, 16, 64
# Leaders that a set is compared with when large groups are contracted; the join proper finds the rest.
LEADERS = 3
# Bytes of texts that are shingled at a time: each takes some 50 bytes of arrays meanwhile.
SLICE = 250_000

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
INVERSE = np.uint64(pow(int(ODD[0]), -1, 1 << 64))
BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[3]
    h = (h ^ (h >> np.uint64(29))) * ODD[4]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct n-word shingles of texts as sorted 64-bit hashes, for many texts at a time by prefix sums over their bytes."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.power) < size:
            full = np.full(size, ODD[0], np.uint64), np.full(size, INVERSE, np.uint64)
            for x in full:
                x[0] = 1
            self.power, self.inverse = (np.multiply.accumulate(x) for x in full)

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts, and where each text's words begin (one more for the end)."""
        text = b"\n".join(raw).lower() + b"\n"
        b = np.frombuffer(text, np.uint8)
        self.grow(len(b) + 1)
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE[b] * self.power[: len(b)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
        return hashes, np.searchsorted(starts, begins)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode() for t in texts]
        h, at = self.words(raw)
        n = self.n
        m = max(0, len(h) - n + 1)
        grams = np.zeros(m, np.uint64)
        for i in range(n):
            grams = grams * ODD[1] + h[i : i + m]
        grams = mixed(grams)
        out = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            if z - a >= n:
                out.append(np.unique(grams[a : z - n + 1]))
            elif z > a:  # fewer words than n: the whole sequence is the one shingle
                whole = np.zeros(1, np.uint64)
                for x in h[a:z]:
                    whole = whole * ODD[2] + x
                out.append(mixed(whole + np.uint64(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def node_of(tokens: np.ndarray) -> int:
    """A set's identity: a 64-bit hash of its members, whatever their order."""
    total = mixed(tokens * ODD[2] + ODD[1]).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def sketch_of(tokens: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of 64 * words hashed classes: two sets differ in at least as many members as their sketches in bits."""
    parity = np.bincount((mixed(tokens + ODD[0]) >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


SUMMARY = "token long, docs long, doc_id long, node long, n long, " + ", ".join(f"s{i} long" for i in range(SKETCH))


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (doc_id, node, n, sketch), and rows (token, docs) for tokens that are frequent in a chunk."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SUMMARY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = counts >= FREQUENT
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often]), *[none] * (3 + SKETCH)], schema=schema)
            held.clear()

        for batch in sliced(batches, size=SLICE):
            sets = shingler.sets(batch.column(1).to_pylist())
            sketches = np.array([sketch_of(s) for s in sets])
            none = pa.nulls(len(sets), pa.int64())
            rows = [none, none, batch.column(0), pa.array([node_of(s) for s in sets]), pa.array([len(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array(sketches[:, i]) for i in range(SKETCH))], schema=schema)
            held += sets
            size += sum(map(len, sets))
            if size > CHUNK:
                yield from frequent()
                size = 0
        yield from frequent()

    return docs.mapInArrow(run, SUMMARY)


# `at` packs the position in the prefix and, in its lower half, the token's count of documents.
ENTRIES = "token long, node long, at long, n long"
ENTRY_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in ENTRIES.split(", ")])


def prefixes(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray, hot_docs: np.ndarray) -> DataFrame:
    """The longest prefix of each set in the global order: (token, node, at, n); the count in `at` is set for hot tokens alone.

    The order is by hash for all but the hot tokens, which come last, the most frequent at the very end. A set with n members
    has to share ceil(num * n / den) of them with any partner, so its prefix for l matches has n less that, plus l, members.
    Equal sets of a task are given once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n), set()
        for batch in sliced(batches, size=SLICE):
            parts = []
            for tokens in shingler.sets(batch.column(1).to_pylist()):
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                size = len(tokens)
                need = -(-num * size // den)
                length = min(size, size - need + min(LENGTHS[-1], need))
                k = np.minimum(np.searchsorted(hot, tokens), max(len(hot) - 1, 0))
                often = hot[k] == tokens if len(hot) else np.zeros(size, bool)
                cold = tokens[~often][:length]
                docs = np.zeros(length, np.int64)
                if len(cold) < length:
                    last = tokens[often]
                    count = hot_docs[k[often]]
                    by = np.lexsort((last, count))[: length - len(cold)]
                    docs[len(cold) :] = count[by]
                    cold = np.concatenate((cold, last[by]))
                parts.append((cold, node, (np.arange(length) << 32) + docs, size))
            if parts:
                lengths = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), lengths)),
                        pa.array(np.concatenate([p[2] for p in parts])),
                        pa.array(np.repeat([p[3] for p in parts], lengths)),
                    ],
                    schema=ENTRY_SCHEMA,
                )

    return docs.mapInArrow(run, ENTRIES)


def shared(entries: DataFrame) -> DataFrame:
    """Entries whose token another set has too, with the token's count of sets. Hot tokens need no test and are dealt by node."""
    dealt = entries.repartition(F.when(F.col("at") % (1 << 32) > 0, F.col("node")).otherwise(F.col("token"))).sortWithinPartitions("token", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        ended = None  # the token of a run that was longer than RUN and is being passed on
        names = ENTRY_SCHEMA.names
        for batch in with_end(batches):
            if batch is not None:
                now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
                now = now if rest is None else np.concatenate((rest, now), axis=1)
                if not now.shape[1]:
                    continue
                cut = int(np.searchsorted(now[0], now[0, -1])) if now.shape[1] else 0
                if now.shape[1] - cut > RUN:  # pass on what is there of a very long run
                    cut = now.shape[1] - 1
            elif rest is None:
                return
            else:
                now, cut = rest, rest.shape[1]
            part, rest = now[:, :cut], now[:, cut:]
            if not cut:
                continue
            fresh = np.ones(cut, bool)
            fresh[1:] = (part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])
            part = part[:, fresh]
            first = np.flatnonzero(np.concatenate(([True], part[0, 1:] != part[0, :-1])))
            counts = np.repeat(np.diff(np.append(first, part.shape[1])), np.diff(np.append(first, part.shape[1])))
            counts = counts + (part[0] == ended) * RUN
            same_next = rest.shape[1] and rest[0, 0] == part[0, -1] and rest[1, 0] != part[1, -1]
            if same_next:
                counts = counts + (part[0] == part[0, -1]) * RUN
            ended = part[0, -1] if same_next else None
            hot = part[2] & 0xFFFFFFFF
            part[2] += np.where(hot > 0, 0, counts)
            keep = part[:, (hot > 0) | (counts > 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keep[i], f.type) for i, f in enumerate(ENTRY_SCHEMA)], schema=ENTRY_SCHEMA)

    return dealt.mapInArrow(run, ENTRIES)


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def adapted(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Each set chooses how many matches l to ask for, and so the length of its prefix, by the least estimated cost.

    Reading the prefix's postings costs their entries; at most a l-th of the entries are sets with l matches, each of which
    is verified. A set with fewer shared tokens than the longest prefix asks for has no partner and goes. `rank` is higher the
    more sets share the tokens of a set's prefix.
    """
    need = F.expr(f"-floor(-({num} * n) / {den})").cast("int")
    cost = []
    for length in LENGTHS:
        inside = F.filter("_list", lambda x, length=length: x["pos"] < F.col("n") - F.col("_need") + length)
        read = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["docs"] - 1)
        cost.append(F.when(F.lit(length) <= F.col("_need"), F.struct((read + VERIFY_COST * read / length).alias("c"), (-F.lit(length)).alias("l"))))
    place = F.struct("token", F.shiftright("at", 32).cast("int").alias("pos"), (F.col("at") % (1 << 32)).alias("docs"))
    grouped = (
        entries.groupBy("node")
        .agg(F.collect_list(place).alias("_list"), F.first("n").cast("int").alias("n"))
        .withColumn("_need", need)
        .where(F.size("_list") >= F.least(F.lit(LENGTHS[-1]), F.col("_need")))
        .withColumn("l", -F.array_min(F.filter(F.array(*cost), lambda x: x.isNotNull()))["l"])
        .withColumn("_list", F.filter("_list", lambda x: x["pos"] < F.col("n") - F.col("_need") + F.col("l")))
    )
    met = F.aggregate("_list", F.lit(0).cast("long"), lambda s, x: s + x["docs"] - 1)
    central = F.least(1024 * met / (F.col("n") - F.col("_need") + F.col("l")), F.lit(2.0**30)).cast("long")
    return grouped.select("node", "n", "l", (F.shiftleft(central, 32) + F.col("node") % (1 << 31)).alias("rank"), F.explode("_list.token").alias("token"))


def longs(name: str, words: int) -> list[Column]:
    """A sketch's words; fewer than there are are those of a smaller sketch, as the parity of joined classes is the sum of theirs."""
    whole = [F.col(f"{name}.s{i}") for i in range(SKETCH)]
    while len(whole) > words:
        whole = [x.bitwiseXOR(y) for x, y in zip(whole[: len(whole) // 2], whole[len(whole) // 2 :], strict=True)]
    return whole


def differing(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches differ: a lower bound of the members that only one set has."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def may_link(na: Column, nb: Column, differ: Column, num: int, den: int) -> Column:
    """A sound test on sizes and sketches: linked sets differ in at most (den - num) / (den + num) of their members together."""
    na, nb = na.cast("long"), nb.cast("long")
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (differ * (den + num) <= (na + nb) * (den - num))


def near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by their sketches."""
    x = sketches.select(F.col("node").alias("a"), F.struct("n", *[f"s{i}" for i in range(SKETCH)]).alias("x"))
    y = sketches.select(F.col("node").alias("b"), F.struct("n", *[f"s{i}" for i in range(SKETCH)]).alias("y"))
    test = may_link(F.col("x.n"), F.col("y.n"), differing(longs("x", SKETCH), longs("y", SKETCH)), num, den)
    return pairs.join(x, "a").join(y, "b").where(test).select("a", "b")


def sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, t: Tables) -> DataFrame:
    """The sets (node, tokens) of the nodes in pairs, made again from the text of each node's first document."""
    wanted = t.keep("wanted", pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    ids = t.keep("ids", nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct())
    small = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in sliced(batches, size=SLICE):
            sets = shingler.sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    made = chosen.mapInArrow(run, "node long, tokens binary")
    sets = t.keep("sets", made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")))
    t.drop("wanted", "ids")
    return sets


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, t: Tables) -> DataFrame:
    """The pairs (a, b) whose sets truly overlap enough. Large sketches go first: only pairs that pass them are sent sets.

    Of a pair, the set with more partners is met last, so that it is sent once and the other one travels with the pair.
    """
    sets = sets_of(docs, nodes, pairs, n, t)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            bits = [sketch_of(x, LARGE_SKETCH).tobytes() for x in made]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary()), pa.array([len(x) for x in made], pa.int64())], names=["node", "tokens", "n"])

    def passing(x: bytes, y: bytes, nx: int, ny: int) -> bool:
        differ = int.bit_count(int.from_bytes(x) ^ int.from_bytes(y))
        return differ * (den + num) <= (nx + ny) * (den - num)

    def overlapping(x: bytes, y: bytes, *_: int) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return den * both >= num * (len(a) + len(b) - both)

    def kept(candidates: DataFrame, table: DataFrame, test) -> DataFrame:
        left = table.select(F.col("node").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("nx"))
        right = table.select(F.col("node").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("ny"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny")), strict=True)
                mask = pa.array([test(*r) for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

        return candidates.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long")

    large = t.keep("large", sets.mapInArrow(sketches, "node long, tokens binary, n long"))
    likely = t.keep("likely", kept(pairs, large, passing))
    partners = likely.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    turned = (
        likely.join(partners.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a")
        .join(partners.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
        .select(F.when(F.col("ka") > F.col("kb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b")).alias("p"))
        .select("p.*")
    )
    found = t.keep("found", kept(turned, sets.withColumn("n", F.lit(0).cast("long")), overlapping))
    t.drop("large", "likely", "sets")
    return found


def components(edges: DataFrame, t: Tables) -> DataFrame:
    """(node, comp) for the nodes of (a, b) edges: comp is the least node reachable. Large-star and small-star steps by turns."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = down.join(least, F.col("a") == F.col("u")).select("a", "b", "m")
        return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()

    edges = t.keep("edges", edges.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
        edges = t.keep("edges", small(large(edges)))
    comps = t.keep("comps", edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))
    t.drop("edges")
    return comps


def led(entries: DataFrame) -> DataFrame:
    """(lead, node, n, l, tokens): each set under the leaders of its prefix tokens, with the tokens that they lead.

    A token's leader is its set of the highest rank, so most tokens of a group of near copies have the same leader: the copy
    that has most in common with the others.
    """
    leaders = entries.groupBy("token").agg(F.max_by("node", "rank").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "lead")
    return entries.join(leaders, "token").groupBy("lead", "node").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.collect_list("token").alias("tokens"))


def star_pairs(under: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a set and those that may link of the LEADERS leaders that lead most tokens of its prefix."""
    most = Window.partitionBy("node").orderBy(F.desc(F.size("tokens")), "lead")
    few = under.where("node <> lead").select("node", "lead", F.row_number().over(most).alias("place")).where(F.col("place") <= LEADERS)
    return near(few.select(F.col("node").alias("a"), F.col("lead").alias("b")), sketches, num, den)


def residual_pairs(under: DataFrame, sketches: DataFrame, comps: DataFrame, num: int, den: int, t: Tables) -> DataFrame:
    """The join proper: pairs (a, b) across groups with as many shared prefix tokens as the lesser of their two l.

    Under each leader, the sets outside the leader's own group meet all others outside theirs. A shared token has one leader,
    so the tokens that a pair shares are summed over the leaders it meets under, which are few. Folded sketches are tested
    inside the join: a pair that can't link makes no row.
    """
    whole = sketches.select("node", F.struct(*[f"s{i}" for i in range(SKETCH)]).alias("whole"))
    folded = whole.select("node", *[x.alias(f"f{i}") for i, x in enumerate(longs("whole", FOLDED))])
    of = comps.select("node", F.col("comp"))
    lead = comps.select(F.col("node").alias("lead"), F.col("comp").alias("main"))
    sides = (
        under.join(of, "node", "left")
        .join(lead, "lead", "left")
        .withColumn("comp", F.coalesce("comp", "node"))
        .withColumn("outside", F.col("comp") != F.coalesce("main", "lead"))
        .drop("main")
        .join(folded, "node")
    )
    sides = t.keep("sides", sides)
    test = may_link(F.col("a.n"), F.col("b.n"), differing([F.col(f"a.f{i}") for i in range(FOLDED)], [F.col(f"b.f{i}") for i in range(FOLDED)]), num, den)
    met = (
        sides.where("outside").alias("a")
        .join(sides.alias("b"), F.col("a.lead") == F.col("b.lead"))
        .where((F.col("a.comp") != F.col("b.comp")) & (~F.col("b.outside") | (F.col("a.node") < F.col("b.node"))) & test)
        .groupBy(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))  # either set may be outside, as the leader has it
        .agg(F.sum(F.size(F.array_intersect("a.tokens", "b.tokens"))).alias("times"), F.first(F.least("a.l", "b.l")).alias("least"))
        .where("times >= least")
    )
    candidates = t.keep("candidates", near(met.select("a", "b"), sketches, num, den))
    t.drop("sides")
    return candidates


def link(docs: DataFrame, n: int, num: int, den: int, t: Tables) -> tuple[DataFrame, DataFrame]:
    """(documents with node and n, groups): groups are the connected components (node, comp) of linked nodes, sets of equal members.

    First a contraction: every set is compared with the leaders of most tokens of its prefix, and what links is one group from
    then on. This takes most of a large group of copies at a cost linear in the prefixes. Then the join proper finds all
    pairs across groups. A pair within a group is connected already, so no group is missed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = t.keep("told", summaries(docs, n))
    nodes = told.where("node IS NOT NULL").select("doc_id", "node", "n")
    frequent = told.where("token IS NOT NULL").groupBy("token").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "token").limit(HOT).collect()
    hot = np.array([r["token"] for r in frequent], np.int64).view(np.uint64)
    count = np.minimum(np.array([r["docs"] for r in frequent], np.int64), 2**31 - 1)
    by = np.argsort(hot)

    common = t.keep("common", shared(prefixes(docs, n, num, den, hot[by], count[by])))
    entries = t.keep("entries", adapted(common, num, den))
    t.drop("common")
    ends = entries.select("node").distinct()
    bits = told.where("node IS NOT NULL").select("node", F.col("n").cast("int").alias("n"), *[f"s{i}" for i in range(SKETCH)])
    sketches = t.keep("sketches", bits.join(ends, "node", "left_semi").dropDuplicates(["node"]))

    under = t.keep("under", led(entries))
    t.drop("entries")

    tried = t.keep("tried", star_pairs(under, sketches, num, den))
    links = t.keep("links", verified(tried, docs, nodes, n, num, den, t))
    comps = components(links, t)
    candidates = residual_pairs(under, sketches, comps, num, den, t)
    found = verified(candidates, docs, nodes, n, num, den, t)
    return nodes, components(links.unionByName(found), t)


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: groups of texts linked by a Jaccard similarity of num / den or more.

    A document's set has its distinct n-word shingles (words between ASCII white space, A-Z in lower case); with fewer words
    than n, the whole sequence as one. component_id is the least doc_id reachable by links. Sets are compared as 64-bit
    hashes of their shingles.

    Null and empty texts have an empty set, link with nothing and are their own component. Equal texts are linked, be they
    repeated rows. A null doc_id is never the least one, unless all of a group are null. An empty table gives no rows. Other
    columns are not read.
    """
    return grouped_rows(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of jaccard_groups with their set's node and the group's comp (null for empty sets): a doc_id may have rows in many groups."""
    with Tables(docs.sparkSession) as t:
        nodes, comps = link(docs, n, num, den, t)
        least = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
        named = t.keep("named", least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        ids = named.groupBy("comp").agg(F.min("first").alias("_id"))
        table = named.join(ids, "comp").select(F.col("node").alias("_node"), "comp", "_id")
        joined = nodes.join(table, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
        return checkpoint(joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_id", "doc_id").alias("component_id"), "node", "comp"))


def with_node(docs: DataFrame, n: int, name: str) -> DataFrame:
    """Add the node of each row's set, null for an empty one, to any table with a text column."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in sliced(batches, size=SLICE):
            nodes = [node_of(s) if len(s) else None for s in shingler.sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words and 85 of 100, as the contract has it."""
    return jaccard_groups(documents(spark, sf_dir), 4, 85, 100)
