"""How sources differ in their use of terms: exact frequency filter, then a recount into dense slots by perfect hashes."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, checkpoint, documents, process_cache, sliced, text_or_empty
from .phash import PerfectHash, binary, build, digests, shard_of

LEAST_DOCS = 30
RANKS = 50
SCALE = 1_000_000_000
PRIOR = 5
# Terms are runs of ASCII letters and of whatever lies beyond ASCII; only A-Z are lower-cased.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Keys of a shard (about), bytes of shards that are broadcast at once, and distinct counts that a task holds.
SHARD_KEYS = 4096
BROADCAST_BYTES = 48_000_000
MOST_COUNTS = 300_000
MOST_SLOTS = 8_000_000
SOURCES_AT_ONCE = 64
# Rows of one key that are added up one after the other; keys of more rows are added up in parts first.
MOST_PARTS = 1000
LONG_KEY = 256


def key_of(term: bytes) -> bytes:
    """What stands for a term among the stored keys: itself, or its length and two digests where it is very long."""
    return term if len(term) <= LONG_KEY else b" %d " % len(term) + digests([term]).tobytes() + digests([term[::-1]]).tobytes()


def read(docs: DataFrame) -> DataFrame:
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")}
    return docs.select(*[v.alias(c) for c, v in named.items()], F.encode(text_or_empty(), "utf-8").alias("text"))


def document_frequencies(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term as bytes) of all terms in at least `least` documents of the lang. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                terms = list(counts)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), binary(part), pa.array([counts[t] for t in part], pa.int64())], names=["lang", "term", "n"])
            found.clear()

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(set(text.translate(TERMS).split()))
            if sum(map(len, found.values())) > MOST_COUNTS:
                yield from flushed()
        yield from flushed()

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def perfect_hashes(kept: DataFrame, shards: int) -> DataFrame:
    """One row for each (lang, shard) that has keys: the hash's levels and bits, and the stored terms in slot order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(digests([key_of(t) for t in batch.column(1).to_pylist()]), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["lang", "term", "shard"])

    def make(table: pa.Table) -> pa.Table:
        of = {key_of(t): t for t in table.column("term").to_pylist()}
        sizes, bits, keys = build(list(of))
        terms = pa.array([[of[k] for k in keys]], pa.list_(pa.binary()))
        wide = sum(map(len, keys)) + 16 * len(keys) + len(bits)
        return pa.table([table.column("lang").slice(0, 1), table.column("shard").slice(0, 1), pa.array([len(keys)], pa.int32()), pa.array([sizes]), pa.array([bits]), terms, pa.array([wide], pa.int64())], names=["lang", "shard", "n_keys", "sizes", "bits", "terms", "bytes"])

    dealt = kept.mapInArrow(deal, "lang string, term binary, shard int")
    return dealt.groupBy("lang", "shard").applyInArrow(make, "lang string, shard int, n_keys int, sizes binary, bits binary, terms array<binary>, bytes long")


def recount(rows: DataFrame, hashes: list, name: str) -> DataFrame:
    """Occurrences of the keys of `hashes` (rows of perfect_hashes, of a bounded size) by group: (lang, source, shard, slots, counts)
    with the slots that occur. A task has one dense array of slots for each group that it meets, and hands them on when
    they are more than MOST_SLOTS.
    """
    sent = rows.sparkSession.sparkContext.broadcast([(r.lang, r.shard, r.n_keys, bytes(r.sizes), bytes(r.bits), binary([key_of(bytes(t)) for t in r.terms])) for r in hashes])
    shards = max(h.n_shards for h in hashes)

    def loaded() -> dict[str, dict[int, tuple[int, PerfectHash]]]:
        store = process_cache("recount")
        if name not in store:
            store.clear()
            of: dict[str, dict[int, tuple[int, PerfectHash]]] = defaultdict(dict)
            ends: Counter = Counter()
            for lang, shard, n, sizes, bits, keys in sent.value:
                of[lang][shard] = (ends[lang], PerfectHash(sizes, bits, keys))
                ends[lang] += n
            store[name] = of, ends
        return store[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ends = loaded()
        words: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def settle() -> None:
            for lang in {lang for lang, _ in words}:
                if lang not in of:
                    continue
                terms = list({t for (own, _), counts in words.items() if own == lang for t in counts})
                keys = [key_of(t) for t in terms]
                digest, whole = digests(keys), binary(keys)
                shard, at = shard_of(digest, shards), np.full(len(terms), -1, np.int64)
                for number, (start, hashed) in of[lang].items():
                    own = np.flatnonzero(shard == number)
                    if len(own):
                        slots = hashed.slots(whole.take(pa.array(own)), digest[own])
                        at[own] = np.where(slots < 0, -1, start + slots)
                known = {terms[i]: int(at[i]) for i in np.flatnonzero(at >= 0)}
                for (own, source), counts in words.items():
                    if own == lang and (pairs := [(known[t], n) for t, n in counts.items() if t in known]):
                        if (own, source) not in dense:
                            dense[own, source] = np.zeros(ends[lang], np.int64)
                        slots, n = np.array(pairs, np.int64).T
                        dense[own, source][slots] += n
            words.clear()

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                for shard, (start, hashed) in of[lang].items():
                    part = counts[start : start + len(hashed.keys)]
                    slots = np.flatnonzero(part)
                    if len(slots):
                        columns = [[lang], [source], [shard], [slots.astype("<i4").tobytes()], [part[slots].astype("<i8").tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "source", "shard", "slots", "counts"])
            dense.clear()

        for batch in sliced(batches):
            groups = defaultdict(list)
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups[lang, source].append(text)
            for group, texts in groups.items():
                words[group].update(b" ".join(texts).translate(TERMS).split())
            if sum(map(len, words.values())) > MOST_COUNTS:
                settle()
                if sum(map(len, dense.values())) > MOST_SLOTS:
                    yield from flushed()
        settle()
        yield from flushed()

    return rows.mapInArrow(run, "lang string, source string, shard int, slots binary, counts binary")


def dense_sums(parts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Add up sparse or dense counts of a key into one dense array: (*keys, counts, total). A key has a row from each task of the
    recount at most; where that is more than MOST_PARTS, rows are dealt into parts by a hash, and the parts' sums added up.
    """
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_PARTS:
        salt = F.pmod(F.xxhash64("slots", "counts"), F.lit(-(-most // MOST_PARTS))).cast("int")
        parts = added_up(parts.withColumn("salt", salt), sizes, ["salt", *keys]).select(*keys, F.lit(None).cast("binary").alias("slots"), "counts")
    return added_up(parts, sizes, keys)


def added_up(parts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key come one after the other in a task and are added as they come."""
    names, whole = [*keys, "counts", "total"], ("shard", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int32() if k in whole else pa.string()) for k, v in zip(keys, now, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=names)

        for batch in sliced(batches):
            for *key, slots, counts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        yield row()
                    now, total = key, np.zeros(n, "<i8")
                if slots is None:
                    total += np.frombuffer(counts, "<i8")
                else:
                    total[np.frombuffer(slots, "<i4")] += np.frombuffer(counts, "<i8")
        if now is not None:
            yield row()

    kinds = ", ".join(f"{k} {'int' if k in whole else 'string'}" for k in keys)
    joined = parts.join(sizes, ["lang", "shard"]).select(*keys, "slots", "counts", "n_keys")
    return joined.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, counts binary, total long")


def chances(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of each slot: 1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), exact."""
    if total < 2**62 // SCALE:
        return 1 + SCALE * (counts + PRIOR) // (total + PRIOR * kept)
    return np.array([1 + SCALE * (int(c) + PRIOR) // (total + PRIOR * kept) for c in counts], np.int64)


def pair_sums(blocks: DataFrame) -> DataFrame:
    """Sums of |p - q| over the slots of a shard for all pairs of sources in two blocks: (lang, source, item, value), source < item."""
    names = ["lang", "source", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, out = row["n_keys"], []
                here, there = ([(s["source"], chances(np.frombuffer(s["counts"], "<i8") if s["counts"] is not None else np.zeros(n, np.int64), s["total"], s["kept"])) for s in row[side]] for side in ("members", "others"))
                matrix = np.stack([p for _, p in there])
                for source, p in here:
                    for item, value in zip((s for s, _ in there), np.abs(matrix - p).sum(1), strict=True):
                        if row["same"] and source.encode() >= item.encode():
                            continue
                        out.append((row["lang"], source, item, int(value)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

    here = blocks.select("lang", "shard", "n_keys", "members", F.col("block").alias("_a"))
    there = blocks.select("lang", "shard", F.col("members").alias("others"), F.col("block").alias("_b"))
    both = here.join(there, ["lang", "shard"]).where("_a <= _b").select("lang", "n_keys", "members", "others", (F.col("_a") == F.col("_b")).alias("same"))
    return both.mapInArrow(run, "lang string, source string, item string, value long")


def shard_tops(slots: DataFrame, ranks: int) -> DataFrame:
    """Of each (group, shard) the first `ranks` terms with counts and p > q, by falling p - q and then by bytes: (lang, source, term, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, source, terms, counts, total, kept, all_counts, all_total = (c[i].as_py() for c in batch.columns)
                own = np.frombuffer(counts, "<i8")
                gain = chances(own, total, kept) - chances(np.frombuffer(all_counts, "<i8"), all_total, kept)
                at = np.flatnonzero((own > 0) & (gain > 0))
                if len(at) > ranks:
                    at = at[gain[at] >= np.partition(gain[at], -ranks)[-ranks]]
                best = sorted((-int(gain[k]), terms[k]) for k in at)[:ranks]
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best)), pa.array([source] * len(best)), binary([t for _, t in best]), pa.array([-g for g, _ in best], pa.int64())], names=["lang", "source", "term", "value"])

    return slots.select("lang", "source", "terms", "counts", "total", "kept", "all_counts", "all_total").mapInArrow(run, "lang string, source string, term binary, value long")


def ranked(rows: DataFrame, ranks: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if ranks is None else out.where(F.col("rank") <= ranks)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Distances between the sources of a lang, and the terms that a source uses more than its lang does.

    First pass: in how many documents of its lang each term occurs, exactly; terms in `least_docs` or more are kept. They are
    dealt into shards by digest, and each (lang, shard) gets a minimal perfect hash with its keys stored. Shards are broadcast
    `most_bytes` at a time, and each such lot takes one more pass over the texts: a term's slot is verified by the stored key
    and its group's dense array counted up. All else works on dense arrays of about SHARD_KEYS slots, a row each.

    Returns lang, source, part, item, value (long), rank (int). `pair`: item is each other source of the lang, value the sum
    of |p - q| over its kept terms, 0 if there are none. `term`: item is a term, value p - q against the lang; ranks to `ranks`.

    Null text, lang and source are read as ''. A lang with one source has no pairs. Ties are ranked by the item's bytes.
    Repeated rows are documents of their own. Other columns are not read. An empty table gives no rows. Terms longer than
    LONG_KEY bytes are told apart by their length and 256 bits of digest.
    """
    spark = docs.sparkSession
    rows = read(docs)
    with Tables(spark) as tables:
        kept = tables.keep("kept", document_frequencies(rows, least_docs))
        of_lang = checkpoint(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")))
        most = of_lang.agg(F.max("kept")).first()[0] or 0
        shards = max(1, -(-most // SHARD_KEYS))
        hashes = tables.keep("hashes", perfect_hashes(kept, shards).withColumn("n_shards", F.lit(shards)))
        sizes = hashes.select("lang", "shard", "n_keys")
        # lots of whole shards by running size; only numbers are collected, one row for each shard
        lots: list[list[tuple]] = []
        room = 0
        for r in hashes.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():
            if r.bytes > room or not lots:
                lots.append([])
                room = most_bytes
            lots[-1].append((r.lang, r.shard))
            room -= r.bytes
        parts = None
        for k, lot in enumerate(lots):
            first, last = (F.struct(F.lit(a).alias("lang"), F.lit(b).alias("shard")) for a, b in (lot[0], lot[-1]))
            here = hashes.where(F.struct("lang", "shard").between(first, last)).collect()
            counted = tables.keep(f"parts_{k}", recount(rows, here, f"{hashes.schema.simpleString()}{id(tables)}{tables.names['hashes']}{k}"))
            parts = counted if parts is None else parts.unionByName(counted)
        groups = checkpoint(rows.groupBy("lang", "source").count().drop("count"))
        if parts is None:
            parts = spark.createDataFrame([], "lang string, source string, shard int, slots binary, counts binary")
        slots = tables.keep("slots", dense_sums(parts, sizes, ["lang", "source", "shard"]))
        whole = slots.select("lang", "shard", F.lit(None).cast("binary").alias("slots"), "counts")
        of_shard = tables.keep("of_shard", dense_sums(whole, sizes, ["lang", "shard"]))

        totals = slots.groupBy("lang", "source").agg(F.sum("total").alias("total"))
        block = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SOURCES_AT_ONCE).cast("int")
        info = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
        info = checkpoint(info.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), block.alias("block")))
        lang_total = of_shard.groupBy("lang").agg(F.sum("total").alias("all_total"))

        dense = info.join(sizes, "lang").join(slots.select("lang", "source", "shard", "counts"), ["lang", "source", "shard"], "left")
        member = F.struct("source", "total", "kept", "counts")
        blocks = dense.groupBy("lang", "shard", "n_keys", "block").agg(F.collect_list(member).alias("members"))
        half = pair_sums(blocks).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        half = tables.keep("half", half)
        sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        other = info.select("lang", F.col("source").alias("item"))
        pairs = info.select("lang", "source").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
        pairs = ranked(pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")))

        own = slots.drop("total").join(info.where("total > 0"), ["lang", "source"]).join(lang_total, "lang")
        own = own.join(of_shard.select("lang", "shard", F.col("counts").alias("all_counts")), ["lang", "shard"]).join(hashes.select("lang", "shard", "terms"), ["lang", "shard"])
        tops = ranked(shard_tops(own, ranks).withColumn("item", F.col("term").cast("string")), ranks)
        columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        return checkpoint(columns(pairs, "pair").unionByName(columns(tops, "term")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, terms in at least 30 documents of their lang, terms to rank 50; cases as in source_divergence()."""
    return source_divergence(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM t) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
tg AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
tl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
pg AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
              1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(tg.total, 0) + 5 * v.v) AS p
       FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
       LEFT JOIN tg ON tg.lang = g.lang AND tg.source = g.source),
pl AS (SELECT cl.lang, cl.term, 1 + (1000000000::HUGEINT * (cl.n + 5)) // (tl.total + 5 * v.v) AS q FROM cl JOIN tl ON tl.lang = cl.lang JOIN v ON v.lang = cl.lang),
ps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM pg a JOIN pg b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(ps.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
tops AS (SELECT pg.lang, pg.source, pg.term AS item, pg.p - pl.q AS value FROM pg JOIN pl ON pg.lang = pl.lang AND pg.term = pl.term WHERE pg.n > 0 AND pg.p > pl.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tops) WHERE rank <= 50
"""
