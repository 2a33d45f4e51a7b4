"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, hex_digits, numbered, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


# Sources are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000


def row_hash(docs: DataFrame, columns: tuple[str, ...]) -> Column:
    """A hash of the row's `columns`, of any type: maps, which have no hash, are taken as JSON."""
    has_map = lambda kind: "map<" in kind.simpleString()
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if has_map(docs.schema[c].dataType) else F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*plain)


def ranged(df: DataFrame, order: list[str], value: str, before: str) -> DataFrame:
    """Sort globally by `order` into ranges and add `before`, the sum of `value` over all rows that come earlier.

    Each range is summed by itself; the ranges' sums, one row each, give the offsets.
    """
    sorted_ = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = sorted_.groupBy("_range").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sorted_.join(F.broadcast(offsets), "_range")
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_offset")
    )


def targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Add `target` to a table (source, words, weight): `share` of all words dealt by weight, none above `repeats` times its
    words; what a source cannot take is dealt again among the others by weight until none is above.

    Each round is one aggregate over the sources; a round fixes the sources that are above at the present level.
    """
    full = F.col("words") * F.lit(float(repeats))
    total = sources.agg(F.sum("words")).first()[0] or 0
    left, level, capped = float(total) * min(share, repeats), 0.0, F.lit(False)
    while True:
        free = sources.where(~capped).agg(F.sum("weight")).first()[0] or 0
        taken = sources.where(capped).agg(F.sum(full)).first()[0] or 0.0
        if not free:
            break
        level = max(level, (left - taken) / free)
        above = F.col("weight") * F.lit(level) > full
        if not sources.where(above & ~capped).limit(1).count():
            break
        capped = above
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), full) if level else full)


def weighted_sources(base: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources by code point, null last, with their words and the weights in turn; numbered by ranges, not in one task."""
    sums = base.groupBy("_source").agg(F.sum("_size").alias("words"))
    named = sums.select(F.col("_source").isNull().cast("int").alias("_null"), F.coalesce("_source", F.lit("")).alias("_name"), "_source", "words", F.lit(1).alias("_one"))
    numbers = ranged(named, ["_null", "_name"], "_one", "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    return numbers.select("_source", "words", turn.alias("weight"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    cut: bool = False,
    seed: int = 1,
    identity: tuple[str, ...] = ("doc_id", "text", "source"),
) -> DataFrame:
    """Take whole documents, up to `repeats` times each, so that each source's words come near its target.

    A source is a queue of its documents in an order shuffled by md5, run through `repeats` times. A document's virtual
    finish time is the queue's words up to its end, divided by the source's target. All documents are sorted globally by
    finish time (then source, place) and taken while the total stays within the sum of targets; the one that crosses it is
    left out. With `cut`, each source's document that runs over time 1 ends there: it is the only one taken in part.

    Columns of `docs` used: doc_id, text, source and those in `identity`. Returns doc_id, source, row_hash (of the identity
    columns), size, source_size (long), target (double), taken (long: words), copies (long: how often the document is
    taken). No text is shuffled.

    Null texts have no words; documents without words are taken for nothing and have taken 0. Null source is a source, the
    last one. Rows that share doc_id and text are separate documents. A source without words has target 0. An empty table
    gives no rows. Reruns agree, as ties end in numbers that are dense for each source; entirely equal rows may be swapped.
    """
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    whole = row_hash(docs, identity)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), whole))
    base = checkpoint(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("_source"),
            words.alias("_size"),
            F.md5(F.encode(F.concat(F.lit(f"{seed}:"), name), "utf-8")).alias("_digest"),
            whole.alias("row_hash"),
        )
    )
    rows = base.count()
    sources = checkpoint(targets(checkpoint(weighted_sources(base, weights)), share, repeats))
    budget = int(sources.agg(F.sum("target")).first()[0] or 0)

    bucketed = base.withColumn("_bucket", F.substring("_digest", 1, hex_digits(rows)))
    order = ["_digest", "_size", "row_hash"]
    placed = numbered(bucketed, ["_source"], "_bucket", order, "_place")
    # words of the source before a document: of earlier buckets, then of earlier documents of its bucket
    inside = Window.partitionBy("_source", "_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = sums.select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"),
        (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")).alias("_earlier"),
    )
    queue = (
        placed.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(earlier, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_before", F.col("_earlier") + F.col("_within"))
        .drop("_earlier", "_within", "_s", "_b", "_bucket")
    )
    known = sources.select(F.col("_source").alias("_s"), F.col("words").alias("source_size"), "target")
    known = F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known
    queue = checkpoint(queue.join(known, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))

    begin = F.col("_turn") * F.col("source_size") + F.col("_before")
    room = F.greatest(F.ceil(F.col("target") - begin), F.lit(0)).cast("long") if cut else F.col("_size")
    turns = (
        queue.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("_words", F.least("_size", room))
        .where((F.col("_words") > 0) | (F.col("_size") == 0))
        .select("_source", "_place", "_turn", "_words", F.try_divide((begin + F.col("_words")).cast("double"), "target").alias("_finish"))
        .where("_finish IS NOT NULL")
    )
    ordered = ranged(turns, ["_finish", "_source", "_turn", "_place"], "_words", "_passed")
    room = F.lit(budget).cast("long") - F.col("_passed")
    part = F.least("_words", F.greatest(room, F.lit(0).cast("long"))) if cut else F.when(F.col("_words") <= room, F.col("_words")).otherwise(F.lit(0).cast("long"))
    taken = (
        ordered.withColumn("_part", part)
        .where((F.col("_part") > 0) | (F.col("_words") == 0) & (room >= 0))
        .groupBy(F.col("_source").alias("_s"), F.col("_place").alias("_p"))
        .agg(F.sum("_part").alias("taken"), F.count(F.lit(1)).alias("copies"))
    )
    out = queue.join(taken, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_place") == F.col("_p")), "left")
    return out.select(
        "doc_id", F.col("_source").alias("source"), "row_hash", F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), cut=True).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('1:' || doc_id) AS dg FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
s1 AS (SELECT source, words, CAST([5, 2, 1][1 + rk % 3] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, 2.0 * words / weight AS ratio,
              coalesce(sum(2 * words) OVER (ORDER BY 2.0 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
              sum(weight) OVER (ORDER BY 2.0 * words / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
              sum(words) OVER () AS total, row_number() OVER (ORDER BY 2.0 * words / weight, source) AS k FROM s1),
lev AS (SELECT (CAST(total AS DOUBLE) * 1.5 - CAST(capped AS DOUBLE)) / free AS level FROM s2 WHERE (CAST(total AS DOUBLE) * 1.5 - CAST(capped AS DOUBLE)) / free <= ratio ORDER BY k LIMIT 1),
s AS (SELECT source, words AS source_size, least(weight * level, CAST(2 * words AS DOUBLE)) AS target FROM s1, lev),
q AS (SELECT d.*, s.source_size, s.target, row_number() OVER w AS place,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WINDOW w AS (PARTITION BY d.source ORDER BY dg)),
p0 AS (SELECT *, unnest([0, 1]) AS turn FROM q),
p1 AS (SELECT *, least(size, CAST(greatest(ceil(target - (turn * source_size + before)), 0) AS BIGINT)) AS words FROM p0),
p AS (SELECT *, CAST(turn * source_size + before + words AS DOUBLE) / target AS finish FROM p1),
r AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source NULLS FIRST, turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM p),
b AS (SELECT CAST(floor(sum(target)) AS BIGINT) AS budget FROM s)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(least(words, greatest(budget - passed, 0))) AS BIGINT) AS taken
FROM r, b GROUP BY doc_id
"""
