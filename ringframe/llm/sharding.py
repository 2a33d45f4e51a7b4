"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, hex_digits, numbered, text_or_empty

SHARDS = 24
ROUND_KEYS = (48271, 69621, 16807, 39373, 62089911, 742938285)
PRIME = 2147483647
WALK = 64


def whole(value: int) -> Column:
    return F.lit(value).cast("long")


def sides(rows: int) -> tuple[int, int]:
    """The two halves a and b of the Feistel domain: a * b >= rows, with fewer than a numbers too many."""
    a = max(1, math.isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def round_value(x: Column, key: int, salt: int) -> Column:
    """The round function: an affine map, a square and an affine map modulo a prime below 2^31."""
    y = (F.pmod(x, whole(PRIME)) * whole(key) + whole(salt)) % whole(PRIME)
    return (y * y + y * whole(key % 1009) + whole(salt % 65537)) % whole(PRIME)


def permuted(pair: Column, a: int, b: int, seed: int) -> Column:
    """One pass of an alternating Feistel network over pairs (l in [0, a), r in [0, b))."""
    def left(key: int, salt: int):
        return lambda p: F.struct(((p["l"] + round_value(p["r"], key, salt)) % whole(a)).alias("l"), p["r"].alias("r"))

    def right(key: int, salt: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + round_value(p["l"], key, salt)) % whole(b)).alias("r"))

    for i, key in enumerate(ROUND_KEYS):
        # a transform of one element binds the intermediate pair, so the expression grows linearly
        pair = F.transform(F.array(pair), (right if i % 2 else left)(key, (seed * 7919 + i * 104729) % PRIME))[0]
    return pair


def shuffled_position(row: str, rows: int, seed: int = 1) -> Column:
    """The place of column `row` (0..rows-1) under the permutation: apply it until the result is below `rows`.

    Fewer than sqrt(rows)+1 numbers lie outside, so a walk of WALK steps ends for certain below about
    WALK^2 rows and with all but (1/sqrt(rows))^WALK chance beyond; a longer walk raises an error.
    """
    a, b = sides(rows)
    first = F.struct(F.expr(f"CAST({row} AS BIGINT) div {b}L").alias("l"), F.expr(f"CAST({row} AS BIGINT) % {b}L").alias("r"))
    inside = lambda p: p["l"] * whole(b) + p["r"] < whole(rows)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        permuted(first, a, b, seed),
        lambda p, _: F.when(inside(p), p).otherwise(permuted(p, a, b, seed)),
        lambda p: F.when(inside(p), p["l"] * whole(b) + p["r"]),
    )
    return F.coalesce(walked, F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """Deal the rows of `docs` (doc_id, text) into `shards` shards whose row counts differ by one at most.

    Rows get the numbers 0..n-1 by (md5 of doc_id and text checksum, doc_id, size, checksum); a Feistel
    permutation with cycle walking maps a number to a position p, and shard = p mod shards, slot = p div shards.
    So any row's place is computable from its number, and reruns agree whatever the partitioning.

    Null text counts as no bytes, null doc_id is numbered like any other; equal rows get different slots, which
    may be swapped among them. An empty table gives no rows. Other columns of `docs` are not read.
    """
    text = text_or_empty()
    base = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    base = checkpoint(base)
    rows = base.count()
    digest = F.md5(F.encode(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), "utf-8"))
    base = base.withColumn("_bucket", F.substring(digest, 1, hex_digits(rows)))
    row = numbered(base, [], "_bucket", ["doc_id", "size", "text_crc32"], "_row")
    place = row.withColumn("_place", shuffled_position("_row", max(rows, 1), seed))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(documents(spark, sf_dir))
