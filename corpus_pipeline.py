"""A training corpus from `documents`: toxic texts out, repeated lines out, near copies out, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last return the
columns of `docs`. Null texts count as empty, empty tables give empty results, and extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringframe.llm import jaccard, linededup, mixing, packing, toxicity
from ringframe.llm.common import checkpoint, documents, fresh, small_batches

TOXIC_FROM = 0.5
# Word shingles of five words, similarity 0.8.
SHINGLE, NUM, DEN = 5, 80, 100
# Small tables (an id or hash and a count) are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def packed(docs: DataFrame, *columns) -> DataFrame:
    """The rows as one column `row` beside `columns`, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of TOXIC_FROM or more go."""
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.score_toxicity(docs, model, score=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text, and a document that is emptied by this goes."""
    out = linededup.dedup_lines(packed(docs, "doc_id", "text"))
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of those with the least doc_id, the one with the least text. Rows without doc_id or words stay.

    What goes is decided row by row: a doc_id that is repeated with different texts may have rows in many groups.
    """
    small_batches(spark)
    groups = jaccard.grouped_rows(docs, SHINGLE, NUM, DEN)
    gone = checkpoint(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    twice = checkpoint(groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"))
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), "text", mixing.row_hash(docs, tuple(docs.columns)).alias("_hash"))
    if not twice.limit(1).count():
        return rows.join(small(gone), F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
    once = rows.join(small(twice), F.col("_id") == F.col("_twice"), "left_anti").join(small(gone), F.col("_id") == F.col("_gone"), "left_anti")
    again = jaccard.with_node(rows.join(small(twice), F.col("_id") == F.col("_twice"), "left_semi"), SHINGLE, "_node")
    first = groups.where("n_shingles > 0 AND doc_id = component_id").join(small(twice), F.col("doc_id") == F.col("_twice"), "left_semi")
    first = checkpoint(first.select(F.col("doc_id").alias("_first"), F.col("node").alias("_set"), F.col("comp").alias("_comp")).distinct())
    near = again.join(small(first), (F.col("_id") == F.col("_first")) & (F.col("_node") == F.col("_set")))
    kept = near.groupBy("_comp").agg(F.min_by("row", F.struct("text", "_hash")).alias("row")).select("row.*")
    return once.select("row.*").unionByName(again.where("_node IS NULL").select("row.*")).unionByName(kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none to two times each, so that sources come near their targets."""
    mixed = mixing.mix(docs, identity=tuple(docs.columns))
    taken = checkpoint(mixed.groupBy(F.col("row_hash").alias("_hash")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")))
    rows = packed(docs, mixing.row_hash(docs, tuple(docs.columns)).alias("_row"))
    if taken.where("_rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["_row"])  # equal rows share a hash, whose copies count for all of them
    kept = rows.join(small(taken.where("_copies > 0")), F.col("_row") == F.col("_hash"))
    return kept.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# The learned grammar and the tokenizer are beyond SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
