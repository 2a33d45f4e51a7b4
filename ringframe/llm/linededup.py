"""Line dedup: windows of three consecutive lines that were seen before are removed, covered positions merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents

LINES = 3
# Runs of removed lines are broadcast up to so many (some 100 bytes each in memory); beyond, texts are shuffled to them.
BROADCAST_RUNS = 200_000


def windows(docs: DataFrame, size: int) -> DataFrame:
    """A row (_doc, _at, _hash, _check) for each window of `size` consecutive lines that are not all blank; 128 bits of hash."""
    lines = docs.select("_doc", F.split("_text", "\n").alias("_lines"))
    starts = F.when(F.size("_lines") >= size, F.sequence(F.lit(0), F.size("_lines") - size))
    hashed = F.transform(
        starts,
        lambda i: F.when(
            F.exists(F.slice("_lines", i + 1, F.lit(size)), lambda x: F.trim(x) != ""),
            F.struct(*[F.xxhash64(F.lit(seed), *[F.get("_lines", i + k) for k in range(size)]).alias(name) for seed, name in ((1, "h"), (2, "c"))]),
        ),
    )
    found = lines.select("_doc", F.posexplode(hashed).alias("_at", "_both")).where("_both IS NOT NULL")
    return found.select("_doc", "_at", F.col("_both.h").alias("_hash"), F.col("_both.c").alias("_check"))


def covered(found: DataFrame, size: int) -> DataFrame:
    """Per document the merged runs [from, to) of lines that lie in a later occurrence of a window.

    The first occurrence is the least (document, place). Only hashes seen twice go into the join, whose right
    side has one row for each; as it is read from a checkpoint, a skewed join can split a window of any frequency.
    """
    first = checkpoint(
        found.groupBy("_hash", "_check")
        .agg(F.min(F.struct("_doc", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.col("_hash").alias("_repeated"), F.col("_check").alias("_rechecked"), "_first")
    )
    later = (
        found.join(first, (F.col("_hash") == F.col("_repeated")) & (F.col("_check") == F.col("_rechecked")))
        .where((F.col("_doc") != F.col("_first._doc")) | (F.col("_at") != F.col("_first._at")))
        .select("_doc", "_at")
    )
    order = Window.partitionBy("_doc").orderBy("_at")
    gap = F.when(F.col("_at") <= F.lag("_at").over(order) + size, 0).otherwise(1)
    runs = later.withColumn("_run", F.sum(gap).over(order)).groupBy("_doc", "_run")
    merged = runs.agg(F.min("_at").alias("from"), (F.max("_at") + size).alias("to"))
    return merged.groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_covered"))


def without(lines: Column, runs: Column) -> Column:
    """`lines` outside the sorted disjoint `runs`: the slices between one run's end and the next one's begin."""
    last = F.struct(F.size(lines).alias("from"), F.size(lines).alias("to"))
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["to"]))
    begins = F.concat(F.transform(runs, lambda r: r["from"]), F.array(last["from"]))
    return F.flatten(F.zip_with(ends, begins, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, size: int = LINES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove from each text the lines covered by a window of `size` consecutive lines that occurred before.

    Lines end at a newline and are compared as they are. Windows overlap; an occurrence is earlier if its document's
    key is less, then if it stands further up; the first occurrence of each window stays unless another window's later
    occurrence covers it. Windows of blank lines alone do not count. The result has the columns of `docs`, with the text
    changed, and n_lines, n_removed (int).

    Null texts stay null (no lines); an empty text is one blank line; texts of fewer than `size` lines have no window and
    stay. Rows that share a key are told apart by a checksum of their text; entirely equal rows count as one document and
    stay alike. Null keys come first. An empty table gives no rows. Columns named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_whole")  # so that no name of theirs meets ours
    id_ = F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"))
    keyed = docs.select(whole, id_.alias("_doc"), F.col(text).cast("string").alias("_text"))
    found = checkpoint(windows(keyed, size))
    runs = covered(found, size).select(F.col("_doc").alias("_in"), "_covered")
    runs = checkpoint(runs)
    small = (runs.agg(F.sum(F.size("_covered"))).first()[0] or 0) <= BROADCAST_RUNS
    joined = keyed.join(F.broadcast(runs) if small else runs, F.col("_doc") == F.col("_in"), "left")
    lines = F.split("_text", "\n")
    kept = F.when(F.col("_covered").isNull(), F.col("_text")).otherwise(F.array_join(without(lines, F.col("_covered")), "\n"))
    removed = F.aggregate("_covered", F.lit(0), lambda n, r: n + r["to"] - r["from"])
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"_whole.`{c}`") for c in columns],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated three-line windows."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS win FROM l
      WHERE i + 3 <= len(lines) AND (trim(lines[i + 1]) <> '' OR trim(lines[i + 2]) <> '' OR trim(lines[i + 3]) <> '')),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
kept AS (SELECT l.doc_id, l.i, l.lines[l.i + 1] AS line, g.i IS NOT NULL AS cut FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i)
SELECT d.doc_id, CAST(count(k.doc_id) AS INTEGER) AS n_lines, CAST(count(k.doc_id) FILTER (WHERE k.cut) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE NOT k.cut), '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""
