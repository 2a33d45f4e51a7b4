"""The parquet tables of a directory seen as the engine's fact tables; all measures are integer sums divided once, so they are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(day: str):
    return ((F.year(day) - 1995) * 4 + F.quarter(day) - 1).cast("int")


def _lattice(df: DataFrame) -> DataFrame:
    return df.withColumns({"lattice_u": (F.col("hole_id") % 10).cast("int"), "lattice_v": F.expr("CAST(hole_id div 10 AS INT)")})


def _measured(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    named = {
        "hole_id": F.col("l_suppkey").cast("int"),
        "frame_id": _frame("l_shipdate"),
        "annulus_id": (F.col("l_linenumber") - 1).cast("int"),
        "sector_id": (F.col("l_partkey") % 4).cast("int"),
    }
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select(*[named[k].alias(k) for k in keys], cents.alias("_cents"))
    value = F.sum("_cents").cast("double") / (100 * F.count(F.lit(1))).cast("double")
    return _lattice(rows.groupBy(*keys).agg(value.alias("descriptor_value"), F.count(F.lit(1)).alias("area_px")))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single measures behind radial_rows: (hole, annulus, frame, cents)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("hole_id"), (F.col("l_linenumber") - 1).cast("int").alias("annulus_id"), _frame("l_shipdate").alias("frame_id"), F.round(F.col("l_discount") * 100).cast("bigint").alias("cents")
    )


def radial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hole, frame, annulus) -> descriptor_value, lattice place."""
    return _measured(spark, sf_dir, ["hole_id", "frame_id", "annulus_id"])


def sector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hole, frame, sector, annulus) -> descriptor_value, lattice place."""
    return _measured(spark, sf_dir, ["hole_id", "frame_id", "sector_id", "annulus_id"])


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: the lattice and a position with a known jitter."""
    rows = _lattice(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("hole_id")))
    return rows.select(
        "hole_id",
        "lattice_u",
        "lattice_v",
        (100.0 + 40 * F.col("lattice_u") + F.col("hole_id") % 3).cast("double").alias("x"),
        (100.0 + 40 * F.col("lattice_v") + F.col("hole_id") % 2).cast("double").alias("y"),
        F.lit(8.0).alias("radius_inner_px"),
        (10.0 + F.col("hole_id") % 3).cast("double").alias("radius_outer_px"),
    )


def hotspot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: day as frame, the user's hole as nearest, value as distance and score."""
    events = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    return events.crossJoin(F.broadcast(n)).select(
        F.dayofyear("ts").alias("frame_id"),
        F.col("event_id").alias("hotspot_id"),
        (F.col("user_id") % F.col("_n")).cast("int").alias("nearest_hole_id"),
        F.col("value").alias("dist_to_hole_px"),
        F.col("value").alias("score"),
        F.col("user_id").alias("track_id"),
        (F.col("event_id") % 50 + 12).cast("double").alias("area_px"),
    )


def cluster_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, hole, terrace, sector, cluster) -> pixel_count; clusters are numbered by return flag and line status."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select(
        _frame("l_shipdate").alias("frame_id"),
        F.col("l_suppkey").cast("int").alias("hole_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("terrace_index"),
        (F.col("l_partkey") % 4).cast("int").alias("sector_id"),
        (flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).cast("int").alias("cluster_id"),
    )
    return rows.groupBy("frame_id", "hole_id", "terrace_index", "sector_id", "cluster_id").agg(F.count(F.lit(1)).alias("pixel_count"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pos) -> value: the mean of each event type by day, in cents divided once."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_id"), F.dayofyear("ts").alias("frame_id"), F.round(F.col("value") * 100).cast("bigint").alias("_cents"))
    return events.groupBy("entity_id", "frame_id").agg((F.sum("_cents").cast("double") / (100 * F.count(F.lit(1))).cast("double")).alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels of a frame: channels from keys, in 0..255."""
    return table(spark, sf_dir, "lineitem").select(
        _frame("l_shipdate").alias("frame_id"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"),
        (F.col("l_partkey") % 256).cast("int").alias("g"),
        (F.col("l_suppkey") % 256).cast("int").alias("b"),
        (F.col("l_linenumber") - 1).cast("int").alias("region_id"),
    )


# The same views for DuckDB.
_Q = "CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER)"
_V = "CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS descriptor_value, count(*) AS area_px"
_UV = "CAST(l_suppkey % 10 AS INTEGER) AS lattice_u, CAST(l_suppkey // 10 AS INTEGER) AS lattice_v"
SQL = {
    "radial": f"radial AS (SELECT CAST(l_suppkey AS INTEGER) AS hole_id, {_Q} AS frame_id, CAST(l_linenumber - 1 AS INTEGER) AS annulus_id, {_UV}, {_V} FROM lineitem GROUP BY ALL)",
    "sector": f"sector AS (SELECT CAST(l_suppkey AS INTEGER) AS hole_id, {_Q} AS frame_id, CAST(l_partkey % 4 AS INTEGER) AS sector_id, CAST(l_linenumber - 1 AS INTEGER) AS annulus_id, {_UV}, {_V} FROM lineitem GROUP BY ALL)",
    "holes": """holes AS (SELECT CAST(s_suppkey AS INTEGER) AS hole_id, CAST(s_suppkey % 10 AS INTEGER) AS lattice_u, CAST(s_suppkey // 10 AS INTEGER) AS lattice_v,
        CAST(100 + 40 * (s_suppkey % 10) + s_suppkey % 3 AS DOUBLE) AS x, CAST(100 + 40 * (s_suppkey // 10) + s_suppkey % 2 AS DOUBLE) AS y,
        CAST(8 AS DOUBLE) AS radius_inner_px, CAST(10 + s_suppkey % 3 AS DOUBLE) AS radius_outer_px FROM supplier)""",
    "hotspots": """hotspots AS (SELECT CAST(dayofyear(ts) AS INTEGER) AS frame_id, event_id AS hotspot_id, CAST(user_id % (SELECT count(*) FROM supplier) AS INTEGER) AS nearest_hole_id,
        value AS dist_to_hole_px, value AS score, user_id AS track_id, CAST(event_id % 50 + 12 AS DOUBLE) AS area_px FROM events)""",
    "tensor": f"""tensor AS (SELECT {_Q} AS frame_id, CAST(l_suppkey AS INTEGER) AS hole_id, CAST(l_linenumber - 1 AS INTEGER) AS terrace_index, CAST(l_partkey % 4 AS INTEGER) AS sector_id,
        CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS cluster_id, count(*) AS pixel_count FROM lineitem GROUP BY ALL)""",
    "series": "series AS (SELECT event_type AS entity_id, CAST(dayofyear(ts) AS INTEGER) AS frame_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)",
    "pixels": f"pixels AS (SELECT {_Q} AS frame_id, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g, CAST(l_suppkey % 256 AS INTEGER) AS b, CAST(l_linenumber - 1 AS INTEGER) AS region_id FROM lineitem)",
}
