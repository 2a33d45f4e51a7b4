"""Quality gates: named checks collected as rows; an optional raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row (name, passed, detail) per check; a check is an aggregate condition, null counts as failed. One pass over `df`."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()], F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("passed")) for k in checks])
    return one.select(F.explode(rows).alias("g"), "_n").select("g.name", "g.passed", F.concat(F.lit("rows="), F.col("_n").cast("string")).alias("detail"))


def union(parts: list[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of the parts by column name; each row once if `distinct`."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.distinct() if distinct else whole


def require(results: DataFrame) -> None:
    failed = [r["name"] for r in results.where("NOT passed").collect()]
    if failed:
        raise ValueError("failed gates: " + ", ".join(sorted(failed)))


def radial_input_guard(frames: DataFrame, holes: DataFrame, support: DataFrame) -> DataFrame:
    """Whether radial clusters can be measured, as one row: ok, reason (null if ok) and what it rests on.

    There must be frames and holes, and no frame may have more holes than disks of the median outer radius fit into the
    support's area. `frames` (frame_id), `holes` (frame_id, radius_outer_px), `support` (y, x: the places that count). Radii
    that are null, NaN, infinite or not positive say nothing; without any, or without support, the last rule doesn't apply.
    """
    radius = F.col("radius_outer_px")
    per = frames.select("frame_id").distinct().join(holes.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n")), "frame_id", "left")
    counts = per.agg(F.count(F.lit(1)).alias("n_frames"), F.coalesce(F.max("_n"), F.lit(0)).alias("max_frame_holes"))
    known = holes.join(frames.select("frame_id").distinct(), "frame_id", "left_semi").where((radius > 0) & (radius < float("inf")))
    middle = known.agg(F.coalesce(F.median("radius_outer_px"), F.lit(0.0)).alias("median_hole_radius_px"))
    area = support.select("y", "x").distinct().agg(F.count(F.lit(1)).alias("support_area_px"))
    one = counts.crossJoin(middle).crossJoin(area)  # three rows
    fits = F.greatest(F.lit(1), F.floor(F.col("support_area_px") / (F.pi() * F.col("median_hole_radius_px") * F.col("median_hole_radius_px"))))
    one = one.withColumn("physical_max_holes", F.when((F.col("median_hole_radius_px") > 0) & (F.col("support_area_px") > 0), fits).otherwise(0).cast("bigint"))
    crowded = (F.col("physical_max_holes") > 0) & (F.col("max_frame_holes") > F.col("physical_max_holes"))
    reason = F.when(F.col("n_frames") == 0, "no_frames").when(F.col("max_frame_holes") == 0, "no_holes").when(crowded, "hole_count_exceeds_physical_nonoverlap_limit")
    return one.withColumn("reason", reason).select(F.col("reason").isNull().alias("ok"), "reason", "max_frame_holes", "physical_max_holes", "median_hole_radius_px", "support_area_px")


def geometry_checks(holes: DataFrame, basis: DataFrame, height: int, width: int, common_radius: float, support: DataFrame | None = None, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """Named checks of a found geometry: name, passed, severity (fail or warn) and the value that decided (null where there is none).

    `holes` has x and y, `basis` one row with confidence, spacing_u_px and spacing_v_px, `support` the places (y, x) that count
    (none given: the whole frame); with `circle` (x, y, radius) two checks more. One pass over each table; the rest is one row.
    """
    centre = F.lit(False) if circle is None else F.hypot(F.col("x") - circle[0], F.col("y") - circle[1]) > circle[2] + 1.0
    one = holes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(centre.cast("bigint")), F.lit(0)).alias("outside"))
    area = F.lit(height * width).cast("bigint").alias("area")
    one = one.withColumn("area", area) if support is None else one.crossJoin(support.select("y", "x").distinct().agg(F.count(F.lit(1)).alias("area")))
    one = one.crossJoin(basis.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("confidence", "spacing_u_px", "spacing_v_px")]))
    u, v = F.col("spacing_u_px"), F.col("spacing_v_px")
    spacing = F.when((u > 0) & (v > 0), F.least(u, v)).otherwise(F.greatest(u, v))
    fits = F.when((F.lit(common_radius) > 0) & (F.col("area") > 0), F.greatest(F.lit(1), F.floor(F.col("area") / (F.pi() * common_radius * common_radius)))).otherwise(0)
    one = one.withColumns({"ratio": F.when(spacing > 0, F.lit(float(common_radius)) / spacing), "fits": fits, "share": F.col("area") / float(max(1, height * width))})
    one = one.withColumn("full", F.col("share") > 0.985)
    n, full, diagonal = F.col("n"), F.col("full"), float((height**2 + width**2) ** 0.5)
    # The checks' names, severities and limits.
    checks = [
        ("minimum_hole_count", n >= 8, F.lit("fail"), n),
        ("lattice_confidence", F.col("confidence") >= F.when(full & (n >= 12), 0.65).otherwise(0.75), F.lit("fail"), F.col("confidence")),
        ("radius_spacing_ratio", F.coalesce(F.col("ratio").between(0.08, 0.42), F.lit(False)), F.lit("warn"), F.col("ratio")),
        ("physical_nonoverlap_hole_count", ~((F.col("fits") > 0) & (n > F.col("fits"))), F.lit("fail"), F.col("fits")),
        ("support_not_empty", F.col("area") > 0, F.lit("fail"), F.col("area")),
        ("support_is_object_specific", ~full, F.lit("warn"), F.col("share")),
        ("full_frame_support_hole_count", ~(full & (n > 180)), F.lit("warn"), n),
    ]
    if circle is not None:
        large = F.lit(circle[2] > 0.75 * diagonal)
        checks += [("support_circle_scale", ~(large & (n > 180)), F.when(full, "warn").otherwise("fail"), F.lit(float(circle[2]))), ("hole_centers_inside_support", F.col("outside") == 0, F.lit("fail"), F.col("outside"))]
    rows = [F.struct(F.lit(name).alias("name"), passed.alias("passed"), severity.alias("severity"), value.cast("double").alias("value")) for name, passed, severity, value in checks]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def verdict(checks: DataFrame) -> DataFrame:
    """One row of checks with severities: passed, status (ok, warn or fail), and how many failed and warned."""
    bad = lambda kind: F.coalesce(F.sum((~F.col("passed") & (F.col("severity") == kind)).cast("bigint")), F.lit(0)).cast("bigint")
    counts = checks.agg(bad("fail").alias("fail_count"), bad("warn").alias("warning_count"))
    status = F.when(F.col("fail_count") > 0, "fail").when(F.col("warning_count") > 0, "warn").otherwise("ok")
    return counts.select((F.col("fail_count") == 0).alias("passed"), status.alias("status"), "fail_count", "warning_count")


def run_summary(audit: DataFrame, correction: DataFrame, basis: DataFrame, reference: DataFrame, checks: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """One row for a run: frames, accepted and rejected ones, the chosen correction (method), the lattice, the reference frame, the
    geometry's status, and the number of rows of each table in `counted` under its name. Every part is aggregated to one row first.
    """
    one = audit.agg(F.count(F.lit(1)).alias("n_frames"), *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint").alias(k) for k, c in (("accepted_frames", F.col("accepted")), ("rejected_frames", ~F.col("accepted")))])
    turned = F.degrees(F.atan2(F.max("a_y"), F.max("a_x")))
    parts = [
        correction.agg(F.max("method").alias("winner_correction")),
        basis.agg(F.max("confidence").alias("lattice_confidence"), F.max("spacing_u_px").alias("spacing_u_px"), F.max("spacing_v_px").alias("spacing_v_px"), turned.alias("angle_deg")),
        reference.agg(F.max("reference_frame_id").alias("reference_frame_id")),
        verdict(checks).select(F.col("status").alias("geometry_status")),
        *[rows.agg(F.count(F.lit(1)).alias(name)) for name, rows in counted.items()],
    ]
    return reduce(DataFrame.crossJoin, parts, one)
