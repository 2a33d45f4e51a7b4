"""The lattice: neighbour pairs, coherence, smoothness, least squares, terrace widths, completeness, relation to a circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.sources.scratch import checkpointed


def offsets(radius: int) -> Column:
    near = [(u, v) for u in range(-radius, radius + 1) for v in range(-radius, radius + 1) if 0 < abs(u) + abs(v) <= radius]
    return F.array(*[F.struct(F.lit(u).alias("du"), F.lit(v).alias("dv"), F.lit(abs(u) + abs(v)).alias("d")) for u, v in near])


def neighbours(holes: DataFrame, radius: int = 1) -> DataFrame:
    """Ordered pairs of holes within a Manhattan distance: an equi-join on the offset place, not a range join."""
    known = holes.where("lattice_u IS NOT NULL AND lattice_v IS NOT NULL")
    a = known.withColumn("_o", F.explode(offsets(radius))).select(*[F.col(c).alias(f"a_{c}") for c in holes.columns], (F.col("lattice_u") + F.col("_o.du")).alias("_u"), (F.col("lattice_v") + F.col("_o.dv")).alias("_v"), F.col("_o.d").alias("distance"))
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in holes.columns])
    return a.join(b, (F.col("_u") == F.col("b_lattice_u")) & (F.col("_v") == F.col("b_lattice_v"))).drop("_u", "_v")


def neighbour_pairs(labelled: DataFrame) -> DataFrame:
    """Each pair of direct neighbours once, with their labels and whether they agree."""
    pairs = neighbours(labelled, 1).where("(a_lattice_u, a_lattice_v) < (b_lattice_u, b_lattice_v)")
    return pairs.select(
        F.col("a_hole_id").alias("hole_id_a"), F.col("b_hole_id").alias("hole_id_b"), F.col("a_label").alias("label_a"), F.col("b_label").alias("label_b"),
        (F.col("a_label") == F.col("b_label")).alias("same_label"),
    )


def smoothness(labelled: DataFrame, radius: int = 2) -> DataFrame:
    """Per hole: the share of its neighbours' weight (1 / distance) that has its label; null without neighbours."""
    w = 1.0 / F.col("distance")
    near = neighbours(labelled, radius).groupBy(F.col("a_hole_id").alias("hole_id")).agg(
        (F.sum(F.when(F.col("a_label") == F.col("b_label"), w).otherwise(0.0)) / F.sum(w)).alias("spatial_smoothness"), F.count(F.lit(1)).alias("neighbor_count")
    )
    return labelled.select("hole_id", "label").join(near, "hole_id", "left").withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0).cast("long")))


def least_squares(holes: DataFrame) -> DataFrame:
    """The lattice that fits best: origin and two basis vectors, x and y each a plane over (u, v), by Cramer's rule on sums; one row."""
    u, v = F.col("lattice_u").cast("double"), F.col("lattice_v").cast("double")
    c = lambda a, b: F.covar_pop(a, b)
    s = holes.agg(
        c(u, u).alias("uu"), c(v, v).alias("vv"), c(u, v).alias("uv"),
        *[c(u, F.col(z)).alias(f"u{z}") for z in "xy"], *[c(v, F.col(z)).alias(f"v{z}") for z in "xy"],
        F.avg(u).alias("mu"), F.avg(v).alias("mv"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n_holes"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    out = s
    for z in "xy":
        out = out.withColumn(f"a_{z}", F.try_divide(F.col(f"u{z}") * F.col("vv") - F.col(f"v{z}") * F.col("uv"), det))
        out = out.withColumn(f"b_{z}", F.try_divide(F.col(f"v{z}") * F.col("uu") - F.col(f"u{z}") * F.col("uv"), det))
        out = out.withColumn(f"origin_{z}", F.col(f"m{z}") - F.col(f"a_{z}") * F.col("mu") - F.col(f"b_{z}") * F.col("mv"))
    return out.select("origin_x", "origin_y", "a_x", "a_y", "b_x", "b_y", "n_holes")


def fit_quality(holes: DataFrame, basis: DataFrame) -> DataFrame:
    """The basis of `least_squares` (one row) with its spacings, the mean distance of holes from their places under it, and the
    confidence 1 / (1 + residual / spacing), of the smaller spacing. Null without a basis.
    """
    u, v = F.col("lattice_u"), F.col("lattice_v")
    off = F.hypot(*[F.col(z) - F.col(f"origin_{z}") - F.col(f"a_{z}") * u - F.col(f"b_{z}") * v for z in "xy"])
    away = holes.crossJoin(F.broadcast(basis)).agg(F.avg(off).alias("residual_px"))
    spaced = basis.withColumns({"spacing_u_px": F.hypot("a_x", "a_y"), "spacing_v_px": F.hypot("b_x", "b_y")}).crossJoin(away)
    return spaced.withColumn("confidence", 1 / (1 + F.col("residual_px") / F.greatest(F.least("spacing_u_px", "spacing_v_px"), F.lit(1e-6))))


def nearest_pitch(holes: DataFrame) -> DataFrame:
    """One row over all pairs: the least distance of two centres, and the least positive gap of two borders (null where there is none).

    Pairs meet on a grid of cells, which doubles until the answer must be among those met: the borders of centres farther apart than
    a cell are farther apart than the least gap found. With no positive gap at all, that is a grid as wide as the holes' extent.
    """
    extent = holes.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("radius_outer_px"), F.count(F.lit(1))).first()
    span, radius = max(extent[0] or 0.0, extent[1] or 0.0) + 1.0, max(extent[2] or 0.0, 0.0)

    def met(size: float) -> tuple[float | None, float | None]:
        cell = lambda c: F.floor(F.col(c) / size)
        offsets = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
        a = holes.select(F.col("hole_id").alias("_a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), F.greatest("radius_outer_px", F.lit(0.0)).alias("_ar"), cell("x").alias("_cx"), cell("y").alias("_cy"))
        b = holes.select("hole_id", "x", "y", F.greatest("radius_outer_px", F.lit(0.0)).alias("_br"), F.explode(offsets).alias("_o")).withColumns({"_cx": cell("x") + F.col("_o.u"), "_cy": cell("y") + F.col("_o.v")})
        away = F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay"))
        gap = away - F.col("_ar") - F.col("_br")
        near = a.join(b, ["_cx", "_cy"]).where((F.col("_a") < F.col("hole_id")) & (away <= size))
        return tuple(near.agg(F.min(away), F.min(F.when(gap > 0, gap))).first())

    size, pitch, gap = max(1.0, span / max(1.0, float(extent[3] or 1) ** 0.5)), None, None
    while extent[3]:
        pitch, gap = met(size)
        whole = size >= 1.5 * span
        if whole or pitch is not None and gap is not None and gap + 2 * radius <= size:
            break
        size *= 2
    return holes.sparkSession.createDataFrame([(pitch, gap)], "min_center_px double, min_gap_px double")


def terrace_width_plan(holes: DataFrame, n_terraces: int = 8, width_mode: str = "fixed", gap_basis: str = "border_gap", outer_radius: float | None = None, min_width: float = 0.0) -> DataFrame:
    """Terrace widths of each hole from the room to its direct lattice neighbours.

    `width_mode` is fixed (to `outer_radius`, else 2.5 radii beyond the hole, 8 px at least), half_gap or full_gap of the least
    border gap or centre pitch (`gap_basis`) to a neighbour; a hole without neighbours (or without a positive gap) takes the
    least one of all pairs. Where that leaves no room, `outer_radius` is used if given. Widths are `min_width` at least.
    """
    if width_mode not in ("fixed", "half_gap", "full_gap") or gap_basis not in ("border_gap", "center_pitch"):
        raise ValueError(f"unknown width mode or gap basis: {width_mode}, {gap_basis}")
    center = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    border = center - F.greatest("a_radius_outer_px", F.lit(0.0)) - F.greatest("b_radius_outer_px", F.lit(0.0))
    own = neighbours(holes, 1).groupBy(F.col("a_hole_id").alias("hole_id")).agg(F.count(F.lit(1)).alias("_n"), F.min(center).alias("_center"), F.min(F.when(border > 0, border)).alias("_gap"))
    out = holes.join(own, "hole_id", "left").crossJoin(F.broadcast(nearest_pitch(holes)))
    out = out.withColumns({"neighbor_count": F.coalesce("_n", F.lit(0).cast("bigint")), "min_center_pitch_px": F.coalesce("_center", "min_center_px"), "min_border_gap_px": F.coalesce("_gap", "min_gap_px")})
    fallback = F.when((F.col("neighbor_count") == 0) | (F.lit(gap_basis == "border_gap") & F.col("_gap").isNull()), "global_min_gap").otherwise("neighbors")
    if width_mode == "fixed":
        reach = F.lit(float(outer_radius)) if outer_radius is not None else F.col("radius_outer_px") + 2.5 * F.greatest("radius_outer_px", F.lit(8.0))
        span = F.greatest(reach - F.col("radius_outer_px"), F.lit(0.0))
    else:
        span = F.coalesce("min_center_pitch_px" if gap_basis == "center_pitch" else "min_border_gap_px", F.lit(0.0)) * (1.0 if width_mode == "full_gap" else 0.5)
        span = F.greatest(span, F.lit(0.0))
        if outer_radius is not None:
            fallback = F.when(span <= 0, "fixed_outer_radius").otherwise(fallback)
            span = F.when(span <= 0, F.greatest(F.lit(float(outer_radius)) - F.col("radius_outer_px"), F.lit(0.0))).otherwise(span)
    out = out.withColumn("annulus_width_px", F.greatest(span / max(1, n_terraces), F.lit(float(min_width)))).withColumn("fallback_mode", fallback)
    out = out.withColumn("usable_annulus_span_px", F.col("annulus_width_px") * max(1, n_terraces))
    return out.select("hole_id", "neighbor_count", "min_center_pitch_px", "min_border_gap_px", "usable_annulus_span_px", "annulus_width_px", "fallback_mode", (F.col("radius_outer_px") + F.col("usable_annulus_span_px")).alias("terrace_outer_radius_px"))


def terrace_plan(holes: DataFrame, n_terraces: int = 8, min_width: float = 1.0) -> DataFrame:
    """Per hole: the least gap between its border and a direct neighbour's, or the global least one, half of it dealt to the terraces."""
    gap = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) - F.col("a_radius_outer_px") - F.col("b_radius_outer_px")
    own = neighbours(holes, 1).groupBy(F.col("a_hole_id").alias("hole_id")).agg(F.min(gap).alias("own_gap"))
    least = own.agg(F.min("own_gap").alias("least_gap"))
    out = holes.join(own, "hole_id", "left").crossJoin(F.broadcast(least)).withColumn("gap_px", F.greatest(F.coalesce("own_gap", "least_gap"), F.lit(0.0)))
    out = out.withColumn("terrace_width_px", F.greatest(F.col("gap_px") / 2 / n_terraces, F.lit(min_width)))
    return out.select("hole_id", "gap_px", "terrace_width_px", (F.col("radius_outer_px") + n_terraces * F.col("terrace_width_px")).alias("terrace_outer_radius_px"))


def terrace_annuli(plan: DataFrame, n_terraces: int = 8) -> DataFrame:
    """One row per annulus with its radii."""
    start = F.col("terrace_outer_radius_px") - n_terraces * F.col("terrace_width_px")
    rows = plan.withColumn("annulus_id", F.explode(F.sequence(F.lit(0), F.lit(n_terraces - 1))))
    return rows.select("hole_id", "annulus_id", (start + F.col("annulus_id") * F.col("terrace_width_px")).alias("r_inner_px"), (start + (F.col("annulus_id") + 1) * F.col("terrace_width_px")).alias("r_outer_px"))


def relation(holes: DataFrame, cx: float, cy: float, radius: float, tolerance: float = 0.5) -> DataFrame:
    """Each hole's disk against a circle: inside, outside, intersects, or unknown without a position."""
    d = F.hypot(F.col("x") - cx, F.col("y") - cy)
    r = F.col("radius_outer_px")
    kind = F.when(d.isNull() | r.isNull(), "unknown").when(d + r <= radius + tolerance, "inside").when(d - r >= radius - tolerance, "outside").otherwise("intersects")
    return holes.select("hole_id", d.alias("center_distance_px"), kind.alias("relation"))


def exclusions(holes: DataFrame, width: float, height: float, reach: float | Column, cx: float, cy: float, radius: float) -> DataFrame:
    """Why a hole is not measured: its disk or its terraces (`reach` beyond the disk) leave the frame, or its terraces leave the circle."""

    def leaves(r: Column) -> Column:
        return (F.col("x") - r < 0) | (F.col("x") + r > width) | (F.col("y") - r < 0) | (F.col("y") + r > height)

    outer = F.col("radius_outer_px") + reach
    flags = {
        "hole_outside_frame": leaves(F.col("radius_outer_px")),
        "terrace_outside_frame": leaves(outer),
        "terrace_outside_circle": F.hypot(F.col("x") - cx, F.col("y") - cy) + outer > radius,
    }
    reasons = F.concat_ws(";", *[F.when(f, F.lit(k)) for k, f in flags.items()])
    return holes.select("hole_id", *[f.alias(k) for k, f in flags.items()], reasons.alias("reasons"), (reasons == "").alias("is_complete"))


def containment(holes: DataFrame, height: int, width: int, circle: tuple[float, float, float] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The four flags of each hole (hole_id, x, y, radius_outer_px, terrace_outer_radius_px): its disk and its terraces inside the frame,
    and inside the wafer, which is the circle if there is one, else the mask's places (y, x), else everything.

    A disk is inside a mask if it is inside the frame and all places within its radius (there must be one) are in the mask:
    the places of each disk are counted and those in the mask are joined. Only disks inside the frame are laid out, row by row.
    """
    outer = F.greatest("radius_outer_px", F.lit(0.0))
    sizes = {"hole": outer, "terrace": F.greatest("terrace_outer_radius_px", outer)}
    within = lambda r: (F.col("x") - r >= 0) & (F.col("y") - r >= 0) & (F.col("x") + r <= width - 1) & (F.col("y") + r <= height - 1)
    out = holes.select("hole_id", "x", "y", *[r.alias(f"_{k}") for k, r in sizes.items()])
    for k in sizes:
        out = out.withColumn(f"{k}_inside_frame", within(F.col(f"_{k}")))
    if circle is not None:
        for k in sizes:
            out = out.withColumn(f"{k}_inside_wafer", F.hypot(F.col("x") - circle[0], F.col("y") - circle[1]) + F.col(f"_{k}") <= circle[2] + 1e-6)
    elif mask is not None:
        span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - F.col("_terrace")).cast("int"), F.ceil(F.col(c) + F.col("_terrace")).cast("int")))
        disks = out.where("hole_inside_frame").select("hole_id", F.col("x").alias("_px"), F.col("y").alias("_py"), "_hole", "_terrace", span("x").alias("x")).withColumn("y", span("_py"))
        away = (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py"))
        known = disks.where(away <= F.col("_terrace") * F.col("_terrace")).withColumn("_near", away <= F.col("_hole") * F.col("_hole")).join(mask.select("y", "x").distinct().withColumn("_in", F.lit(True)), ["y", "x"], "left")
        sound = known.groupBy("hole_id").agg(F.bool_and(F.col("_in").isNotNull()).alias("_all_terrace"), F.bool_and(F.when(F.col("_near"), F.col("_in").isNotNull())).alias("_all_hole"))
        out = out.join(sound, "hole_id", "left")
        for k in sizes:
            out = out.withColumn(f"{k}_inside_wafer", F.col(f"{k}_inside_frame") & F.coalesce(f"_all_{k}", F.lit(False)))
    else:
        out = out.withColumns({f"{k}_inside_wafer": F.lit(True) for k in sizes})
    flags = [f"{k}_inside_{of}" for of in ("frame", "wafer") for k in sizes]
    reasons = F.concat_ws(";", *[F.when(~F.col(f), f.replace("_inside_", "_outside_")) for f in flags])
    return out.select("hole_id", *flags, reasons.alias("reasons"))


def reason_counts(excluded: DataFrame) -> DataFrame:
    return excluded.where("reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def complete(holes: DataFrame, width: float, height: float, cx: float, cy: float, radius: float, n_terraces: int = 8) -> DataFrame:
    """Holes whose disks and planned terraces fit, as a fixed point: widths are planned anew after each pass that excludes some.

    Per hole: status, reasons, the pass that excluded it, and a dense new id for the kept ones (the dimension of holes is numbered
    in one place). Passes are cut by checkpoints; only the count of those excluded comes back.
    """
    active, out, passes = checkpointed(holes), [], 0
    while True:
        passes += 1
        planned = active.join(terrace_plan(active, n_terraces).select("hole_id", "terrace_outer_radius_px"), "hole_id")
        seen = checkpointed(exclusions(planned, width, height, F.col("terrace_outer_radius_px") - F.col("radius_outer_px"), cx, cy, radius).select("hole_id", "reasons", "is_complete"))
        rejected = seen.where("NOT is_complete").select("hole_id", "reasons", F.lit(passes).alias("exclusion_iteration"))
        if rejected.isEmpty():
            break
        out.append(rejected)
        active = checkpointed(active.join(seen.where("is_complete").select("hole_id"), "hole_id", "left_semi"))
    kept = active.select("hole_id", (F.row_number().over(Window.orderBy("hole_id")) - 1).alias("new_hole_id"), F.lit("kept").alias("status"), F.lit("").alias("reasons"), F.lit(None).cast("int").alias("exclusion_iteration"))
    for r in out:
        kept = kept.unionByName(r.withColumn("status", F.lit("excluded")), allowMissingColumns=True)
    return kept


def chosen(holes: DataFrame, relations: DataFrame, tiers: tuple[int, ...] = (1, 2, 3), inside_only: bool = True) -> DataFrame:
    """Holes of the given tiers that don't leave the circle where their relation is known; if none is left, all of those tiers, flagged.

    `holes` has a tier, `relations` (hole_id, relation) may lack holes.
    """
    known = holes.where(F.col("tier").isin(*tiers)).join(relations.select("hole_id", "relation"), "hole_id", "left")
    fits = ~F.coalesce(F.col("relation").isin("intersects", "outside"), F.lit(False)) if inside_only else F.lit(True)
    any_left = known.agg(F.coalesce(F.max(fits), F.lit(False)).alias("_any"))
    return known.crossJoin(F.broadcast(any_left)).where(fits | ~F.col("_any")).withColumn("fallback", ~F.col("_any")).drop("_any")


def variants(holes: DataFrame, share: float = 0.05) -> DataFrame:
    """Each hole twice, its radii less and more by a share of the outer one, at least 1 px."""
    return holes.withColumn("variant", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumns(
        {r: F.greatest(F.col(r) + F.col("variant") * (F.col("radius_outer_px") * share), F.lit(1.0)) for r in ("radius_inner_px", "radius_outer_px")}
    )


def scaled(holes: DataFrame, factor: float) -> DataFrame:
    """Both radii multiplied, 1 px at least."""
    return holes.withColumns({r: F.greatest(F.col(r) * factor, F.lit(1.0)) for r in ("radius_inner_px", "radius_outer_px")})


def assigned(points: DataFrame, basis: DataFrame) -> DataFrame:
    """Lattice place of each point under the basis of `least_squares` (one row): the inverse of its vectors, rounded half to even; null without a basis."""
    det = F.col("a_x") * F.col("b_y") - F.col("a_y") * F.col("b_x")
    dx, dy = F.col("x") - F.col("origin_x"), F.col("y") - F.col("origin_y")
    u, v = F.try_divide(dx * F.col("b_y") - dy * F.col("b_x"), det), F.try_divide(dy * F.col("a_x") - dx * F.col("a_y"), det)
    placed = points.crossJoin(F.broadcast(basis.drop("n_holes"))).withColumns({"assigned_u": F.rint(F.round(u, 6)).cast("int"), "assigned_v": F.rint(F.round(v, 6)).cast("int")})
    return placed.drop(*[f"{a}_{z}" for a in ("origin", "a", "b") for z in "xy"])
