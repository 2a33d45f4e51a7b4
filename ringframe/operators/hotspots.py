"""Hotspots: statistics by hole, comparison with zones and profiles, tracks, nearest holes, linking between frames."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import proximity, settled
from ringframe.operators.reshape import ordered_places
from ringframe.sources.scratch import Scratch, checkpointed


# Pairs of rows of consecutive frames (or of one hole there) are met at once while they are so many, near or not.
PAIRS_AT_ONCE = 20_000_000


def stats(rows: DataFrame) -> DataFrame:
    """Per hole: hotspots (with or without distance), mean and least distance; null and negative holes don't count."""
    return rows.where("nearest_hole_id >= 0").groupBy(F.col("nearest_hole_id").alias("hole_id")).agg(
        F.count(F.lit(1)).alias("n_hotspots"), F.avg("dist_to_hole_px").alias("mean_hotspot_distance_px"), F.min("dist_to_hole_px").alias("min_hotspot_distance_px")
    )


def compare(holes: DataFrame, hotspots: DataFrame, zone_of: DataFrame) -> DataFrame:
    """Hole rows with their hotspot statistics (none: 0), zone (unknown if missing) and proximity bucket. Hotspots are aggregated before the join."""
    joined = holes.join(stats(hotspots), "hole_id", "left").join(zone_of, "hole_id", "left")
    return (
        joined.withColumn("n_hotspots", F.coalesce("n_hotspots", F.lit(0).cast("long")))
        .withColumn("reticulum_zone", F.coalesce("reticulum_zone", F.lit("unknown")))
        .withColumn("hotspot_proximity_bucket", proximity(F.col("min_hotspot_distance_px")))
    )


def compare_groups(rows: DataFrame, measures: list[str], keys: tuple[str, ...] = ("reticulum_zone", "hotspot_proximity_bucket")) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_holes"), F.avg("n_hotspots").alias("mean_n_hotspots"), F.avg("mean_hotspot_distance_px").alias("mean_distance"),
        *[F.avg(m).alias(f"group_{m}") for m in measures],
    )


def tracks(rows: DataFrame) -> DataFrame:
    """Per track: first and last frame, duration with both, means, and the most common hole, the one seen first among equals.

    Two aggregates: per (track, hole) counts first, so no track's rows are collected.
    """
    per = rows.groupBy("track_id", "nearest_hole_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("frame_id", "hotspot_id")).alias("seen"), F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1"),
        F.sum(F.round(F.col("area_px") * 100).cast("bigint")).alias("area"), F.sum(F.round(F.col("score") * 100).cast("bigint")).alias("score"), F.sum(F.round(F.col("dist_to_hole_px") * 100).cast("bigint")).alias("dist"),
    )
    return per.groupBy("track_id").agg(
        F.min("f0").alias("first_frame"),
        F.max("f1").alias("last_frame"),
        (F.max("f1") - F.min("f0") + 1).alias("duration_frames"),
        *[(F.sum(c).cast("double") / (100 * F.sum("n")).cast("double")).alias(f"mean_{c}") for c in ("area", "score", "dist")],
        F.min_by("nearest_hole_id", F.struct((-F.col("n")).alias("n"), "seen")).alias("most_common_hole"),
    )


def nearest_hole(points: DataFrame, holes: DataFrame, least: float = 16.0) -> DataFrame:
    """Each point's nearest hole, the least id among equals; null for points without a place, and for all where there are no holes.

    Points are numbered and go through grids of cells of `least`, twice that and so on: a point leaves at the first grid where
    one of the nine cells around it has a hole. That hole is at most 2.83 cells away, so the nearest one lies in the nine
    cells of the grid two levels up, which is an equi-join. Only points that found none go on to the next grid.
    """
    offsets = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
    kept = checkpointed(points.withColumn("_point", F.monotonically_increasing_id()))
    placed = checkpointed(holes.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("hole_id").alias("_hole"), F.col("x").alias("_x"), F.col("y").alias("_y")))

    def cells(df: DataFrame, x: str, y: str, level: int) -> DataFrame:
        size = least * 2.0**level
        return df.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})

    def around(level: int) -> DataFrame:
        near = cells(placed, "_x", "_y", level).withColumn("_o", F.explode(offsets))
        return near.select("_hole", "_x", "_y", (F.col("_cx") + F.col("_o.u")).alias("_cx"), (F.col("_cy") + F.col("_o.v")).alias("_cy"))

    left, level, found = kept.where("x IS NOT NULL AND y IS NOT NULL").select("_point", "x", "y"), 0, []
    while not placed.isEmpty() and not left.isEmpty():
        asked = cells(left, "x", "y", level)
        known = around(level).select("_cx", "_cy").distinct()
        here = asked.join(known, ["_cx", "_cy"], "left_semi").select("_point", "x", "y")
        met = cells(here, "x", "y", level + 2).join(around(level + 2), ["_cx", "_cy"])
        best = F.min(F.struct(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"), F.col("_hole").alias("h")))
        found.append(checkpointed(met.groupBy("_point").agg(best.alias("_best"))))
        left, level = checkpointed(asked.join(known, ["_cx", "_cy"], "left_anti").select("_point", "x", "y")), level + 1
    if not found:
        return kept.select(*points.columns, F.lit(None).cast(holes.schema["hole_id"].dataType).alias("nearest_hole_id"), F.lit(None).cast("double").alias("dist_to_hole_px"))
    joined = kept.join(functools.reduce(DataFrame.unionByName, found), "_point", "left")
    return joined.select(*points.columns, F.col("_best.h").alias("nearest_hole_id"), F.col("_best.d").alias("dist_to_hole_px"))


def link_nearest(rows: DataFrame, reach: float) -> DataFrame:
    """Each region's nearest one of the frame before, closer than `reach`, the least id among equals; several may share one. Equal rows are one.

    Places are met, not regions: the least id stands for all regions of a place. Where too many places share cells as wide as
    `reach`, they meet in narrower ones first: what lies outside the nine cells around a place is farther away than a cell
    is wide, so a place that has found one within that is done, and only the others go on to cells twice as wide.
    """
    place, offsets = ["frame_id", "x", "y"], F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
    cells = lambda df, x, y, span: df.withColumns({"_cx": F.floor(F.col(x) / span), "_cy": F.floor(F.col(y) / span)})
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    distance = F.sqrt(dx * dx + dy * dy)
    with Scratch(rows.sparkSession) as kept:
        placed = rows.where("x IS NOT NULL AND y IS NOT NULL")
        old = kept.keep("old", placed.groupBy((F.col("frame_id") + 1).alias("frame_id"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("region_id").alias("_prev")))
        left = kept.keep("left", placed.select(*place).distinct())

        def meetings(span: float) -> float:
            sides = [cells(df, x, y, span).groupBy("frame_id", "_cx", "_cy").agg(F.count(F.lit(1)).cast("double").alias(n)) for df, x, y, n in ((old, "_x", "_y", "_a"), (left, "x", "y", "_b"))]
            return sides[0].join(sides[1], ["frame_id", "_cx", "_cy"]).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0.0

        span, most, found = reach, max(PAIRS_AT_ONCE / 8, 4 * left.count()), []
        while span > reach * 1e-6 and meetings(span) > most:
            span /= 4
        while True:
            around = cells(old, "_x", "_y", span).withColumn("_o", F.explode(offsets)).withColumns({"_cx": F.col("_cx") + F.col("_o.u"), "_cy": F.col("_cy") + F.col("_o.v")}).drop("_o")
            met = cells(left, "x", "y", span).join(around.hint("merge"), ["frame_id", "_cx", "_cy"]).where(distance < reach)
            best = met.groupBy(*place).agg(F.min(F.struct(distance.alias("d"), F.col("_prev").alias("p"))).alias("_b"))
            if span >= reach:
                found.append(kept.keep("rest", best))
                break
            found.append(kept.keep(f"within_{span}", best.where(F.col("_b.d") <= span)))
            left, span = kept.keep("left", left.join(found[-1], place, "left_anti")), min(2 * span, reach)
        joined = rows.distinct().join(functools.reduce(DataFrame.unionByName, found), place, "left")
        return checkpointed(joined.select(*rows.columns, F.col("_b.p").alias("prev_region_id"), F.col("_b.d").alias("distance")))


def frame_reach(holes: DataFrame, most: float = 18.0, least: float = 6.0, share: float = 0.75) -> DataFrame:
    """How far a hotspot may move into each frame: `share` of the mean outer radius of its holes, between `least` and `most`."""
    return holes.groupBy("frame_id").agg(F.greatest(F.lit(least), F.least(F.lit(most), share * F.avg("radius_outer_px"))).alias("reach"))


# Width of the first band of costs.
BAND = 0.25
# Bands end where costs are this large.
LARGEST_COST = 1e9


def link_candidates(old: DataFrame, new: DataFrame, reach: float, max_ratio: float, keys: list[str], least: float = 0.0, width: float | None = None) -> DataFrame:
    """Pairs of hotspots that may be linked, with their cost: distance + 0.5 area ratio + 0.25 score difference (null without a score).

    Pairs farther than `reach` (or than _reach of the later one), beyond `max_ratio` in area (areas count 1 at least) or of different
    `keys` are out. With `width` only those that cost less than `least` + `width` are found; as none costs less than `least` by
    its areas, they are near in place and score. Each row of `old` (its columns begin with _) is dealt to the cells that it may
    reach, one to eight, which makes an equi-join.
    """
    spans = {"x": reach, "y": reach} if width is None else {"x": min(reach, width + 1e-6), "y": min(reach, width + 1e-6), "score": 4 * width + 1e-6}
    cell = lambda value, span: F.floor(value / (2 * span))
    for c, span in spans.items():
        old = old.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"_{c}") - span, span), cell(F.col(f"_{c}") + span, span))))
        new = new.withColumn(f"_c{c}", cell(F.col(c), span))
    met = new.join(old.hint("merge"), [*keys, *[f"_c{c}" for c in spans]])  # what is dealt to cells is more than its table's size tells
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    distance = F.sqrt(dx * dx + dy * dy)
    ratio = F.greatest("area_px", "_area_px") / F.greatest(F.least("area_px", "_area_px"), F.lit(1.0))
    near = met.where((distance <= F.least(F.lit(reach), F.coalesce("_reach", F.lit(reach)))) & (ratio <= max_ratio))
    cost = settled(distance + 0.5 * ratio + 0.25 * F.abs(F.col("score") - F.col("_score")))
    pairs = near.select("frame_id", F.col("_hotspot_id").alias("prev_hotspot_id"), "hotspot_id", cost.alias("cost"))
    return pairs if width is None else pairs.where(F.col("cost") < least + width)


def without(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs neither end of which is taken."""
    for c in ("prev_hotspot_id", "hotspot_id"):
        pairs = pairs.join(taken.select("frame_id", c), ["frame_id", c], "left_anti")
    return pairs


def matched(pairs: DataFrame, kept: Scratch) -> DataFrame:
    """One-to-one pairs (frame_id, prev_hotspot_id, hotspot_id, cost): those that a walk by ascending cost (null last), then ids, would take.

    Rounds instead of a walk: a pair that is the least of both its ends is taken and all pairs of these ends go, until none
    is left. The order is total, so the result is the walk's; most pairs go in the first rounds. The least pairs of ends are
    combined within tasks before they are shuffled.
    """
    rank = F.struct(F.coalesce("cost", F.lit(float("inf"))).alias("c"), F.col("prev_hotspot_id").alias("p"), F.col("hotspot_id").alias("h"), "cost")
    left, taken = kept.keep("pairs", pairs), []
    while not left.isEmpty():
        least = {c: left.groupBy("frame_id", c).agg(F.min(rank).alias("_r")) for c in ("prev_hotspot_id", "hotspot_id")}
        old = least["prev_hotspot_id"].select("frame_id", "prev_hotspot_id", F.col("_r.h").alias("hotspot_id"), F.col("_r.cost").alias("cost"))
        new = least["hotspot_id"].select("frame_id", "hotspot_id", F.col("_r.p").alias("prev_hotspot_id"))
        taken.append(kept.keep(f"round_{len(taken)}", old.join(new, ["frame_id", "prev_hotspot_id", "hotspot_id"]).select(*pairs.columns)))
        left = kept.keep("pairs", without(left, taken[-1]))
    return functools.reduce(DataFrame.unionByName, taken, pairs.limit(0))


def link_greedy(rows: DataFrame, reach: float = 10.0, max_ratio: float = 3.0, reaches: DataFrame | None = None) -> DataFrame:
    """One-to-one links between consecutive frames by ascending cost (see link_candidates, matched).

    Hotspots of two different holes are never linked; one without a hole may link to any. Where frames have too many pairs to
    meet at once, they meet by bands of cost, each twice as wide as the one before: a band's pairs count only if the bands
    before it left both ends free, so the links are the same, and few hotspots are left when the bands get wide.
    """
    number = {c: F.col(c).cast("double") for c in ("x", "y", "area_px")} | {"score": F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))}
    spots = rows.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("frame_id").cast("int").alias("frame_id"), "hotspot_id", F.col("nearest_hole_id").alias("hole"), *[v.alias(c) for c, v in number.items()])
    with Scratch(rows.sparkSession) as kept:
        spots = kept.keep("spots", spots)
        old = spots.select((F.col("frame_id") + 1).cast("int").alias("frame_id"), "hole", *[F.col(c).alias(f"_{c}") for c in ("hotspot_id", *number)])
        new = spots.withColumn("_reach", F.lit(None).cast("double")) if reaches is None else spots.join(reaches.select("frame_id", F.col("reach").cast("double").alias("_reach")), "frame_id", "left")
        free = {"old": old.where("hole IS NOT NULL"), "old none": old.where("hole IS NULL").drop("hole"), "new": new.where("hole IS NOT NULL"), "new none": new.where("hole IS NULL").drop("hole")}

        def meetings(a: str, b: str, *keys: str) -> float:
            n = [free[side].groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name)) for side, name in ((a, "_a"), (b, "_b"))]
            return n[0].join(n[1], [*keys]).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0.0

        def of_one_hole(*costs) -> DataFrame:
            return link_candidates(free["old"], free["new"], reach, max_ratio, ["frame_id", "hole"], *costs)

        def of_any_hole(*costs) -> DataFrame:
            """Pairs of which one has no hole; that one is dealt to cells, on whichever side it is."""
            names = {c: f"_{c}" for c in ("hotspot_id", *number)}
            turned = free["new none"].withColumnsRenamed(names), free["old"].drop("hole").withColumnsRenamed({v: k for k, v in names.items()})
            met = [(free["old none"], free["new"].drop("hole")), (free["old none"], free["new none"]), turned]
            first, second, third = (link_candidates(*sides, reach, max_ratio, ["frame_id"], *costs) for sides in met)
            return first.unionByName(second).unionByName(third.select("frame_id", F.col("hotspot_id").alias("prev_hotspot_id"), F.col("prev_hotspot_id").alias("hotspot_id"), "cost"))

        area, low, high = spots.agg(F.min("area_px"), F.min("score"), F.max("score")).first()
        least = 0.5 * min(area, 1.0) if area is not None and area == area else 0.5
        most = min(reach + 0.5 * max_ratio + 0.25 * ((high or 0.0) - (low or 0.0)), LARGEST_COST)
        width, links, own = BAND, [], None
        while True:
            if own is None and meetings("old", "new", "frame_id", "hole") <= PAIRS_AT_ONCE:
                own = kept.keep("own", of_one_hole())
            few = own is not None and sum(meetings(*sides, "frame_id") for sides in (("old none", "new"), ("old none", "new none"), ("old", "new none"))) <= PAIRS_AT_ONCE
            last = few or least + width > most
            costs = () if last else (least, width)
            mine = of_one_hole(*costs) if own is None else own if last else own.where(F.col("cost") < least + width)
            links.append(kept.keep(f"links_{len(links)}", matched(mine.unionByName(of_any_hole(*costs)), kept)))
            if last:
                return checkpointed(functools.reduce(DataFrame.unionByName, links))
            for side, df in free.items():
                end, name = ("_hotspot_id", "prev_hotspot_id") if side.startswith("old") else ("hotspot_id", "hotspot_id")
                free[side] = kept.keep(side.replace(" ", "_"), df.join(links[-1].select("frame_id", F.col(name).alias(end)), ["frame_id", end], "left_anti"))
            own = own if own is None else kept.keep("own", without(own, links[-1]))
            width *= 2


def track_ids(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Each hotspot (frame_id, hotspot_id) with its track: a chain of links. Tracks are numbered from 0 by (frame, hotspot) of their first one.

    Chains are followed by doubling: each hotspot points to one before it and takes over that one's pointer, so a chain of n
    takes log2(n) joins. First ones are numbered by ranges.
    """
    with Scratch(rows.sparkSession) as kept:
        before = links.select("frame_id", "hotspot_id", F.col("prev_hotspot_id").alias("_to_hotspot"), (F.col("frame_id") - 1).alias("_to_frame"))
        at = rows.select(F.col("frame_id").cast("int").alias("frame_id"), "hotspot_id").join(before, ["frame_id", "hotspot_id"], "left")
        moving = F.col("_to_frame") != F.col("frame_id")
        at = at.withColumns({"_to_frame": F.coalesce("_to_frame", "frame_id"), "_to_hotspot": F.coalesce("_to_hotspot", "hotspot_id")})
        at = kept.keep("at", at.withColumn("_end", ~moving))
        while at.where("NOT _end").limit(1).count():
            ahead = at.select(F.col("frame_id").alias("_to_frame"), F.col("hotspot_id").alias("_to_hotspot"), F.col("_to_frame").alias("_f"), F.col("_to_hotspot").alias("_h"), F.col("_end").alias("_e"))
            open_ = at.where("NOT _end").join(ahead, ["_to_frame", "_to_hotspot"])
            stays = (F.col("_f") == F.col("_to_frame")) & (F.col("_h") == F.col("_to_hotspot"))
            moved = open_.select("frame_id", "hotspot_id", F.col("_f").alias("_to_frame"), F.col("_h").alias("_to_hotspot"), (stays | F.col("_e")).alias("_end"))
            at = kept.keep("at", at.where("_end").unionByName(moved))
        heads = at.where((F.col("_to_frame") == F.col("frame_id")) & (F.col("_to_hotspot") == F.col("hotspot_id"))).select("_to_frame", "_to_hotspot")
        numbers = ordered_places(heads, ["_to_frame", "_to_hotspot"], "track_id")
        return checkpointed(at.join(numbers, ["_to_frame", "_to_hotspot"]).select("frame_id", "hotspot_id", "track_id"))


def per_frame(rows: DataFrame) -> DataFrame:
    order = Window.orderBy("frame_id")
    return rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_hotspots")).withColumn("n_before", F.lag("n_hotspots").over(order))
