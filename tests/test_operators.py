"""Operators on small literal rows: ties, gaps, nulls, single frames, empty tables, and values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringframe.functions.expressions import finite, parabola, smoothed
from ringframe.operators import activity, clusters, events, frames, gates, hotspots, lattice, pixels, radial, rdf, resample, reshape, sectors
from ringframe.sources import tables
from ringframe.streaming import stateful

RADIAL = "hole_id int, frame_id int, annulus_id int, descriptor_value double, lattice_u int, lattice_v int"


@pytest.fixture(scope="module")
def small(spark):
    """Two holes, two frames, two annuli, out of order, and a hole whose baseline is missing."""
    rows = [(2, 1, 1, 0.6, 1, 0), (1, 0, 0, 0.2, 0, 0), (1, 1, 0, 0.5, 0, 0), (1, 0, 1, 0.3, 0, 0), (1, 1, 1, 0.4, 0, 0), (2, 0, 0, 0.1, 1, 0), (2, 1, 0, 0.1, 1, 0), (2, 0, 1, 0.6, 1, 0), (3, 0, 0, None, 2, 0), (3, 1, 0, 0.9, 2, 0)]
    return spark.createDataFrame(rows, RADIAL)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_evolution(small):
    evo = rdf.evolution(small)
    rows = by(evo, "hole_id", "frame_id", "annulus_id")
    assert rows[1, 1, 0]["rdf_pdf"] == pytest.approx(0.75) and rows[1, 1, 1]["rdf_cdf"] == pytest.approx(1.0)
    assert rows[3, 1, 0]["delta_descriptor_value"] is None and rows[3, 1, 0]["rdf_cdf"] == 0.0
    got = by(rdf.frame_summary(evo), "hole_id", "frame_id")
    assert got[1, 1]["rdf_front_radius_norm"] == pytest.approx(0.25) and got[1, 1]["rdf_peak_annulus"] == 0
    assert got[2, 1]["rdf_front_radius_norm"] is None and got[1, 0]["rdf_total_positive_delta"] == 0.0
    speed = by(rdf.front_velocity(rdf.frame_summary(evo)), "hole_id")
    assert set(speed) == {(1,)} and speed[1,]["rdf_front_velocity_per_frame"] == 0.0 and speed[1,]["rdf_front_velocity_r2"] == 1.0
    for total, steps in evo.groupBy("hole_id", "frame_id").agg(F.sum("rdf_pdf").alias("s"), F.max("total").alias("t")).select("s", "t").collect():
        assert total is None or total == pytest.approx(1.0) and steps > 0


def test_empty(spark):
    none = spark.createDataFrame([], RADIAL)
    assert rdf.front_dynamics(rdf.frame_summary(rdf.evolution(none))).count() == 0
    assert radial.model_fits(none).count() == 0 and radial.zones(none).count() == 0
    sector = none.withColumn("sector_id", F.lit(0))
    assert sectors.acceleration(sectors.frames(rdf.evolution(sector, True))).count() == 0
    assert events.curve_events(none.withColumnRenamed("descriptor_value", "value"), ["hole_id"]).count() == 0
    assert resample.bootstrap(rdf.frame_summary(rdf.evolution(none))).count() == 0


def test_profile_ties(spark):
    rows = spark.createDataFrame([(1, 0, a, v, 0, 0) for a, v in ((0, 0.5), (1, 0.9), (2, 0.9), (3, None))], RADIAL)
    (r,) = radial.frame_profile(rows, ["hole_id", "frame_id"]).collect()
    assert r["peak_annulus"] == 1 and r["n_valid_annuli"] == 3 and r["inner_minus_outer"] == pytest.approx(-0.4)
    w = np.array([1e-6, 0.4 + 1e-6, 0.4 + 1e-6])
    assert r["center_of_mass_annulus"] == pytest.approx((w * [0, 1, 2]).sum() / w.sum())


def test_parabola_matches_polyfit(spark):
    rng = np.random.default_rng(0)
    x, y = np.arange(100, 120), rng.normal(size=20)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1, 1.0), (2, 2, 2.0), (2, 2, 3.0)], "k int, x int, y double")
    (r,) = parabola(df, ["k"], "x", "y").collect()
    assert [r["a"], r["b"], r["c"]] == pytest.approx(np.polyfit(x, y, 2).tolist(), rel=1e-6)


def test_smoothing_and_events(spark):
    values = [1.0, 1.0, 1.1, 0.9, 1.0, 3.0, 5.0, 9.0, 9.0, 5.0, 2.0, 1.0]
    df = spark.createDataFrame([("a", i * 2, v) for i, v in enumerate(values)] + [("b", 0, 1.0), ("b", 1, 5.0)], "entity_id string, frame_id int, value double")
    got = [r["s"] for r in df.where("entity_id = 'a'").withColumn("s", smoothed("value", ["entity_id"], "frame_id")).orderBy("frame_id").collect()]
    padded = np.pad(values, 1, mode="edge")
    assert got == pytest.approx(np.convolve(padded, np.ones(3) / 3, mode="valid").tolist())
    found = by(events.curve_events(df, ["entity_id"]), "entity_id")
    assert found["a",]["onset_pos"] == 3 and found["a",]["peak_pos"] == 7 and found["a",]["peak_frame_id"] == 14
    assert found["b",]["peak_pos"] == 1


def test_hotspots(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 30.0), (None, 3.0), (-1, 1.0), (1, None)], "nearest_hole_id int, dist_to_hole_px double")
    got = by(hotspots.stats(rows), "hole_id")
    assert got[1,]["n_hotspots"] == 3 and got[1,]["mean_hotspot_distance_px"] == 6.0 and set(got) == {(1,), (2,)}
    holes = spark.createDataFrame([(1,), (2,), (3,)], "hole_id int")
    zone = spark.createDataFrame([(1, "edge")], "hole_id int, reticulum_zone string")
    got = by(hotspots.compare(holes, rows, zone), "hole_id")
    assert [got[h,]["hotspot_proximity_bucket"] for h in (1, 2, 3)] == ["near", "far", "none"] and got[2,]["reticulum_zone"] == "unknown"


def test_greedy_links(spark):
    rows = [(1, 0, 10, 0.0, 0.0, 20.0, 1.0), (1, 0, 11, 6.0, 0.0, 20.0, 1.0), (1, 1, 20, 5.0, 0.0, 20.0, 1.0), (1, 1, 21, 1.0, 0.0, 20.0, 1.0), (1, 1, 22, 90.0, 0.0, 20.0, 1.0), (2, 1, 23, 0.0, 0.0, 20.0, 1.0)]
    df = spark.createDataFrame(rows, "nearest_hole_id int, frame_id int, hotspot_id long, x double, y double, area_px double, score double")
    assert sorted((r[1], r[2]) for r in hotspots.link_greedy(df).collect()) == [(10, 21), (11, 20)]


def test_lattice(spark):
    holes = spark.createDataFrame([(h, h % 3, h // 3, 10.0 + 40 * (h % 3), 20.0 + 40 * (h // 3), 10.0) for h in range(9)], "hole_id int, lattice_u int, lattice_v int, x double, y double, radius_outer_px double")
    (fit,) = lattice.least_squares(holes).collect()
    assert [round(fit[c], 9) for c in ("origin_x", "origin_y", "a_x", "a_y", "b_x", "b_y")] == [10, 20, 40, 0, 0, 40]
    plan = by(lattice.terrace_plan(holes), "hole_id")
    assert plan[4,]["gap_px"] == 20.0 and plan[4,]["terrace_width_px"] == 1.25 and plan[4,]["terrace_outer_radius_px"] == 20.0
    labelled = holes.withColumn("label", F.when(F.col("lattice_u") == 0, "a").otherwise("b"))
    assert lattice.neighbour_pairs(labelled).count() == 12
    assert by(radial.zones(holes), "hole_id")[4,]["reticulum_zone"] == "interior"
    got = by(lattice.relation(holes, 50.0, 60.0, 30.0), "hole_id")
    assert got[4,]["relation"] == "inside" and got[0,]["relation"] == "outside" and got[1,]["relation"] == "outside"


def test_kmeans(spark):
    rows = spark.createDataFrame([(i, float(i // 5), None if i == 3 else 1.0) for i in range(15)], "hole_id int, a double, b double")
    got = by(clusters.kmeans(rows, ["a", "b"], 3), "hole_id")
    assert [got[i,]["cluster_id"] for i in range(15)] == [0] * 5 + [1] * 5 + [2] * 5


def test_activity(spark):
    rows = [(f, h, t, s, c, n) for f in range(5) for h in range(2) for t in range(3) for s in range(2) for c, n in ((2, 70 - 10 * (f > 2 and t > 0)), (5, 30 + 10 * (f > 2 and t > 0)))]
    tensor = spark.createDataFrame(rows, "frame_id int, hole_id int, terrace_index int, sector_id int, cluster_id int, pixel_count long")
    act = by(activity.activity(tensor, ["terrace_index"]), "frame_id", "terrace_index", "cluster_id")
    assert act[4, 1, 5]["active_fraction"] == pytest.approx(0.1) and act[4, 0, 5]["active_fraction"] == 0.0
    front = by(activity.activity_front(activity.activity(tensor, ["terrace_index"])), "frame_id", "cluster_id")
    assert front[4, 5]["front_terrace"] == pytest.approx(1.5) and front[0, 5]["front_terrace"] is None
    assert min(r["js_similarity"] for r in activity.js_similarity(tensor).collect()) == pytest.approx(1.0)


def test_gates_and_reshape(spark, small):
    result = gates.gates(small, {"rows": F.count(F.lit(1)) > 5, "never": F.lit(False) & (F.count(F.lit(1)) > 0)})
    with pytest.raises(ValueError, match="never"):
        gates.require(result)
    assert reshape.trajectories(small.where("annulus_id = 0"), "hole_id", "descriptor_value").count() == 3


def test_finite(spark):
    df = finite(spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5), (4, None)], "k int, v double"))
    assert [r["v"] for r in df.orderBy("k").collect()] == [None, None, 1.5, None]


def test_csv_and_optional(spark, tmp_path):
    (tmp_path / "t.csv").write_text("hole_id,x,confidence\n1,2.5,nan\n2,,oops\n")
    got = tables.read_csv(spark, str(tmp_path / "t.csv"), tables.HOLES).orderBy("hole_id").collect()
    assert [(r["hole_id"], r["x"], r["confidence"], r["radius_inner_px"]) for r in got] == [(1, 2.5, None, None), (2, None, None, None)]
    assert tables.read_optional(spark, str(tmp_path / "missing.parquet"), tables.RADIAL).count() == 0
    tables.write(spark.range(3), str(tmp_path / "out"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_pixels(spark):
    image = np.zeros((8, 6, 3), np.uint8)
    image[2:6] = (200, 100, 50)
    frame = spark.createDataFrame([(0, 0.0, 8, 6, 3, bytes(image.tobytes()))], tables.FRAME)
    px = tables.frame_pixels(frame)
    assert px.count() == 48
    (r,) = pixels.black_rows(px).collect()
    assert (r["top_black_rows"], r["bottom_black_rows"]) == (2, 2)
    hole = spark.createDataFrame([(1, 3.0, 4.0, 1.0)], "hole_id int, x double, y double, radius_outer_px double")
    assert pixels.outside_holes(px, hole).count() == 43
    ring = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], "hole_id int, annulus_id int, r_inner_px double, r_outer_px double")
    got = {k[0]: v["n"] for k, v in by(pixels.terraces(px, ring, hole, 2.0).groupBy("annulus_id").agg(F.count(F.lit(1)).alias("n")), "annulus_id").items()}
    assert got == {0: 1, 1: 8}
    assert pixels.sampled(px, 5).count() == 5
    (iou,) = pixels.overlap(px.where("y < 4"), px.where("y < 2")).collect()
    assert iou["iou"] == 0.5 and iou["overlap_fraction"] == 1.0
    (g,) = pixels.grey_world(px.where("r = 200")).select("r", "g", "b").distinct().collect()
    assert max(abs(v - 350 / 3) for v in g) <= 1
    stats = frames.region_stats(px, ["frame_id"]).first()
    assert stats["mean_R"] == 100.0 and math.isclose(stats["mean_H"], (1 / 18) / 2, rel_tol=1e-6)


def test_streams(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    out = stateful.tumbling(stateful.read_events(spark, f"{tmp_path}/events", 3), late="60 days")
    query = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0]
    assert spark.table("tumbled").count() == batch.count()
