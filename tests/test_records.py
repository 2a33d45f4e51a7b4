"""Checks, summaries, widths, containment, run activity, smoothing, raw frames and JSON on literal rows; plans of the heavy queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringframe.operators import activity, clusters, frames, gates, hotspots, lattice, pixels, rdf, resample, reshape
from ringframe.plans import queries
from ringframe.sources import tables

BASIS = "confidence double, spacing_u_px double, spacing_v_px double, a_x double, a_y double"


def test_geometry_checks(spark):
    holes = spark.createDataFrame([(i, 40.0 * (i % 4) + 20, 40.0 * (i // 4) + 20) for i in range(12)], "hole_id int, x double, y double")
    basis = spark.createDataFrame([(0.7, 40.0, 41.0, 3.0, 4.0)], BASIS)

    def told(*args, **kwargs):
        rows = gates.geometry_checks(*args, **kwargs)
        return {r["name"]: (r.passed, r.severity, r.value) for r in rows.collect()}, gates.verdict(rows).collect()[0].asDict()

    checks, verdict = told(holes, basis, 200, 200, 8.0)
    assert len(checks) == 7 and checks["lattice_confidence"] == (True, "fail", 0.7)  # 0.65 is enough for a full frame of 12 holes
    assert checks["support_is_object_specific"] == (False, "warn", 1.0) and checks["radius_spacing_ratio"] == (True, "warn", 0.2)
    assert verdict == {"passed": True, "status": "warn", "fail_count": 0, "warning_count": 1}
    half = spark.createDataFrame([(y, x) for y in range(100) for x in range(50)], "y int, x int")
    checks, verdict = told(holes.limit(3), basis, 200, 200, 8.0, half, (30.0, 30.0, 60.0))
    assert checks["minimum_hole_count"] == (False, "fail", 3.0) and checks["lattice_confidence"][0] is False and checks["support_is_object_specific"] == (True, "warn", 0.125)
    assert len(checks) == 9 and checks["hole_centers_inside_support"][0] is (checks["hole_centers_inside_support"][2] == 0) and verdict["status"] == "fail"
    checks, verdict = told(holes.limit(0), basis.limit(0), 10, 10, 0.0, half.limit(0))
    assert checks["support_not_empty"] == (False, "fail", 0.0) and checks["radius_spacing_ratio"] == (False, "warn", None) and not verdict["passed"]
    crowded, _ = told(holes, basis, 20, 20, 8.0)
    assert crowded["physical_nonoverlap_hole_count"] == (False, "fail", 1.0)


def test_run_summary(spark):
    audit = spark.createDataFrame([(0, True), (1, False), (2, True)], "frame_id int, accepted boolean")
    checks = spark.createDataFrame([("a", False, "warn", 1.0)], "name string, passed boolean, severity string, value double")
    one = gates.run_summary(audit, spark.createDataFrame([("none",)], "method string"), spark.createDataFrame([(0.9, 5.0, 6.0, 3.0, 4.0)], BASIS), spark.createDataFrame([(2,)], "reference_frame_id int"), checks, {"n_events": audit.limit(0), "n_rows": audit})
    r = one.collect()[0].asDict()
    assert r.pop("angle_deg") == pytest.approx(53.130102354)
    assert r == {"n_frames": 3, "accepted_frames": 2, "rejected_frames": 1, "winner_correction": "none", "lattice_confidence": 0.9, "spacing_u_px": 5.0, "spacing_v_px": 6.0, "reference_frame_id": 2, "geometry_status": "warn", "n_events": 0, "n_rows": 3}


HOLES = "hole_id int, lattice_u int, lattice_v int, x double, y double, radius_outer_px double"


def test_terrace_widths(spark):
    holes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 5.0), (2, 1, 0, 40.0, 0.0, 5.0), (3, 0, 1, 0.0, 30.0, 5.0), (4, None, None, 100.0, 100.0, 4.0), (5, 5, 5, 112.0, 100.0, 10.0)], HOLES)

    def plan(**kwargs):
        return {r.hole_id: r for r in lattice.terrace_width_plan(holes, 4, **kwargs).collect()}

    half = plan(width_mode="half_gap")
    assert (half[1].min_border_gap_px, half[1].annulus_width_px, half[1].terrace_outer_radius_px, half[1].fallback_mode) == (20.0, 2.5, 15.0, "neighbors")
    assert half[1].neighbor_count == 2 and half[2].min_center_pitch_px == 40.0 and half[4].fallback_mode == "global_min_gap"
    assert half[4].min_border_gap_px == 20.0 and half[4].min_center_pitch_px == 12.0  # the close pair overlaps, so its gap doesn't count
    assert plan(width_mode="full_gap", gap_basis="center_pitch")[2].usable_annulus_span_px == 40.0
    fixed = plan(outer_radius=17.0)
    assert fixed[1].annulus_width_px == 3.0 and plan()[5].terrace_outer_radius_px == 35.0 and plan(min_width=9.0)[1].annulus_width_px == 9.0
    alone = lattice.terrace_width_plan(holes.limit(1), 4, "half_gap", outer_radius=25.0).collect()[0]
    assert (alone.fallback_mode, alone.usable_annulus_span_px, alone.min_center_pitch_px) == ("fixed_outer_radius", 20.0, None)
    with pytest.raises(ValueError):
        lattice.terrace_width_plan(holes, 4, "other")


@pytest.mark.parametrize("seed", range(3))
def test_nearest_pitch(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.uniform(0, 500, (60, 2)) if seed else np.zeros((20, 2))
    radii = rng.uniform(1, 40, len(points))
    rows = [(i, 0, 0, float(x), float(y), float(r)) for i, ((x, y), r) in enumerate(zip(points, radii, strict=True))]
    pairs = [(np.hypot(*(points[i] - points[j])), radii[i] + radii[j]) for i in range(len(points)) for j in range(i)]
    got = lattice.nearest_pitch(spark.createDataFrame(rows, HOLES)).collect()[0]
    gaps = [d - r for d, r in pairs if d - r > 0]
    assert got.min_center_px == pytest.approx(min(d for d, _ in pairs)) and got.min_gap_px == (pytest.approx(min(gaps)) if gaps else None)
    assert tuple(lattice.nearest_pitch(spark.createDataFrame([], HOLES)).collect()[0]) == (None, None)


def test_lattice_quality(spark):
    rows = [(i * 3 + j, i, j, 10.0 + 20 * i + 1 * j, 5.0 + 30 * j - 2 * i, 1.0) for i in range(3) for j in range(3)]
    exact = spark.createDataFrame(rows, HOLES)
    r = lattice.fit_quality(exact, lattice.least_squares(exact)).collect()[0]
    assert r.residual_px == pytest.approx(0, abs=1e-9) and r.confidence == pytest.approx(1) and r.spacing_u_px == pytest.approx(np.hypot(20, 2)) and r.spacing_v_px == pytest.approx(np.hypot(1, 30))
    off = exact.withColumn("x", F.col("x") + F.when(F.col("hole_id") == 4, 9.0).otherwise(0.0))
    r = lattice.fit_quality(off, lattice.least_squares(off)).collect()[0]
    assert 0 < r.residual_px < 9 and r.confidence == pytest.approx(1 / (1 + r.residual_px / min(r.spacing_u_px, r.spacing_v_px)))


def test_containment(spark):
    holes = spark.createDataFrame([(1, 10.0, 10.0, 2.0, 4.0), (2, 2.0, 10.0, 2.0, 4.0), (3, 10.0, 14.0, 2.0, 5.0), (4, 0.5, 0.5, 0.2, 0.3)], "hole_id int, x double, y double, radius_outer_px double, terrace_outer_radius_px double")
    mask = spark.createDataFrame([(y, x) for y in range(21) for x in range(21) if (y, x) != (18, 10)], "y int, x int")
    got = {r.hole_id: r.reasons for r in lattice.containment(holes, 21, 21, None, mask).collect()}
    assert got == {1: "", 2: "terrace_outside_frame;terrace_outside_wafer", 3: "terrace_outside_wafer", 4: "hole_outside_wafer;terrace_outside_wafer"}  # no place within 0.3 of (0.5, 0.5)
    got = {r.hole_id: r.reasons for r in lattice.containment(holes, 21, 21, (10.0, 10.0, 5.0), mask).collect()}
    assert got == {1: "", 2: "terrace_outside_frame;hole_outside_wafer;terrace_outside_wafer", 3: "hole_outside_wafer;terrace_outside_wafer", 4: "hole_outside_wafer;terrace_outside_wafer"}
    assert {r.reasons for r in lattice.containment(holes.where("hole_id <> 2"), 21, 21).collect()} == {""}


def test_containment_of_disks_outside_the_frame(spark):
    """They have their flags, however far off or large, and none of their places is laid out."""
    holes = spark.createDataFrame([(1, 10.0, 10.0, 2.0, 4.0), (2, 5000.0, 5000.0, 2.0, 4.0), (3, 10.0, 10.0, 1e6, 1e6), (4, 10.0, 10.0, 2.0, 11.0)], "hole_id int, x double, y double, radius_outer_px double, terrace_outer_radius_px double")
    mask = spark.createDataFrame([(y, x) for y in range(21) for x in range(21)], "y int, x int")
    out = "hole_outside_frame;terrace_outside_frame;hole_outside_wafer;terrace_outside_wafer"
    got = {r.hole_id: r.reasons for r in lattice.containment(holes, 21, 21, None, mask).collect()}
    assert got == {1: "", 2: out, 3: out, 4: "terrace_outside_frame;terrace_outside_wafer"}


def test_run_activity(spark):
    rows = [(0, 1, 60), (0, 2, 40), (1, 1, 50), (1, 2, 50), (2, 1, 10), (2, 3, 90)]
    got = {(r.frame_id, r.cluster_id): r for r in activity.run_activity(spark.createDataFrame(rows, "frame_id int, cluster_id int, pixel_count long"), 2).collect()}
    assert len(got) == 9 and got[2, 3].baseline_fraction == 0.0 and got[2, 3].normalized_active_fraction == 1.0 and got[2, 2].raw_fraction == 0.0
    assert got[0, 1].baseline_fraction == pytest.approx(0.55) and got[0, 1].normalized_active_fraction == pytest.approx(0.05 / 0.9)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 9])
def test_smoothing(spark, width):
    series = {"a": [1.0, 5.0, 2.0, 8.0, 3.0], "b": [4.0, 2.0], "c": [7.0]}
    rows = [(k, i, v) for k, own in series.items() for i, v in enumerate(own)]
    got = {}
    for r in reshape.smooth_values(spark.createDataFrame(rows, "k string, at int, v double"), ["k"], "at", "v", width).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.v)
    for k, own in series.items():
        pad = width // 2
        want = own if len(own) < 3 or width <= 1 else np.convolve(np.pad(own, pad, mode="edge"), np.ones(width) / width, "valid")
        assert got[k] == pytest.approx(list(want))


def test_bars_and_descriptors(spark):
    rows = spark.createDataFrame([(2, None), (1, 3.0), (3, 1.0)], "k int, v double")
    assert [tuple(r) for r in reshape.bars(rows, "k", "v", "k", 2).collect()] == [("1", 3.0), ("2", 0.0)]
    px = spark.createDataFrame([(0, 255, 0, 0), (0, 10, 10, 10)], "frame_id int, r int, g int, b int")
    assert [r.value for r in frames.descriptor(px, "r").collect()] == [1.0, 10 / 255] and [r.value for r in frames.descriptor(px, "s").collect()] == [1.0, 0.0]
    assert [r.hue for r in frames.masked_hue(px, 0.5).collect()] == [0.0, None]
    with pytest.raises(ValueError):
        frames.descriptor(px, "v")


def test_bulk_rows(spark):
    support = spark.createDataFrame([(f, y, x) for f in (1, 2) for y in range(10) for x in range(10)], "frame_id int, y int, x int")
    holes = spark.createDataFrame([(1, 5.0, 5.0, 2.0)], "hole_id int, x double, y double, radius_outer_px double")
    places, rows = pixels.bulk_rows(support, holes, 50)
    assert {tuple(r) for r in rows.collect()} == {(f, 100, 13, 87, 50, 0.87) for f in (1, 2)} and places.count() == 100
    _, rows = pixels.bulk_rows(support.where("y = 5 AND x = 5"), holes)
    assert {tuple(r) for r in rows.collect()} == {(f, 1, 1, 0, 0, 0.0) for f in (1, 2)}


def test_validation_summaries(spark):
    scored = spark.createDataFrame([(1, 0.8, 0.4, 0.2), (2, 0.6, None, float("nan"))], "hole_id int, support_fraction double, bootstrap_velocity_ci_width double, uncertainty_score double")
    v = spark.createDataFrame([(1, 0.75)], "hole_id int, valid_sector_velocity_fraction double")
    a = spark.createDataFrame([(1, 0.5)], "hole_id int, valid_sector_acceleration_fraction double")
    first, second = (df.collect()[0].asDict() for df in resample.validation_summaries(scored, v, a))
    assert first == {"mean_bootstrap_class_support": pytest.approx(0.7), "mean_velocity_ci_width": 0.4, "mean_sector_propagation_valid_fraction": 0.75, "validation_enabled": True}
    assert second == {"mean_uncertainty_score": 0.2, "mean_hotspot_linked_velocity_ci_width": 0.4, "mean_sector_acceleration_valid_fraction": 0.5, "validation_enabled": True}
    first, _ = resample.validation_summaries(scored.limit(0), v.limit(0), a, False)
    assert first.collect()[0].asDict() == {"mean_bootstrap_class_support": None, "mean_velocity_ci_width": None, "mean_sector_propagation_valid_fraction": None, "validation_enabled": False}


def test_frame_window():
    assert tables.frame_window(10) == (0, 9) and tables.frame_window(10, -3, 99) == (0, 9) and tables.frame_window(10, 5, 2) == (5, 5)
    assert tables.frame_window(0) == (0, None) and tables.frame_window(0, 2, 7) == (2, 7) and tables.frame_window(10, 3, 7) == (3, 7)


def test_frames_from_a_file(spark, tmp_path):
    rows = [(f, 0.0, 2, 3, 1, bytes([f] * 6)) for f in range(10)]
    spark.createDataFrame(rows, tables.FRAME).write.parquet(f"{tmp_path}/f")
    got = tables.read_frames(spark, f"{tmp_path}/f", 2, 99, 3, 2.0)
    assert sorted((r.frame_id, r.time_s) for r in got.collect()) == [(2, 1.0), (5, 2.5), (8, 4.0)]
    assert "PushedFilters: [" in (plan := got._jdf.queryExecution().toString()) and "GreaterThanOrEqual(frame_id,2)" in plan
    assert sorted(r.frame_id for r in tables.read_frames(spark, f"{tmp_path}/f", -5, 1, 0, 0.0).collect()) == [0, 1]
    assert tables.probe(got, 2.0).collect()[0].asDict() == {"n_frames": 3, "fps": 2.0, "width": 3, "height": 2, "channels": 1}
    assert tables.probe(got.limit(0)).collect()[0].asDict() == {"n_frames": 0, "fps": 1.0, "width": 0, "height": 0, "channels": 0}
    assert {(r.r, r.g, r.b) for r in tables.frame_pixels(got).collect()} == {(2, 2, 2), (5, 5, 5), (8, 8, 8)}


def test_numbers_become_8_bits(spark):
    whole = tables.rgb8(np.array([[0, 257, 65535]], np.uint16))
    assert whole.shape == (1, 3, 3) and whole[0, :, 0].tolist() == [0, 1, 255]
    assert tables.rgb8(np.array([[-32768, 0, 32767]], np.int16))[0, :, 0].tolist() == [0, 128, 255]
    assert tables.rgb8(np.array([[0.0, 0.5, 1.0, np.nan, np.inf, -np.inf]]))[0, :, 0].tolist() == [0, 128, 255, 0, 255, 0]
    assert tables.rgb8(np.array([[2.4, 300.0, -1.0]]))[0, :, 0].tolist() == [2, 255, 0] and tables.rgb8(np.array([[np.nan]]))[0, 0].tolist() == [0, 0, 0]
    assert tables.rgb8(np.zeros((1, 1, 4), np.uint8)).shape == (1, 1, 3)
    rows = [(1, 0.0, 1, 2, 1, np.array([514, 65535], "<u2").tobytes(), "uint16"), (2, 0.0, 1, 1, 3, bytes([1, 2, 3]), None)]
    got = tables.frame_pixels(spark.createDataFrame(rows, tables.FRAME + ", dtype STRING")).collect()
    assert sorted((r.frame_id, r.x, r.r, r.g, r.b) for r in got) == [(1, 0, 2, 2, 2), (1, 1, 255, 255, 255), (2, 0, 1, 2, 3)]


def test_json_round_trip(spark, tmp_path):
    schema = "hole_id int, centre struct<x: double, y: double>, notes array<string>, extra map<string, double>"
    rows = spark.createDataFrame([(1, (1.5, None), ["a", None], {"k": 2.0}), (2, None, None, None)], schema)
    tables.write_json(rows, f"{tmp_path}/m")
    assert sorted(map(str, tables.read_json(spark, f"{tmp_path}/m", schema).collect())) == sorted(map(str, rows.collect()))
    assert tables.read_json(spark, f"{tmp_path}/none", schema, default=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_json(spark, f"{tmp_path}/none", schema)


def test_nearest_holes_far_and_missing(spark):
    holes = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.0, 0.0), (3, 90.0, 0.0), (4, None, 1.0)], "hole_id int, x double, y double")
    points = spark.createDataFrame([(1, 3.0, 4.0), (1, 3.0, 4.0), (2, 1e6, 0.0), (3, None, 1.0), (4, 46.0, 0.0), (5, -5000.0, 7000.0)], "k int, x double, y double")
    got = sorted((r.k, r.nearest_hole_id, r.dist_to_hole_px) for r in hotspots.nearest_hole(points, holes).collect() if r.k != 3)
    assert got == [(1, 1, 5.0), (1, 1, 5.0), (2, 3, 1e6 - 90), (4, 3, 44.0), (5, 1, pytest.approx(np.hypot(5000, 7000)))]
    assert [tuple(r)[3:] for r in hotspots.nearest_hole(points.where("k = 3"), holes).collect()] == [(None, None)]
    assert {r.nearest_hole_id for r in hotspots.nearest_hole(points, holes.limit(0)).collect()} == {None} and hotspots.nearest_hole(points.limit(0), holes).count() == 0


def test_last_rows_and_signatures(spark):
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 2, "b", 1), (1, 2, "c", 0), (2, None, "d", 5), (None, 1, "e", 2)], "k int, at int, v string, w int")
    assert {tuple(r) for r in reshape.last_rows(rows, ["k"], ["at"]).select("k", "v", "w").collect()} == {(1, "c", 0), (2, "d", 5), (None, "e", 2)}
    assert reshape.last_rows(rows.limit(0), ["k"], ["at"]).count() == 0
    mixed = spark.createDataFrame([(1, "x", None), (1, "y", 2), (2, "y", 2), (2, "x", None), (3, "x", 2), (3, "y", None)], "k int, v string, w int").repartition(3)
    by = {r.k: r.signature for r in reshape.signatures(mixed, ["k"], ["v", "w"]).collect()}
    assert by[1] == by[2] != by[3]
    frames_ = reshape.snapshot_frames(spark.createDataFrame([(5,), (1,), (None,), (5,), (9,)], "frame_id int"), 2).collect()
    assert sorted(tuple(r) for r in frames_) == [(1, 0, True), (5, 1, True), (9, 2, False)]


def test_fronts_by_hole(spark):
    rows = [(0, 1, 0, 1, 30), (0, 1, 1, 1, 10), (0, 1, 1, 2, 30), (0, 2, 0, 1, 10), (0, 2, 2, 2, 10)]
    tensor = spark.createDataFrame([(f, h, t, 0, c, n) for f, h, t, c, n in rows], "frame_id int, hole_id int, terrace_index int, sector_id int, cluster_id int, pixel_count long")
    got = {r.cluster_id: r for r in activity.hole_front_metrics(tensor).collect()}
    one = got[1]  # hole 1: terraces 1 (share 1) and 2 (share .25); hole 2: terrace 1 (share 1)
    assert one.weighted_mean_terrace == pytest.approx((1 + 0.5 + 1) / 2.25) and one.peak_terrace == 1 and one.outer_front_terrace == 2 and one.n_holes == 2
    assert one.hole_mean_weighted_mean_terrace == pytest.approx((1.2 + 1) / 2) and one.hole_q90_weighted_mean_terrace == pytest.approx(1.18)
    full = activity.full_tensor(tensor, 4).collect()
    assert len(full) == 8 and {r.theta_center_deg for r in full} == {45.0} and sum(r.pixel_count == 0 for r in full) == 3
    assert {r.n_holes for r in activity.hole_consistency(tensor).collect()} == {1, 2}


def test_supports_on_found_archetypes(spark):
    """Bootstraps of fronts against centroids of k-means, by loops."""
    rng = np.random.default_rng(4)
    fronts = [(h, f, float(rng.uniform(0, 1) + (h % 2)), float(rng.uniform()), float(rng.uniform()), float(rng.uniform())) for h in range(6) for f in range(5)]
    names = ["rdf_front_radius_norm", "rdf_spread_norm", "rdf_total_positive_delta", "rdf_inner_minus_outer_delta"]
    df = spark.createDataFrame(fronts, "hole_id int, frame_id int, " + ", ".join(f"{n} double" for n in names))
    features = rdf.archetype_features(df)
    placed = clusters.kmeans(features, queries.FEATURES, 2, scale=False, seeds_by_mean=True)
    centres = clusters.canonical(placed, queries.FEATURES, [F.col("mean_front_radius_norm")], "a").select(F.col("canonical_label").alias("label"), *queries.FEATURES)
    got = {r.hole_id: (r.n_boot, r.archetype_label, r.support_fraction) for r in resample.archetype_support(df, centres, queries.FEATURES, 16).collect()}
    at = {r.label: np.array([r[f] for f in queries.FEATURES]) for r in centres.collect()}
    for h in range(6):
        own = [r for r in fronts if r[0] == h]
        votes = {}
        for boot in range(16):
            drawn = sorted((own[(h * resample.A + boot * resample.B + d * resample.C + resample.D) % resample.M % 5] for d in range(5)), key=lambda r: r[1])
            y = np.array([r[2] for r in drawn])
            v = np.array([y.mean(), y[-1] - y[0], y.std(), np.mean([r[3] for r in drawn]), np.mean([r[4] for r in drawn]), np.mean([abs(r[5]) for r in drawn])])
            label = min(at, key=lambda k: (round(float(((at[k] - v) ** 2).sum()), 9), k))
            votes[label] = votes.get(label, 0) + 1
        best = min(votes, key=lambda k: (-votes[k], k))
        assert got[h] == (16, best, votes[best] / 16)


@pytest.mark.parametrize("name,scans", [("archetype_support", 1), ("supported_uncertainty", 1), ("uncertainty_groups", 6), ("stable_windows", 1), ("nearest_hole", 1), ("cluster_activity", 1), ("edge_energy", 0), ("frame_audit", 0)])
def test_plans_read_little(spark, sf_dir, name, scans):
    """Shared parts are written once: few scans of tables and no product of tables are left in the last plan."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans and "CartesianProduct" not in plan
