"""Phenotypes, trims, complete holes and palettes on small literal rows."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringframe.functions.expressions import rgb8
from ringframe.operators import clusters, lattice, mixture, phenotypes, reshape, trim

FEATURES = "hole_id int, " + ", ".join(f"{f} double" for f in phenotypes.FEATURES)
HOLES = "hole_id int, lattice_u int, lattice_v int, x double, y double, radius_inner_px double, radius_outer_px double"


def grouped(spark):
    """Twelve holes in three groups far apart: outwards, together, from outside."""
    rows = [(i, *(base + 0.01 * (i % 4) for base in kind)) for i, kind in ((3 * j + g, ((1.0, 1.0, 0.9, 0.9, 6.0, 6.0), (0.0, 0.0, 0.5, 0.5, 0.0, 0.0), (-1.0, -1.0, 0.1, 0.1, -6.0, -6.0))[g]) for j in range(4) for g in range(3))]
    return spark.createDataFrame(rows, FEATURES)


def test_phenotypes(spark):
    got = {r["hole_id"]: r["phenotype_label"] for r in phenotypes.assign(grouped(spark)).collect()}
    assert got == {i: ("P1_outward_propagating", "P2_near_synchronous", "P3_outer_first")[i % 3] for i in range(12)}
    alone = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0, None, 1.0)], FEATURES)
    assert [r["phenotype_label"] for r in phenotypes.assign(alone).collect()] == ["P1_irregular"]
    assert phenotypes.assign(grouped(spark).limit(0)).count() == 0


def test_phenotype_stability(spark):
    rows = phenotypes.stability(grouped(spark), n_reruns=3, jitter=0.001).collect()
    assert len(rows) == 12 and all(r["reruns"] == 3 and 0 < r["stability_fraction"] <= 1 for r in rows)
    assert [tuple(r) for r in phenotypes.stability(grouped(spark), n_reruns=3, jitter=0.001).orderBy("hole_id").collect()] == [tuple(r) for r in sorted(rows)]
    one = phenotypes.stability(grouped(spark), k=1, n_reruns=4).collect()
    assert {(r["stability_fraction"], r["base_matches_dominant"], r["n_unique_labels"]) for r in one} == {(1.0, True, 1)}
    assert phenotypes.stability(grouped(spark).limit(0)).count() == 0


def test_matched_centroids():
    blank = dict.fromkeys(phenotypes.FEATURES)
    base = [blank | {"cluster_id": i, "canonical_id": i + 1, "canonical_label": f"P{i + 1}_{m}", "label": m, "onset_lag_frames": float(i)} for i, m in enumerate(("near_synchronous", "irregular"))]
    found = [blank | {"cluster_id": i, "label": m, "onset_lag_frames": v} for i, m, v in ((0, "irregular", 9.0), (1, "irregular", 0.1), (2, "outer_first", 5.0))]
    assert phenotypes.matched(base, found) == {1: "P1_near_synchronous", 0: "P2_irregular", 2: "UNMATCHED_outer_first"}


def test_kmeans_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 2)).round(6)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "hole_id int, a double, b double").repartition(5)
    got = np.array([r["cluster_id"] for r in clusters.kmeans(rows, ["a", "b"], 4).orderBy("hole_id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    centres = z[[int(i * 59 / 3) for i in range(4)]].copy()
    for _ in range(100):
        near = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([z[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(4)])
        if np.allclose(moved, centres):
            break
        centres = moved
    assert got.tolist() == near.tolist()


def histograms(spark, frames):
    return spark.createDataFrame([(f, b, s) for f, shares in enumerate(frames) for b, s in shares.items()], "frame_id int, bin int, share double").withColumn("n", F.lit(1)).withColumn("cdf", F.col("share"))


def test_trim(spark):
    """A lasting jump at frame 12, of 30; a lone flicker at frame 5 is none."""
    early, late = {10: 0.5, 20: 0.5}, {200: 0.5, 210: 0.5}
    frames = [dict(late if i >= 12 else early) for i in range(30)]
    frames[5] = {10: 0.6, 20: 0.4}
    (r,) = trim.suggestion(histograms(spark, frames), 5).collect()
    assert (r["cursor_frame"], r["first_stable_frame"], r["stable_run_frames"], r["confidence"]) == (11, 12, 18, 1.0)
    assert trim.suggestion(histograms(spark, [early] * 10), 5).count() == 0
    assert [trim.window_frames(n) for n in (6, 30, 200, 1000)] == [3, 5, 12, 18]


def test_black_crop(spark):
    bands = lambda rows: spark.createDataFrame(rows, "frame_id int, top_black_rows int, bottom_black_rows int")
    (r,) = trim.black_crop(bands([(i, 6 + i % 3, 3 if i < 7 else 0) for i in range(10)]), 100).collect()
    assert (r["applied"], r["top"], r["bottom"], r["cropped_height"]) == (True, 6, 0, 94)
    (r,) = trim.black_crop(bands([(i, 90, 0) for i in range(10)]), 100).collect()
    assert not r["applied"] and r["reason"] == "unsafe_crop_too_little_content" and r["cropped_height"] == 100
    (r,) = trim.black_crop(bands([]), 100).collect()
    assert not r["applied"] and r["n_frames"] == 0


def test_complete_is_a_fixed_point(spark):
    """Dropping the close pair's outer hole widens the other's terraces, which then leave the frame too."""
    rows = [(7, 0, 0, 30.0, 50.0, 4.0, 5.0), (8, 1, 0, 8.0, 50.0, 4.0, 5.0), (9, -1, 0, 110.0, 50.0, 4.0, 5.0), (10, 9, 9, 150.0, 50.0, 4.0, 5.0)]
    got = {r["hole_id"]: (r["status"], r["exclusion_iteration"]) for r in lattice.complete(spark.createDataFrame(rows, HOLES), 200.0, 100.0, 100.0, 50.0, 1000.0).collect()}
    assert got[8] == ("excluded", 1) and got[7] == ("excluded", 2) and got[10][0] == "kept"
    assert lattice.complete(spark.createDataFrame([], HOLES), 1.0, 1.0, 0.0, 0.0, 1.0).count() == 0


def test_chosen(spark):
    holes = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 3)], "hole_id int, tier int")
    relations = spark.createDataFrame([(1, "inside"), (2, "intersects"), (3, "inside")], "hole_id int, relation string")
    assert sorted((r["hole_id"], r["fallback"]) for r in lattice.chosen(holes, relations).collect()) == [(1, False), (4, False)]
    outside = relations.where("hole_id < 3").withColumn("relation", F.lit("outside"))
    assert sorted((r["hole_id"], r["fallback"]) for r in lattice.chosen(holes.where("hole_id < 4"), outside).collect()) == [(1, True), (2, True)]


def test_smoothed_and_lines(spark):
    rows = spark.createDataFrame([(1, f, float(v)) for f, v in enumerate((3, 6, 0, 9, 1, 2))] + [(2, 0, 5.0)], "hole_id int, frame_id int, v double")
    got = {(r["hole_id"], r["frame_id"]): r["v"] for r in reshape.smoothed(rows, ["hole_id"], "frame_id", ["v"], 5).collect()}
    padded = np.convolve(np.pad([3.0, 6, 0, 9, 1, 2], 2, mode="edge"), np.ones(5) / 5, mode="valid")
    assert [got[1, f] for f in range(6)] == pytest.approx(padded) and got[2, 0] == 5.0
    lines = {(r["hole_id"], r["frame_id"]): r["v"] for r in reshape.line_series(rows, "hole_id", "frame_id", "v", "frame_id", 2).collect()}
    assert len(lines) == 12 and lines[2, 3] is None and lines[1, 3] == 9.0


def test_rgb8_and_palette(spark):
    hues = spark.createDataFrame([(h / 24, s, l) for h in range(24) for s in (0.0, 0.4, 1.0) for l in (0.0, 0.3, 0.5, 0.8, 1.0)], "h double, s double, l double")
    for r in hues.select("*", *[c.alias(n) for n, c in zip("xyz", rgb8(F.col("h"), F.col("s"), F.col("l")), strict=True)]).collect():
        want = colorsys.hls_to_rgb(r["h"], r["l"], r["s"])
        assert [r[n] for n in "xyz"] == pytest.approx([255 * w for w in want], abs=0.5001)
    centres = spark.createDataFrame([(0, 1.0, 0.0, 0.5), (1, 0.0, 1.0, 0.5)], "cluster_id int, hx double, hy double, l double")
    seen = spark.createDataFrame([(0, 9.0, 8.0, 7.0), (1, None, 1.0, 1.0)], "cluster_id int, r double, g double, b double")
    got = {r["cluster_id"]: r for r in mixture.palette(centres, seen).collect()}
    assert (got[0]["display_r"], got[0]["centroid_r"], got[0]["display_source"]) == (9, 255, "observed")
    assert got[1]["display_source"] == "centroid" and got[1]["display_g"] == 255
