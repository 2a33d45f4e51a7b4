"""Filters of images against NumPy on whole arrays; guards, places and mixtures on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringframe.operators import activity, frames, gates, mixture, stencils, sweeps

H, W = 9, 7


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(5)
    arrays = {f: rng.integers(0, 256, (H, W, 3)) for f in (0, 3)}
    rows = [(f, y, x, *map(int, a[y, x])) for f, a in arrays.items() for y in range(H) for x in range(W)]
    return arrays, spark.createDataFrame(rows, "frame_id int, y int, x int, r int, g int, b int").repartition(5)


def luma(a):
    return (299 * a[..., 0] + 587 * a[..., 1] + 114 * a[..., 2]) / 1000


def blurred(v, sigma):
    reach = round(4 * sigma)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.zeros_like(v)
    p = np.pad(v, reach, mode="reflect")
    for i in range(len(k)):
        for j in range(len(k)):
            out += k[i] * k[j] * p[i : i + v.shape[0], j : j + v.shape[1]]
    return out


def image(rows, column, shape=(H, W)):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def test_gaussian(images):
    arrays, px = images
    got = stencils.gaussian(stencils.grey_places(px), H, W, 1.5).collect()
    for f, a in arrays.items():
        assert np.allclose(image([r for r in got if r.frame_id == f], "v"), blurred(luma(a), 1.5))


def test_flat_field(images):
    arrays, px = images
    got = stencils.flat_field(px, H, W, 2.0).collect()
    assert len(got) == 2 * H * W
    for f, a in arrays.items():
        ground = np.maximum(blurred(luma(a), 2.0), 1)
        want = np.clip(np.floor(a / ground[..., None] * ground.mean() + 1e-9), 0, 255)
        for k, c in enumerate("rgb"):
            assert np.array_equal(image([r for r in got if r.frame_id == f], c), want[..., k])


def test_prominence(images, spark):
    arrays, px = images
    got = {r.frame_id: r.prominence for r in stencils.positive_prominence(px, H, W, 1.0).collect()}
    for f, a in arrays.items():
        over = luma(a) - blurred(luma(a), 1.0)
        assert got[f] == pytest.approx(over[over > 0].mean())
    even = spark.createDataFrame([(1, y, x, 7, 7, 7) for y in range(4) for x in range(4)], px.schema)
    assert stencils.positive_prominence(even, 4, 4).first()["prominence"] == 0.0


def test_gradients_and_laplacian(images):
    arrays, px = images
    edges = {r.frame_id: r.edge_energy_ratio for r in stencils.edge_energy(px, H, W, 2).collect()}
    sharp = {r.frame_id: r.blur_score for r in stencils.laplacian_blur(px, H, W).collect()}
    for f, a in arrays.items():
        p = np.pad(luma(a), 1, mode="reflect")
        at = lambda p, u, v: p[1 + u : 1 + u + H, 1 + v : 1 + v + W]
        gx = sum(w * (at(p, u, 1) - at(p, u, -1)) for u, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (at(p, 1, u) - at(p, -1, u)) for u, w in ((-1, 1), (0, 2), (1, 1)))
        size = np.hypot(gx, gy)
        outer = np.ones((H, W), bool)
        outer[1:-1, 1:-1] = False  # a border of min(2, 7 // 4) = 1
        assert edges[f] == pytest.approx(size[outer].mean() / size[~outer].mean())
        q = np.pad(np.floor(luma(a)), 1, mode="reflect")
        lap = at(q, 1, 0) + at(q, -1, 0) + at(q, 0, 1) + at(q, 0, -1) - 4 * at(q, 0, 0)
        assert sharp[f] == pytest.approx(lap.var())


def test_haar_blur_of_odd_sizes(images):
    arrays, px = images
    got = {r.frame_id: r.blur_score for r in stencils.haar_blur(px, H, W).collect()}
    for f, a in arrays.items():
        v = np.pad(np.floor(luma(a)) / 255, ((0, 1), (0, 1)), mode="edge")
        p, q, r, s = v[::2, ::2], v[::2, 1::2], v[1::2, ::2], v[1::2, 1::2]
        want = sum(np.abs(d / 2).mean() for d in (p - q + r - s, p + q - r - s, p - q - r + s))
        assert got[f] == pytest.approx(want)


def test_audit_and_reference(images):
    _, px = images
    blur = stencils.haar_blur(px, H, W)
    got = {r.frame_id: r for r in frames.audit(px, blur, 0.1).collect()}
    assert got[0]["jump"] == 0.0 and got[3]["jump"] > 0 and all(r.accepted == (max(r.saturation_r, r.saturation_g, r.saturation_b) < 0.05) for r in got.values())
    none = frames.audit(px, blur, 99.0)
    assert sweeps.reference_frame(none, "blur_score").collect()[0].asDict() == {"reference_frame_id": 0, "accepted": False}
    assert not any(r.accepted for r in frames.audit(px, blur.limit(0), 0.0).collect())
    all_ = none.withColumn("accepted", F.col("frame_id") == 3)
    assert sweeps.reference_frame(all_, "blur_score").collect()[0].asDict() == {"reference_frame_id": 3, "accepted": True}


@pytest.mark.parametrize("share", [0.1, 0.6, 0.95])
def test_distances(spark, share):
    rng = np.random.default_rng(int(share * 100))
    masks = {f: rng.random((40, 23)) < share for f in (1, 2)}
    masks[2][5:35, 3:20] = True
    rows = [(f, int(y), int(x)) for f, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    got = stencils.distances(spark.createDataFrame(rows, "frame_id int, y int, x int").repartition(6), 40, 23).collect()
    for f, m in masks.items():
        out = np.argwhere(~m)
        want = {(y, x): float(np.sqrt(((out - (y, x)) ** 2).sum(1).min())) for y, x in np.argwhere(m)}
        assert {(r.y, r.x): r.distance for r in got if r.frame_id == f} == pytest.approx(want)


def test_distance_terraces(spark):
    disk = [(1, y, x) for y in range(21) for x in range(21) if (y - 10) ** 2 + (x - 10) ** 2 <= 81]
    full = [(2, y, x) for y in range(21) for x in range(21)]
    got = stencils.distance_terraces(spark.createDataFrame(disk + full, "frame_id int, y int, x int"), 21, 21, 4).collect()
    most = 82**0.5
    assert {r.frame_id for r in got} == {1} and {r.terrace for r in got} == {0, 1, 2, 3} and (10, 10) not in {(r.y, r.x) for r in got}
    assert all(r.terrace * most / 4 <= r.distance + 1e-9 < (r.terrace + 1) * most / 4 + 1e-9 for r in got)
    assert stencils.distances(spark.createDataFrame([], "frame_id int, y int, x int"), 5, 5).count() == 0


def test_support(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "frame_id int")
    mask = spark.createDataFrame([(1, 3, 4, 0, 0), (1, 3, 4, 2, 3), (1, 3, 4, 9, 9), (2, 5, 5, 0, 0), (7, 3, 4, 0, 0)], "frame_id int, height int, width int, y int, x int")
    circle = spark.createDataFrame([(2, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 9.0)], "frame_id int, x double, y double, radius double")
    got = {}
    for r in stencils.support(3, 4, ids, mask, circle).collect():
        got.setdefault(r.frame_id, set()).add((r.y, r.x))
    assert got == {1: {(0, 0), (2, 3)}, 2: {(1, 1), (0, 1), (2, 1), (1, 0), (1, 2)}, 3: {(y, x) for y in range(3) for x in range(4)}}
    assert stencils.support(3, 4, ids).count() == 36


def test_input_guard(spark):
    ids = spark.createDataFrame([(1,), (2,)], "frame_id int")
    places = spark.createDataFrame([(y, x) for y in range(10) for x in range(10)], "y int, x int")

    def guard(holes, ids=ids, places=places):
        return gates.radial_input_guard(ids, spark.createDataFrame(holes, "frame_id int, radius_outer_px double"), places).collect()[0].asDict()

    assert guard([(1, 2.0)] * 3) == {"ok": True, "reason": None, "max_frame_holes": 3, "physical_max_holes": 7, "median_hole_radius_px": 2.0, "support_area_px": 100}
    crowded = guard([(1, 2.0)] * 8 + [(2, float("nan"))])
    assert (crowded["ok"], crowded["reason"], crowded["max_frame_holes"]) == (False, "hole_count_exceeds_physical_nonoverlap_limit", 8)
    assert guard([])["reason"] == "no_holes" and guard([(9, 1.0)])["reason"] == "no_holes"
    assert guard([(1, 1.0)], ids.limit(0))["reason"] == "no_frames"
    assert guard([(1, None)] * 500)["ok"] and guard([(1, 50.0)] * 2)["physical_max_holes"] == 1
    assert guard([(1, 5.0)] * 9, places=places.limit(0))["ok"]


def test_response_places_and_barcode(spark):
    rows = [(0, 1, 0.5), (1, 1, 0.5), (0, 2, None), (1, 2, None), (0, 3, 0.1), (1, 3, 0.9), (0, 4, 0.9), (1, 4, 0.1), (1, 5, 0.3), (1, 5, 0.1)]
    response = spark.createDataFrame(rows, "frame_id int, hole_id int, response double")
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "a"), (2, "z")], "hole_id int, phenotype_label string")
    onsets = spark.createDataFrame([(2, 9), (3, 1), (4, 1), (4, 7)], "hole_id int, onset_frame int")
    places = activity.response_places(response, labels, onsets)
    got = sorted((r.place, r.hole_id, r.phenotype_label, r.onset_frame, r.peak_frame, r.integrated_response) for r in places.collect())
    assert got == [(0, 5, "", None, 1, 0.4), (1, 4, "a", 1, 0, 1.0), (2, 3, "a", 1, 1, 1.0), (3, 2, "a", 9, 0, 0.0), (4, 1, "b", None, 0, 1.0)]
    matrix = {(r.place, r.frame_id): r.response for r in activity.barcode(response, places).collect()}
    assert len(matrix) == 10 and matrix[0, 0] is None and matrix[0, 1] == pytest.approx(0.2) and matrix[1, 0] == 0.9 and matrix[3, 1] is None
    assert activity.response_places(response.limit(0), labels, onsets).count() == 0


def test_onsets_at_the_level(spark):
    """Sums that are the level but for their last bits are no onset, whichever way the bits fall."""
    above, below = 1.1 - 0.7, 0.6 - 0.2
    assert above > 0.4 > below
    rows = [(0, 1, above), (1, 1, below), (2, 1, 0.4), (3, 1, 0.41), (0, 2, above), (1, 2, None)]
    response = spark.createDataFrame(rows, "frame_id int, hole_id int, response double")
    assert [tuple(r) for r in activity.onsets(response, 0.4).collect()] == [(1, 3)]


# Candidate rows (k, icl, relevant weight and separation) whose choice is known.
CANDIDATES = "set_id string, k int, bic double, icl double, min_component_weight double, component_weight_floor double, min_center_sigma_separation double"


def test_choice(spark):
    sets = {
        "simple": [(2, 100.0, 1.0, 2.0), (3, 95.0, 1.0, 2.0), (4, 92.0, 1.0, 2.0)],  # all within 10 of the best: the smallest
        "strong": [(2, 100.0, 1.0, 2.0), (3, 80.0, 1.0, 2.0), (4, 50.0, 1.0, 2.0)],
        "light": [(2, 100.0, 1.0, 2.0), (3, 50.0, 0.05, 2.0), (4, 60.0, 1.0, 1.6)],  # 3 has too small a weight; 1.6 is 0.8 x 2.0
        "near": [(2, 100.0, 1.0, 2.0), (3, 50.0, 1.0, 1.5)],
        "none": [(3, 50.0, 0.0, 1.0), (4, 50.0, 0.0, 1.0), (5, 60.0, 0.0, 1.0)],
        "one": [(2, 1.0, 0.0, math.inf), (3, -50.0, 0.5, 0.1)],  # no floor of separation
    }
    rows = [(s, k, icl, icl, w, 0.1, d) for s, own in sets.items() for k, icl, w, d in own]
    got = {r.set_id: r.k for r in mixture.judged(spark.createDataFrame(rows, CANDIDATES), keys=("set_id",)).where("selected").collect()}
    assert got == {"simple": 2, "strong": 4, "light": 4, "near": 2, "none": 3, "one": 3}


def test_mixture_fit_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.05, (60, 3)) for m in (0.1, 0.4, 0.8)])
    w = rng.integers(1, 4, len(x)).astype(float)
    points = spark.createDataFrame([(*map(float, p), float(c)) for p, c in zip(x, w, strict=True)], "_x double, _y double, _l double, _w double").repartition(4)
    models, candidates = mixture.fit(points, 2, 4)
    rows = {r.k: r for r in mixture.judged(candidates).collect()}
    n = round(w.sum())
    for k, m in models.items():
        # the same start, then EM by loops over points and components
        at = np.floor((x.sum(1) + 2) * (1024 / 5)).astype(int)
        order = sorted(set(at))
        bins = np.array([w[at == b].sum() for b in order])
        middle = (np.cumsum(bins) - bins / 2) / bins.sum()
        part = {b: min(int(t * k), k - 1) for b, t in zip(order, middle, strict=True)}
        own = np.array([part[b] for b in at])
        mean = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) for i in range(k)])
        centre = np.average(x, axis=0, weights=w)
        var = np.tile(np.average((x - centre) ** 2, axis=0, weights=w) + 1e-6, (k, 1))
        pi, before = np.full(k, 1 / k), -np.inf

        def expect(pi=None, mean=None, var=None, k=k):
            dens = np.stack([pi[i] * np.prod(np.exp(-((x - mean[i]) ** 2) / (2 * var[i])) / np.sqrt(2 * np.pi * var[i]), axis=1) for i in range(k)], axis=1)
            return dens / dens.sum(1, keepdims=True), float(w @ np.log(dens.sum(1)))

        for _ in range(80):
            p, score = expect(pi, mean, var)
            mass = (p * w[:, None]).sum(0)
            pi, mean = mass / mass.sum(), ((p * w[:, None]).T @ x) / mass[:, None]
            var = np.stack([((p[:, i] * w)[:, None] * (x - mean[i]) ** 2).sum(0) / mass[i] for i in range(k)]) + 1e-6
            if abs(score / n - before) < 1e-3:
                break
            before = score / n
        p, score = expect(pi, mean, var)
        assert np.allclose(m.means, mean, atol=1e-6) and np.allclose(m.weights, pi, atol=1e-6) and np.allclose(m.variances, var, rtol=1e-3)
        entropy = -(w[:, None] * p * np.log(np.clip(p, 1e-12, 1))).sum()
        assert rows[k].bic == pytest.approx(-2 * score + (7 * k - 1) * math.log(n), rel=1e-6) and rows[k].icl == pytest.approx(rows[k].bic + 2 * entropy, rel=1e-5)
    assert [k for k, r in rows.items() if r.selected] == [3]
    assert mixture.fit(points.limit(3).withColumn("_w", F.lit(1.0)))[0] == {} and mixture.choose(points.limit(0)) is None


def test_colours_count_every_pixel_and_frames_alike(spark):
    rows = [(1, 10, 20, 30)] * 6 + [(1, 200, 0, 0)] * 2 + [(2, 200, 0, 0)] * 2 + [(2, None, 0, 0)]
    got = sorted(round(r._w, 9) for r in mixture.colours(spark.createDataFrame(rows, "frame_id int, r int, g int, b int")).collect())
    assert got == [3.75, 6.25]  # each frame weighs 5 of the 10 pixels
