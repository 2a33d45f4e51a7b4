"""Diagonal Gaussian mixtures of colours: fitted on all pixels by Spark sums, chosen by relevance and ICL, applied as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import hsl, rgb8
from ringframe.sources.scratch import checkpointed

# Rounds of EM at most, the gain of a round's mean log likelihood that ends them, what is added to variances, bins of the start.
ROUNDS, GAIN, RIDGE, BINS = 80, 1e-3, 1e-6, 1024
LEAST_POINTS = 8
CANDIDATE = "k int, bic double, classification_entropy double, icl double, min_component_weight double, component_weight_floor double, min_center_sigma_separation double"


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray


def embedded(pixels: DataFrame) -> DataFrame:
    h, s, light = hsl(F.col("r"), F.col("g"), F.col("b"))
    turn = 2 * math.pi
    return pixels.withColumns({"_x": s * F.cos(h * turn), "_y": s * F.sin(h * turn), "_l": light})


def colours(pixels: DataFrame) -> DataFrame:
    """The distinct colours (at most 2^24) with their weight `_w`: every pixel counts, each frame as much as any other; weights sum to the number of pixels."""
    counts = pixels.dropna(subset=["r", "g", "b"]).groupBy("frame_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpointed(counts)
    frames = counts.groupBy(F.col("frame_id").alias("_f")).agg(F.sum("_n").alias("_of"))
    whole = frames.agg((F.sum("_of") / F.count(F.lit(1))).alias("_each"))  # one row
    shares = counts.join(frames, F.col("frame_id").eqNullSafe(F.col("_f"))).crossJoin(F.broadcast(whole))
    return embedded(shares.groupBy("r", "g", "b").agg(F.sum(F.col("_n") / F.col("_of") * F.col("_each")).alias("_w"))).select("_x", "_y", "_l", "_w")


def log_parts(x: np.ndarray, m: Mixture) -> np.ndarray:
    """log(weight x density) of each point (rows) under each component."""
    const = np.log(np.maximum(m.weights, 1e-300)) - 0.5 * np.log(2 * np.pi * m.variances).sum(axis=1)
    return const - 0.5 * (((x[:, None] - m.means) ** 2) / m.variances).sum(axis=2)


def sums(points: DataFrame, models: dict[int, Mixture]) -> dict[int, np.ndarray]:
    """One pass for all mixtures: by k a row for each component: mass, sums of x and of squares of x; log likelihood, entropy."""
    width = 9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((k, width)) for k in models}
        for batch in batches:
            columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            x, w = columns[:, :3], columns[:, 3:]
            for k, m in models.items():
                logs = log_parts(x, m)
                whole = np.logaddexp.reduce(logs, axis=1)
                p = np.exp(logs - whole[:, None])
                mass, out = p * w, total[k]
                out[:, 0] += mass.sum(axis=0)
                out[:, 1:4] += mass.T @ x
                out[:, 4:7] += mass.T @ (x * x)
                out[0, 7] += float(w[:, 0] @ whole)
                out[:, 8] -= (mass * np.log(np.clip(p, 1e-12, 1.0))).sum(axis=0)
        rows = [(k, i, j, float(total[k][i, j])) for k in total for i in range(k) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k", "i", "j", "v"])

    out = {k: np.zeros((k, width)) for k in models}
    for r in points.mapInArrow(run, "k long, i long, j long, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.k][r.i, r.j] = r.v
    return out


def starts(points: DataFrame, ks: list[int]) -> dict[int, Mixture]:
    """Mixtures to begin with: points are cut into k parts of equal weight by x + y + l (in BINS steps), each with its mean; all have the points' variances."""
    bin_ = F.floor((F.col("_x") + F.col("_y") + F.col("_l") + 2) * (BINS / 5)).cast("int")
    moments = [F.sum(F.col("_w") * F.col(c)).alias(f"s{c}") for c in ("_x", "_y", "_l")] + [F.sum(F.col("_w") * F.col(c) * F.col(c)).alias(f"q{c}") for c in ("_x", "_y", "_l")]
    rows = points.groupBy(bin_.alias("bin")).agg(F.sum("_w").alias("w"), *moments).orderBy("bin").collect()
    table = np.array([r[1:] for r in rows], float)
    w = table[:, 0]
    mean = table[:, 1:4].sum(axis=0) / w.sum()
    variance = np.maximum(table[:, 4:7].sum(axis=0) / w.sum() - mean**2, 0) + RIDGE
    middle = (np.cumsum(w) - w / 2) / w.sum()
    out = {}
    for k in ks:
        part, means = np.minimum((middle * k).astype(int), k - 1), []
        for i in range(k):
            own = part == i
            own = own if own.any() else np.arange(len(w)) == np.abs(middle - (i + 0.5) / k).argmin()
            means.append(table[own, 1:4].sum(axis=0) / w[own].sum())
        out[k] = Mixture(np.full(k, 1 / k), np.array(means), np.tile(variance, (k, 1)))
    return out


def fit(points: DataFrame, k_min: int = 2, k_max: int = 8, rounds: int = ROUNDS) -> tuple[dict[int, Mixture], DataFrame]:
    """Mixtures of k_min to k_max components by expectation maximisation over weighted points (_x, _y, _l, _w), and their candidate rows.

    Each round is one pass over all points for all k that still gain; only sums for each component come back. Fewer
    than LEAST_POINTS points (by weight) or none give no mixtures. ICL = BIC + 2 x entropy.
    """
    spark = points.sparkSession
    points = checkpointed(points)
    size = points.agg(F.sum("_w").alias("n"), F.count(F.lit(1)).alias("distinct")).first()
    n = round(size.n or 0)
    if n < max(LEAST_POINTS, k_min):
        return {}, spark.createDataFrame([], CANDIDATE)
    models = starts(points, list(range(k_min, max(k_min, min(k_max, size.distinct)) + 1)))
    open_, before = set(models), dict.fromkeys(models, -math.inf)
    for _ in range(rounds):
        if not open_:
            break
        for k, s in sums(points, {k: models[k] for k in open_}).items():
            mass = s[:, :1] + 10 * np.finfo(float).eps
            means = s[:, 1:4] / mass
            models[k] = Mixture(s[:, 0] / s[:, 0].sum(), means, np.maximum(s[:, 4:7] / mass - means**2, 0) + RIDGE)
            gained, before[k] = s[0, 7] / n - before[k], s[0, 7] / n
            if abs(gained) < GAIN:
                open_.discard(k)
    rows = []
    for k, s in sorted(sums(points, models).items()):
        bic, entropy = -2 * s[0, 7] + (k * 6 + k - 1) * math.log(n), s[:, 8].sum()
        rows.append((k, float(bic), float(entropy), float(bic + 2 * entropy), float(models[k].weights.min()), 1 / math.sqrt(n), separation(models[k])))
    return models, spark.createDataFrame(rows, CANDIDATE)


def separation(m: Mixture) -> float:
    """The least distance of two centres in their pooled sigmas (root mean square over the dimensions); infinite for one component."""
    v = np.maximum(m.variances, 1e-9)
    return min((float(np.sqrt(np.mean((m.means[i] - m.means[j]) ** 2 / (0.5 * (v[i] + v[j]))))) for i in range(len(v)) for j in range(i)), default=math.inf)


def judged(candidates: DataFrame, k_min: int = 2, keys: tuple[str, ...] = (), window: float = 10.0, share: float = 0.8) -> DataFrame:
    """Candidates (a row for each k; sets of them by `keys`) with their relevance, differences from the best, and which one is selected.

    Relevant are those of at most k_min components, and those whose least weight reaches their floor and whose least
    separation reaches `share` of that of k_min (of the least k if it is missing; 0 if that is infinite). The smallest relevant
    one within `window` of the best relevant ICL is selected; if none is relevant, the one of the least ICL. Ties go to the smaller k.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    apart = F.col("min_center_sigma_separation")
    base = F.min_by(apart, F.struct((F.col("k") != k_min).alias("other"), "k")).over(group)
    floor = F.when((base > 0) & (base < float("inf")), share * base).otherwise(0.0)
    relevant = (F.col("k") <= k_min) | ((F.col("min_component_weight") >= F.col("component_weight_floor")) & (apart >= F.col("center_separation_floor")))
    out = candidates.withColumn("center_separation_floor", floor).withColumn("is_relevant", F.coalesce(relevant, F.lit(False)))
    least = F.min_by("k", F.struct("icl", "k")).over(group)
    eligible = F.when(F.max("is_relevant").over(group), F.col("is_relevant")).otherwise(F.col("k") == least)
    out = out.withColumn("_eligible", eligible).withColumn("_best", F.min(F.when(F.col("_eligible"), F.col("icl"))).over(group))
    within = F.col("_eligible") & (F.col("icl") <= F.col("_best") + window)
    out = out.withColumns({"bic_delta_from_best": F.col("bic") - F.min("bic").over(group), "icl_delta_from_best": F.col("icl") - F.min("icl").over(group), "selected": F.col("k") == F.min(F.when(within, F.col("k"))).over(group)})
    return out.drop("_eligible", "_best")


def choose(points: DataFrame, k_min: int = 2, k_max: int = 8) -> Mixture | None:
    """The selected mixture of the points (colours), None if there are too few."""
    models, candidates = fit(points, k_min, k_max)
    picked = judged(candidates, k_min).where("selected").first() if models else None
    return models[picked.k] if picked else None


def densities(model: Mixture) -> list[Column]:
    out = []
    for w, m, v in zip(model.weights, model.means, model.variances, strict=True):
        const = float(np.log(w) - 0.5 * np.log(2 * np.pi * v).sum())
        terms = [(F.col(c) - float(a)) * (F.col(c) - float(a)) / float(2 * b) for c, a, b in zip(("_x", "_y", "_l"), m, v, strict=True)]
        out.append(F.exp(F.greatest(F.lit(-600.0), const - terms[0] - terms[1] - terms[2])))
    return out


def prevalence(pixels: DataFrame, model: Mixture | None) -> DataFrame:
    """Per (frame, cluster): the share of pixels that belong to it most and the mean membership. One pass, no Python. No model gives no rows."""
    if model is None:
        return pixels.select("frame_id", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("soft_prevalence"), F.lit(0.0).alias("hard_prevalence")).limit(0)
    p = F.array(*densities(model))
    known = embedded(pixels).withColumn("_p", p).withColumn("_t", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)).withColumn("_top", F.array_max("_p"))
    parts = [F.struct(F.lit(i).alias("cluster_id"), (F.col("_p")[i] / F.col("_t")).alias("soft"), (F.col("_p")[i] == F.col("_top")).cast("double").alias("hard")) for i in range(len(model.weights))]
    return known.select("frame_id", F.explode(F.array(*parts)).alias("_c")).groupBy("frame_id", "_c.cluster_id").agg(F.avg("_c.soft").alias("soft_prevalence"), F.avg("_c.hard").alias("hard_prevalence"))


def frame_context(shares: DataFrame) -> DataFrame:
    """Per frame: the cluster of the largest soft share, the least among equals, and the entropy in nats."""
    p = F.col("soft_prevalence")
    rank = F.struct(p, -F.col("cluster_id"))
    return shares.groupBy("frame_id").agg(F.max_by("cluster_id", rank).alias("dominant_cluster"), (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy_nats"))


def palette(centres: DataFrame, observed: DataFrame) -> DataFrame:
    """Per cluster its centre (hx, hy, l) as hue, saturation and lightness and as channels, and the colour to show: the observed one if known.

    `observed` (cluster_id, r, g, b) may lack clusters or channels; one without all channels is not known.
    """
    clipped = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    hue = F.pmod(F.atan2("hy", "hx") / (2 * math.pi), F.lit(1.0))
    at = centres.select("cluster_id", hue.alias("center_h"), clipped(F.hypot("hx", "hy")).alias("center_s"), clipped(F.col("l")).alias("center_l"))
    at = at.withColumns(dict(zip(("centroid_r", "centroid_g", "centroid_b"), rgb8(F.col("center_h"), F.col("center_s"), F.col("center_l")), strict=True)))
    seen = observed.select("cluster_id", *[F.when(F.col(c).isNotNull(), F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0))).cast("int").alias(f"_{c}") for c in "rgb"]).dropna()
    both = at.join(seen, "cluster_id", "left")
    shown = [F.coalesce(f"_{c}", f"centroid_{c}").alias(f"display_{c}") for c in "rgb"]
    return both.select(*at.columns, *shown, F.when(F.col("_r").isNotNull(), "observed").otherwise("centroid").alias("display_source"))
