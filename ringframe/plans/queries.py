"""The registered queries over the fact-table views, each with the DuckDB SQL that must give the same rows.

Measures are rounded to nine decimals on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringframe.functions.expressions import settled
from ringframe.operators import activity, clusters, events, frames, gates, hotspots, lattice, mixture, phenotypes, pixels, radial, rdf, resample, reshape, sectors, stencils, sweeps, trim
from ringframe.sources import tables, views
from ringframe.sources.scratch import checkpointed, shared_folder
from ringframe.sources.views import SQL
from ringframe.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """floor(x * 10^9 + 0.5) / 10^9, which every engine computes alike (round() is not, where a decimal tie is not one in binary)."""
    return df.select(*[(F.floor(F.col(f.name) * 1e9 + 0.5) / 1e9).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def sql(tables: str, body: str, keep: str, measures: str = "", extra: str = "") -> str:
    """WITH the views named in `tables` and the CTEs in `extra`: the columns `keep` and the rounded `measures` of `body`."""
    ctes = [SQL[t] for t in tables.split()] + ([extra] if extra else []) or ["none AS (SELECT 1)"]
    cols = [keep] * bool(keep) + [f"floor({m} * 1e9 + 0.5) / 1e9 AS {m}" for m in measures.split()]
    return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM ({body})"


def recursive(text: str) -> str:
    return "WITH RECURSIVE " + text.removeprefix("WITH ")


def _settled(x: str) -> str:
    return f"(floor({x} * 1e9 + 0.5) / 1e9)"


def _kmeans(name: str, source: str, features: list[str], k: int, scale: bool = True, by_mean: bool = False, rounds: int = clusters.ROUNDS) -> str:
    """CTEs for `name` (hole_id, cluster_id): Lloyd's rounds over `source` from holes at even ranks, as a recursion over the centres."""
    d = range(1, len(features) + 1)
    value = lambda f: f"(coalesce({f}, m_{f}) - m_{f}) / CASE WHEN d_{f} > 1e-8 THEN d_{f} ELSE 1.0 END" if scale else f"coalesce({f}, m_{f})"
    stats = ", ".join(f"coalesce(avg({f}), 0.0) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in features)
    mean = " + ".join(f"v[{i}]" for i in d) if by_mean else "0.0"
    far = " + ".join(f"(h.v[{i}] - c.v[{i}]) * (h.v[{i}] - c.v[{i}])" for i in d)
    near = lambda of: f"SELECT h.hole_id, any_value(h.v) AS v, arg_min(c.c, {{'d': {far}, 'c': c.c}}) AS c FROM {name}_v h, {of} c GROUP BY h.hole_id"
    return f"""{name}_v AS (SELECT hole_id, [{", ".join(value(f) for f in features)}] AS v FROM {source}, (SELECT {stats} FROM {source})),
    {name}_r AS (SELECT v, row_number() OVER (ORDER BY {mean}, hole_id) - 1 AS rank, count(*) OVER () AS n FROM {name}_v),
    {name}_c AS (SELECT 0 AS r, CAST(i AS INTEGER) AS c, v FROM range({k}) t(i) JOIN {name}_r ON i < least({k}, n) AND rank = CASE WHEN least({k}, n) > 1 THEN i * (n - 1) // (least({k}, n) - 1) ELSE 0 END
      UNION ALL SELECT o.r + 1, o.c, coalesce(m.v, o.v) FROM {name}_c o LEFT JOIN (SELECT c, [{", ".join(f"avg(v[{i}])" for i in d)}] AS v FROM ({near(f"{name}_c")}) GROUP BY c) m ON m.c = o.c WHERE o.r < {rounds}),
    {name} AS (SELECT hole_id, c AS cluster_id FROM ({near(f"(SELECT c, v FROM {name}_c WHERE r = {rounds})")}))"""


# CTEs shared by the oracle texts.
def _evo(name: str, source: str, extra: str = "") -> str:
    g = f"PARTITION BY hole_id, {extra}frame_id"
    return f"""{name}0 AS (SELECT *, first_value(descriptor_value) OVER (PARTITION BY hole_id, {extra}annulus_id ORDER BY frame_id) AS baseline_descriptor_value FROM {source}),
    {name}1 AS (SELECT *, descriptor_value - baseline_descriptor_value AS delta_descriptor_value, CASE WHEN descriptor_value - baseline_descriptor_value IS NOT NULL THEN greatest(descriptor_value - baseline_descriptor_value, 0.0) END AS positive_delta_descriptor FROM {name}0),
    {name}2 AS (SELECT *, coalesce(sum(positive_delta_descriptor) OVER ({g}), 0.0) AS total, annulus_id / CAST(greatest(max(annulus_id) OVER ({g}), 1) AS DOUBLE) AS normalized_radius FROM {name}1),
    {name}3 AS (SELECT *, CASE WHEN total > 0 THEN positive_delta_descriptor / total END AS rdf_pdf FROM {name}2),
    {name} AS (SELECT *, sum(coalesce(rdf_pdf, 0.0)) OVER ({g} ORDER BY annulus_id) AS rdf_cdf FROM {name}3)"""


EVO = _evo("evo", "radial")
FRAMES = EVO + """, f0 AS (SELECT hole_id, frame_id, CASE WHEN max(total) > 0 THEN sum(normalized_radius * rdf_pdf) END AS rdf_front_radius_norm,
    CASE WHEN max(total) > 0 THEN sum(normalized_radius * normalized_radius * rdf_pdf) END AS second, max(total) AS rdf_total_positive_delta,
    CASE WHEN max(total) > 0 THEN arg_max(annulus_id, {'v': positive_delta_descriptor, 'k': -annulus_id}) END AS rdf_peak_annulus,
    arg_min(delta_descriptor_value, annulus_id) AS rdf_inner_delta, arg_max(delta_descriptor_value, annulus_id) AS rdf_outer_delta FROM evo GROUP BY ALL),
    b0 AS (SELECT hole_id, arg_min(frame_id, {'a': annulus_id, 'f': frame_id}) AS baseline_frame_id FROM evo GROUP BY hole_id),
    frames AS (SELECT *, CASE WHEN second IS NOT NULL THEN sqrt(CASE WHEN second - rdf_front_radius_norm * rdf_front_radius_norm > 1e-12 THEN second - rdf_front_radius_norm * rdf_front_radius_norm ELSE 0.0 END) END AS rdf_spread_norm, rdf_inner_delta - rdf_outer_delta AS rdf_inner_minus_outer_delta FROM f0 JOIN b0 USING (hole_id))"""
SEVO = _evo("sevo", "sector", "sector_id, ")
SFRAMES = SEVO + """, sframes AS (SELECT hole_id, frame_id, sector_id, CASE WHEN max(total) > 0 THEN sum(normalized_radius * rdf_pdf) END AS front, max(total) AS total FROM sevo GROUP BY ALL)"""


def _profile(name: str, source: str, keys: str, value: str = "descriptor_value") -> str:
    return f"""{name}_w AS (SELECT *, {value} - min({value}) OVER (PARTITION BY {keys}) + 1e-6 AS w FROM {source}),
    {name} AS (SELECT {keys}, sum(annulus_id * w) / sum(w) AS center_of_mass_annulus, arg_max(annulus_id, {{'v': {value}, 'k': -annulus_id}}) AS peak_annulus,
    CASE WHEN count({value}) >= 2 THEN arg_min({value}, annulus_id) - arg_max({value}, annulus_id) END AS inner_minus_outer,
    avg({value}) AS mean_descriptor, stddev_pop({value}) AS std_descriptor, count({value}) AS n_valid_annuli FROM {name}_w GROUP BY {keys})"""


def _fit(x: str, y: str, prefix: str = "") -> str:
    return f"""count({y}) AS {prefix}n, CASE WHEN regr_sxx({y}, {x}) > 0 THEN regr_sxy({y}, {x}) / regr_sxx({y}, {x}) END AS {prefix}slope,
    CASE WHEN regr_sxx({y}, {x}) > 0 THEN avg({y}) - regr_sxy({y}, {x}) / regr_sxx({y}, {x}) * avg({x}) FILTER (WHERE {y} IS NOT NULL) END AS {prefix}intercept,
    regr_syy({y}, {x}) AS {prefix}total, CASE WHEN regr_sxx({y}, {x}) > 0 THEN regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x}) END AS {prefix}residual"""


def _r2(residual: str, total: str, least: str = "1e-20") -> str:
    return f"CASE WHEN {total} > {least} THEN 1 - {residual} / {total} WHEN {total} IS NOT NULL THEN 1.0 END"


def _parabola(name: str, source: str, keys: str, x: str, y: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""{name}_m AS (SELECT {keys}, avg({x}) AS mx, avg({y}) AS my FROM {source} WHERE {y} IS NOT NULL GROUP BY {keys}),
    {name}_s AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, count(*) AS qn, count(DISTINCT {x}) AS d, any_value(mx) AS mx, any_value(my) AS my, sum(({x} - mx) ** 2) AS s2, sum(({x} - mx) ** 3) AS s3, sum(({x} - mx) ** 4) AS s4,
      sum(({x} - mx) * ({y} - my)) AS t1, sum(({x} - mx) ** 2 * ({y} - my)) AS t2, sum(({y} - my) ** 2) AS qtot FROM {source} a JOIN {name}_m m ON {on} WHERE {y} IS NOT NULL GROUP BY {", ".join("a." + k.strip() for k in keys.split(","))}),
    {name}_a AS (SELECT *, (t2 * s2 - t1 * s3) / ((s4 - s2 * s2 / qn) * s2 - s3 * s3) AS a, (t1 * (s4 - s2 * s2 / qn) - t2 * s3) / ((s4 - s2 * s2 / qn) * s2 - s3 * s3) AS b1 FROM {name}_s WHERE d >= 3),
    {name} AS (SELECT {keys}, a, b1 - 2 * a * mx AS b, my - a * s2 / qn - b1 * mx + a * mx * mx AS c, greatest(0.0, qtot - a * t2 - b1 * t1) AS qres, qtot FROM {name}_a)"""


# --- radial distribution -----------------------------------------------------------------------------------------------


def _evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.evolution(views.radial_rows(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.frame_summary(_evolution(spark, sf_dir))


@query("radial_rows", sql("radial", "SELECT * FROM radial", "hole_id, frame_id, annulus_id, lattice_u, lattice_v, area_px", "descriptor_value"))
def _(spark, sf_dir):
    return views.radial_rows(spark, sf_dir)


_EVO_KEEP, _EVO_M = "hole_id, frame_id, annulus_id", "normalized_radius descriptor_value baseline_descriptor_value delta_descriptor_value positive_delta_descriptor rdf_pdf rdf_cdf"


@query("rdf_evolution", sql("radial", "SELECT * FROM evo", _EVO_KEEP, _EVO_M, EVO))
def _(spark, sf_dir):
    return _evolution(spark, sf_dir).select(*_EVO_KEEP.split(", "), *_EVO_M.split())


_FRAME_M = "rdf_front_radius_norm rdf_total_positive_delta rdf_inner_delta rdf_outer_delta rdf_spread_norm rdf_inner_minus_outer_delta"


@query("rdf_frame_summary", sql("radial", "SELECT * FROM frames", "hole_id, frame_id, baseline_frame_id, rdf_peak_annulus", _FRAME_M, FRAMES))
def _(spark, sf_dir):
    return _frames(spark, sf_dir)


@query(
    "rdf_front_velocity",
    sql(
        "radial",
        f"""SELECT hole_id, n AS n_frames, CASE WHEN n = 1 THEN 0.0 ELSE slope END AS rdf_front_velocity_per_frame, CASE WHEN n = 1 THEN s ELSE intercept END AS rdf_front_intercept,
        CASE WHEN n = 1 THEN 1.0 WHEN slope IS NOT NULL THEN {_r2("residual", "total")} END AS rdf_front_velocity_r2, s AS start_front_radius_norm, e AS end_front_radius_norm, e - s AS delta_front_radius_norm FROM v""",
        "hole_id, n_frames",
        "rdf_front_velocity_per_frame rdf_front_intercept rdf_front_velocity_r2 start_front_radius_norm end_front_radius_norm delta_front_radius_norm",
        FRAMES + f", v AS (SELECT hole_id, {_fit('frame_id', 'rdf_front_radius_norm')}, arg_min(rdf_front_radius_norm, frame_id) AS s, arg_max(rdf_front_radius_norm, frame_id) AS e FROM frames WHERE rdf_front_radius_norm IS NOT NULL GROUP BY hole_id)",
    ),
)
def _(spark, sf_dir):
    return rdf.front_velocity(_frames(spark, sf_dir))


@query(
    "rdf_front_dynamics",
    sql(
        "radial",
        f"""SELECT l.hole_id, n AS n_frames, slope AS rdf_linear_velocity_per_frame, {_r2("residual", "total")} AS rdf_linear_velocity_r2, a AS rdf_quadratic_a, b AS rdf_quadratic_b, c AS rdf_quadratic_c, {_r2("qres", "qtot")} AS rdf_quadratic_r2,
        2 * a AS rdf_front_acceleration_per_frame2, ({_r2("qres", "qtot")}) - ({_r2("residual", "total")}) AS rdf_front_nonlinearity_gain FROM l LEFT JOIN q USING (hole_id)""",
        "hole_id, n_frames",
        "rdf_linear_velocity_per_frame rdf_linear_velocity_r2 rdf_quadratic_a rdf_quadratic_b rdf_quadratic_c rdf_quadratic_r2 rdf_front_acceleration_per_frame2 rdf_front_nonlinearity_gain",
        FRAMES + f", l AS (SELECT hole_id, {_fit('frame_id', 'rdf_front_radius_norm')} FROM frames WHERE rdf_front_radius_norm IS NOT NULL GROUP BY hole_id), {_parabola('q', 'frames', 'hole_id', 'frame_id', 'rdf_front_radius_norm')}",
    ),
)
def _(spark, sf_dir):
    return rdf.front_dynamics(_frames(spark, sf_dir))


FEATURES = ["mean_front_radius_norm", "delta_front_radius_norm", "front_radius_std_norm", "mean_rdf_spread_norm", "mean_rdf_total_positive_delta", "mean_abs_inner_minus_outer_delta"]
def _features(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS n_frames, avg(rdf_front_radius_norm) AS mean_front_radius_norm,
    any_value(last) - any_value(first) AS delta_front_radius_norm, stddev_pop(rdf_front_radius_norm) AS front_radius_std_norm, avg(rdf_spread_norm) AS mean_rdf_spread_norm,
    avg(rdf_total_positive_delta) AS mean_rdf_total_positive_delta, avg(abs(rdf_inner_minus_outer_delta)) AS mean_abs_inner_minus_outer_delta
    FROM (SELECT *, first_value(rdf_front_radius_norm) OVER w AS first, last_value(rdf_front_radius_norm) OVER w AS last FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY {keys})"""


_FEATURE_SQL = _features("features", "frames", "hole_id")


@query("rdf_archetype_features", sql("radial", "SELECT * FROM features", "hole_id, n_frames", " ".join(FEATURES), FRAMES + ", " + _FEATURE_SQL))
def _(spark, sf_dir):
    return rdf.archetype_features(_frames(spark, sf_dir))


_ARCHETYPES = f"""{FRAMES}, {_FEATURE_SQL}, {_kmeans("ka", "features", FEATURES, 3, scale=False, by_mean=True)}, kf AS (SELECT * FROM features JOIN ka USING (hole_id)),
    km AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(mean_front_radius_norm) NULLS LAST, avg(delta_front_radius_norm) NULLS LAST, avg(mean_rdf_total_positive_delta) DESC NULLS LAST, cluster_id) - 1 AS canonical_id FROM kf GROUP BY cluster_id)"""


@query("rdf_archetypes", recursive(sql("radial", "SELECT *, 'rdf_archetype_canonical_' || canonical_id AS canonical_label FROM kf JOIN km USING (cluster_id)", "hole_id, n_frames, cluster_id, CAST(canonical_id AS INTEGER) AS canonical_id, canonical_label", " ".join(FEATURES), _ARCHETYPES)))
def _(spark, sf_dir):
    rows = clusters.kmeans(rdf.archetype_features(_frames(spark, sf_dir)), FEATURES, 3, scale=False, seeds_by_mean=True)
    order = [F.col("mean_front_radius_norm").asc_nulls_last(), F.col("delta_front_radius_norm").asc_nulls_last(), F.col("mean_rdf_total_positive_delta").desc_nulls_last()]
    ids = clusters.canonical(rows, FEATURES, order, "rdf_archetype_canonical_")
    return rows.join(F.broadcast(ids.select("cluster_id", "canonical_id", "canonical_label")), "cluster_id")


# --- radial profiles ---------------------------------------------------------------------------------------------------

PROFILE = _profile("profile", "radial", "hole_id, frame_id")
_PROFILE_M = "center_of_mass_annulus inner_minus_outer mean_descriptor std_descriptor"


@query("hole_frame_profiles", sql("radial", "SELECT * FROM profile", "hole_id, frame_id, peak_annulus, n_valid_annuli", _PROFILE_M, PROFILE))
def _(spark, sf_dir):
    return radial.frame_profile(views.radial_rows(spark, sf_dir), ["hole_id", "frame_id"])


def _summary(keys: str, source: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT *, CASE WHEN delta_center_of_mass IS NULL THEN 'insufficient' WHEN delta_center_of_mass > 0.35 THEN 'outward_shift' WHEN delta_center_of_mass < -0.35 THEN 'inward_shift' ELSE 'stable' END AS radial_conclusion_label FROM (
    SELECT {k}arg_min(center_of_mass_annulus, frame_id) AS start_center_of_mass, arg_max(center_of_mass_annulus, frame_id) AS end_center_of_mass,
    arg_max(center_of_mass_annulus, frame_id) - arg_min(center_of_mass_annulus, frame_id) AS delta_center_of_mass, max(center_of_mass_annulus) - min(center_of_mass_annulus) AS center_of_mass_range,
    arg_min(peak_annulus, frame_id) AS start_peak_annulus, arg_max(peak_annulus, frame_id) AS end_peak_annulus, avg(inner_minus_outer) AS mean_inner_minus_outer, count(*) AS n_frames FROM {source} {"GROUP BY " + keys if keys else ""})"""


_SUMMARY_M = "start_center_of_mass end_center_of_mass delta_center_of_mass center_of_mass_range mean_inner_minus_outer"
_SUMMARY_K = "start_peak_annulus, end_peak_annulus, n_frames, radial_conclusion_label"


def _hole_summary(spark, sf_dir):
    return radial.evolution_summary(radial.frame_profile(views.radial_rows(spark, sf_dir), ["hole_id", "frame_id"]), ["hole_id"])


@query("hole_radial_evolution", sql("radial", _summary("hole_id", "profile"), "hole_id, " + _SUMMARY_K, _SUMMARY_M, PROFILE))
def _(spark, sf_dir):
    return _hole_summary(spark, sf_dir)


_AGG = "agg AS (SELECT frame_id, annulus_id, avg(descriptor_value) AS mean_descriptor, stddev_pop(descriptor_value) AS std_descriptor, count(descriptor_value) AS n_holes FROM radial GROUP BY ALL)"


@query("radial_aggregate", sql("radial", "SELECT * FROM agg", "frame_id, annulus_id, n_holes", "mean_descriptor std_descriptor", _AGG))
def _(spark, sf_dir):
    return radial.aggregate(views.radial_rows(spark, sf_dir), ["frame_id", "annulus_id"])


@query("run_radial_evolution", sql("radial", _summary("", "rp"), _SUMMARY_K, _SUMMARY_M, _AGG + ", " + _profile("rp", "(SELECT frame_id, annulus_id, mean_descriptor AS v FROM agg)", "frame_id", "v")))
def _(spark, sf_dir):
    agg = radial.aggregate(views.radial_rows(spark, sf_dir), ["frame_id", "annulus_id"]).drop("std_descriptor", "n_holes")
    return radial.evolution_summary(radial.frame_profile(agg, ["frame_id"], "mean_descriptor"), [])


_ZONES = """zone AS (SELECT hole_id, CASE WHEN on_u AND on_v THEN 'corner' WHEN on_u OR on_v THEN 'edge' ELSE 'interior' END AS reticulum_zone FROM (
    SELECT hole_id, lattice_u IN (min(lattice_u) OVER (), max(lattice_u) OVER ()) AS on_u, lattice_v IN (min(lattice_v) OVER (), max(lattice_v) OVER ()) AS on_v FROM holes))"""


@query("reticulum_zones", sql("holes", "SELECT * FROM zone", "hole_id, reticulum_zone", "", _ZONES))
def _(spark, sf_dir):
    return radial.zones(views.holes(spark, sf_dir))


_ZGROUP = _ZONES + ", zg AS (SELECT coalesce(reticulum_zone, 'all') AS reticulum_zone, frame_id, annulus_id, avg(descriptor_value) AS mean_descriptor, stddev_pop(descriptor_value) AS std_descriptor, count(descriptor_value) AS n_holes FROM radial LEFT JOIN zone USING (hole_id) GROUP BY ALL)"


@query("reticulum_groups", sql("holes radial", "SELECT * FROM zg", "reticulum_zone, frame_id, annulus_id, n_holes", "mean_descriptor std_descriptor", _ZGROUP))
def _(spark, sf_dir):
    return radial.zone_groups(views.radial_rows(spark, sf_dir), radial.zones(views.holes(spark, sf_dir)))


@query(
    "reticulum_group_profiles",
    sql("holes radial", "SELECT * FROM zp", "reticulum_zone, frame_id, peak_annulus, n_valid_annuli", _PROFILE_M, _ZGROUP + ", " + _profile("zp", "(SELECT reticulum_zone, frame_id, annulus_id, mean_descriptor AS v FROM zg)", "reticulum_zone, frame_id", "v")),
)
def _(spark, sf_dir):
    groups = radial.zone_groups(views.radial_rows(spark, sf_dir), radial.zones(views.holes(spark, sf_dir)))
    return radial.frame_profile(groups.select("reticulum_zone", "frame_id", "annulus_id", "mean_descriptor"), ["reticulum_zone", "frame_id"], "mean_descriptor")


_FITS = f"l AS (SELECT hole_id, frame_id, {_fit('annulus_id', 'descriptor_value')} FROM radial GROUP BY ALL), {_parabola('q', 'radial', 'hole_id, frame_id', 'annulus_id', 'descriptor_value')}, fits AS (SELECT l.hole_id, l.frame_id, n AS n_valid_annuli, slope AS linear_slope, intercept AS linear_intercept, {_r2('residual', 'total', '1e-12')} AS linear_r2, a AS quadratic_a, b AS quadratic_b, c AS quadratic_c, {_r2('qres', 'qtot', '1e-12')} AS quadratic_r2, CASE WHEN abs({_settled('a')}) > 1e-8 THEN -({_settled('b')}) / (2 * {_settled('a')}) END AS front_radius_quadratic FROM l LEFT JOIN q ON l.hole_id = q.hole_id AND l.frame_id = q.frame_id WHERE n >= 2)"


@query("radial_model_fits", sql("radial", "SELECT * FROM fits", "hole_id, frame_id, n_valid_annuli", "linear_slope linear_intercept linear_r2 quadratic_a quadratic_b quadratic_c quadratic_r2 front_radius_quadratic", _FITS))
def _(spark, sf_dir):
    return radial.model_fits(views.radial_rows(spark, sf_dir))


@query(
    "radial_model_summary",
    sql(
        "radial",
        "SELECT hole_id, avg(linear_slope) AS mean_linear_slope, avg(linear_r2) AS mean_linear_r2, avg(quadratic_r2) AS mean_quadratic_r2, count(quadratic_a) AS n_quadratic, count(*) AS n_frames FROM fits GROUP BY hole_id",
        "hole_id, n_quadratic, n_frames",
        "mean_linear_slope mean_linear_r2 mean_quadratic_r2",
        _FITS,
    ),
)
def _(spark, sf_dir):
    return radial.model_summary(radial.model_fits(views.radial_rows(spark, sf_dir)))


_ASYM = """sm AS (SELECT hole_id, frame_id, sector_id, avg(descriptor_value) AS m FROM sector GROUP BY ALL),
    sw AS (SELECT *, m - min(m) OVER (PARTITION BY hole_id, frame_id) + 1e-6 AS w, (sector_id + 0.5) * (2 * pi() / 4) AS th FROM sm),
    asym AS (SELECT hole_id, frame_id, count(m) AS n_valid_sectors, arg_max(sector_id, {'v': floor(m * 1e9 + 0.5), 'k': -sector_id}) FILTER (WHERE m IS NOT NULL) AS dominant_sector, stddev_pop(m) / (abs(avg(m)) + 1e-6) AS angular_asymmetry, max(m) - min(m) AS sector_contrast,
    sqrt(sum(w * cos(th)) ** 2 + sum(w * sin(th)) ** 2) / (sum(w) + 1e-6) AS vector_strength, max(m) FILTER (WHERE sector_id = 0) AS sector_0_mean, max(m) FILTER (WHERE sector_id = 1) AS sector_1_mean,
    max(m) FILTER (WHERE sector_id = 2) AS sector_2_mean, max(m) FILTER (WHERE sector_id = 3) AS sector_3_mean FROM sw GROUP BY ALL)"""
_ASYM_M = "angular_asymmetry sector_contrast vector_strength"


@query("angular_asymmetry", sql("sector", "SELECT * FROM asym", "hole_id, frame_id, n_valid_sectors, dominant_sector", _ASYM_M + " sector_0_mean sector_1_mean sector_2_mean sector_3_mean", _ASYM))
def _(spark, sf_dir):
    return radial.angular_asymmetry(views.sector_rows(spark, sf_dir))


for _key in ("hole_id", "frame_id"):

    @query(
        f"angular_asymmetry_by_{_key[:-3]}",
        sql("sector", f"SELECT {_key}, avg(angular_asymmetry) AS mean_angular_asymmetry, avg(sector_contrast) AS mean_sector_contrast, avg(vector_strength) AS mean_vector_strength, count(*) AS n, any_value(mo) AS dominant_sector_mode FROM asym LEFT JOIN (SELECT {_key} AS mk, arg_max(dominant_sector, {{'n': k, 's': -dominant_sector}}) AS mo FROM (SELECT {_key}, dominant_sector, count(*) AS k FROM asym WHERE dominant_sector IS NOT NULL GROUP BY ALL) GROUP BY ALL) ON mk = {_key} GROUP BY {_key}", f"{_key}, n, dominant_sector_mode", "mean_angular_asymmetry mean_sector_contrast mean_vector_strength", _ASYM),
    )
    def _(spark, sf_dir, key=_key):
        return radial.asymmetry_by(radial.angular_asymmetry(views.sector_rows(spark, sf_dir)), key)


# --- sectors -----------------------------------------------------------------------------------------------------------


def _sector_frames(spark, sf_dir):
    return sectors.frames(rdf.evolution(views.sector_rows(spark, sf_dir), True))


@query("sector_rdf_evolution", sql("sector", "SELECT * FROM sevo", "hole_id, frame_id, sector_id, annulus_id", _EVO_M, SEVO))
def _(spark, sf_dir):
    return rdf.evolution(views.sector_rows(spark, sf_dir), True).select("hole_id", "frame_id", "sector_id", "annulus_id", *_EVO_M.split())


@query("sector_rdf_frames", sql("sector", "SELECT * FROM sframes", "hole_id, frame_id, sector_id", "front total", SFRAMES))
def _(spark, sf_dir):
    return _sector_frames(spark, sf_dir)


_SFRONT = _profile("sp", "sector", "hole_id, frame_id, sector_id") + ", sfront AS (SELECT hole_id, frame_id, sector_id, center_of_mass_annulus AS sector_front_radius, peak_annulus AS sector_peak_annulus, n_valid_annuli FROM sp)"


@query("sector_fronts", sql("sector", "SELECT * FROM sfront", "hole_id, frame_id, sector_id, sector_peak_annulus, n_valid_annuli", "sector_front_radius", _SFRONT))
def _(spark, sf_dir):
    return sectors.fronts(views.sector_rows(spark, sf_dir))


@query(
    "sector_front_frames",
    sql(
        "sector",
        "SELECT hole_id, frame_id, avg(sector_front_radius) AS mean_sector_front_radius, stddev_pop(sector_front_radius) AS std_sector_front_radius, max(sector_front_radius) AS max_sector_front_radius, min(sector_front_radius) AS min_sector_front_radius, stddev_pop(sector_front_radius) / (abs(avg(sector_front_radius)) + 1e-6) AS front_anisotropy_ratio, count(*) AS n_valid_sectors FROM sfront GROUP BY ALL",
        "hole_id, frame_id, n_valid_sectors",
        "mean_sector_front_radius std_sector_front_radius max_sector_front_radius min_sector_front_radius front_anisotropy_ratio",
        _SFRONT,
    ),
)
def _(spark, sf_dir):
    return sectors.front_frames(sectors.fronts(views.sector_rows(spark, sf_dir)))


_LAGS = """lag0 AS (SELECT hole_id, sector_id, min(frame_id) FILTER (WHERE total > 0.01) AS sector_onset_frame, arg_max(frame_id, {'v': floor(front * 1e9 + 0.5), 'k': -frame_id}) FILTER (WHERE front IS NOT NULL) AS sector_peak_frame, max(front) AS sector_peak_front_radius_norm, avg(front) AS sector_mean_front_radius_norm, count(front) AS valid_frames FROM sframes GROUP BY ALL),
    lags AS (SELECT *, sector_onset_frame - min(sector_onset_frame) OVER (PARTITION BY hole_id) AS sector_onset_lag, sector_peak_frame - min(sector_peak_frame) OVER (PARTITION BY hole_id) AS sector_peak_lag FROM lag0)"""


@query("sector_front_lags", sql("sector", "SELECT * FROM lags", "hole_id, sector_id, sector_onset_frame, sector_onset_lag, sector_peak_frame, sector_peak_lag, valid_frames", "sector_peak_front_radius_norm sector_mean_front_radius_norm", SFRAMES + ", " + _LAGS))
def _(spark, sf_dir):
    return sectors.lags(_sector_frames(spark, sf_dir))


@query(
    "sector_front_lag_summary",
    sql(
        "sector",
        "SELECT hole_id, min(sector_onset_frame) AS min_sector_onset_frame, max(sector_onset_lag) AS max_sector_onset_lag, avg(sector_onset_lag) AS mean_sector_onset_lag, count(sector_onset_lag) / count(*) AS valid_onset_sector_fraction, min(sector_peak_frame) AS min_sector_peak_frame, max(sector_peak_lag) AS max_sector_peak_lag, avg(sector_peak_lag) AS mean_sector_peak_lag, count(sector_peak_lag) / count(*) AS valid_peak_sector_fraction FROM lags GROUP BY hole_id",
        "hole_id, min_sector_onset_frame, max_sector_onset_lag, min_sector_peak_frame, max_sector_peak_lag",
        "mean_sector_onset_lag valid_onset_sector_fraction mean_sector_peak_lag valid_peak_sector_fraction",
        SFRAMES + ", " + _LAGS,
    ),
)
def _(spark, sf_dir):
    return sectors.lag_summary(sectors.lags(_sector_frames(spark, sf_dir)))


_PROP = f"""prop0 AS (SELECT hole_id, sector_id, {_fit("frame_id", "front")}, min(frame_id) FILTER (WHERE total > 0.01) AS onset, arg_min(front, frame_id) AS s, arg_max(front, frame_id) AS e FROM (SELECT hole_id, sector_id, frame_id, front, total FROM sframes) GROUP BY ALL),
    prop AS (SELECT hole_id, sector_id, slope AS sector_front_velocity_per_frame, CASE WHEN slope IS NOT NULL THEN {_r2("residual", "total")} END AS sector_front_velocity_r2, onset AS sector_front_onset_frame, s AS sector_front_start_radius_norm, e AS sector_front_end_radius_norm, e - s AS sector_front_delta_radius_norm, n AS valid_frames FROM prop0)"""


@query("sector_propagation", sql("sector", "SELECT * FROM prop", "hole_id, sector_id, sector_front_onset_frame, valid_frames", "sector_front_velocity_per_frame sector_front_velocity_r2 sector_front_start_radius_norm sector_front_end_radius_norm sector_front_delta_radius_norm", SFRAMES + ", " + _PROP))
def _(spark, sf_dir):
    return sectors.propagation(_sector_frames(spark, sf_dir))


@query(
    "sector_propagation_summary",
    sql(
        "sector",
        """SELECT hole_id, (floor(stddev_pop(sector_front_velocity_per_frame) * 1e9 + 0.5) / 1e9) / greatest(abs(floor(avg(sector_front_velocity_per_frame) * 1e9 + 0.5) / 1e9), 1e-6) AS sector_front_velocity_anisotropy, avg(sector_front_velocity_per_frame) AS mean_sector_front_velocity_per_frame, stddev_pop(sector_front_velocity_per_frame) AS std_sector_front_velocity_per_frame, count(sector_front_velocity_per_frame) / count(*) AS valid_sector_velocity_fraction,
        max(sector_front_onset_frame) - min(sector_front_onset_frame) AS max_sector_onset_lag, avg(sector_front_onset_frame) - min(sector_front_onset_frame) AS mean_sector_onset_lag FROM prop GROUP BY hole_id""",
        "hole_id, max_sector_onset_lag",
        "sector_front_velocity_anisotropy mean_sector_front_velocity_per_frame std_sector_front_velocity_per_frame valid_sector_velocity_fraction mean_sector_onset_lag",
        SFRAMES + ", " + _PROP,
    ),
)
def _(spark, sf_dir):
    return sectors.propagation_summary(sectors.propagation(_sector_frames(spark, sf_dir)))


_ACC = f"l AS (SELECT hole_id, sector_id, {_fit('frame_id', 'front')} FROM (SELECT hole_id, sector_id, frame_id, front FROM sframes) GROUP BY ALL), {_parabola('q', '(SELECT hole_id, sector_id, frame_id, front FROM sframes)', 'hole_id, sector_id', 'frame_id', 'front')}, acc AS (SELECT q.hole_id, q.sector_id, n AS valid_frames, slope AS sector_front_linear_velocity_per_frame, {_r2('residual', 'total')} AS sector_front_linear_r2, a AS sector_front_quadratic_a, b AS sector_front_quadratic_b, c AS sector_front_quadratic_c, {_r2('qres', 'qtot')} AS sector_front_quadratic_r2, 2 * a AS sector_front_acceleration_per_frame2, a AS sector_front_curvature, ({_r2('qres', 'qtot')}) - ({_r2('residual', 'total')}) AS sector_front_nonlinearity_gain FROM q JOIN l ON l.hole_id = q.hole_id AND l.sector_id = q.sector_id)"
_ACC_M = "sector_front_linear_velocity_per_frame sector_front_linear_r2 sector_front_quadratic_a sector_front_quadratic_b sector_front_quadratic_c sector_front_quadratic_r2 sector_front_acceleration_per_frame2 sector_front_curvature sector_front_nonlinearity_gain"


@query("sector_acceleration", sql("sector", "SELECT * FROM acc", "hole_id, sector_id, valid_frames", _ACC_M, SFRAMES + ", " + _ACC))
def _(spark, sf_dir):
    return sectors.acceleration(_sector_frames(spark, sf_dir))


@query(
    "sector_acceleration_summary",
    sql(
        "sector",
        "SELECT hole_id, avg(sector_front_acceleration_per_frame2) AS mean_sector_front_acceleration_per_frame2, stddev_pop(sector_front_acceleration_per_frame2) AS sector_front_acceleration_spread, avg(abs(sector_front_curvature)) AS mean_abs_sector_front_curvature, avg(sector_front_nonlinearity_gain) AS mean_sector_front_nonlinearity_gain, CAST(count(*) / count(*) AS DOUBLE) AS valid_sector_acceleration_fraction, count(*) AS n_valid_sectors FROM acc GROUP BY hole_id",
        "hole_id, n_valid_sectors",
        "mean_sector_front_acceleration_per_frame2 sector_front_acceleration_spread mean_abs_sector_front_curvature mean_sector_front_nonlinearity_gain valid_sector_acceleration_fraction",
        SFRAMES + ", " + _ACC,
    ),
)
def _(spark, sf_dir):
    return sectors.acceleration_summary(sectors.acceleration(_sector_frames(spark, sf_dir)))


# --- hotspots ----------------------------------------------------------------------------------------------------------

_HSTATS = "hstats AS (SELECT nearest_hole_id AS hole_id, count(*) AS n_hotspots, avg(dist_to_hole_px) AS mean_hotspot_distance_px, min(dist_to_hole_px) AS min_hotspot_distance_px FROM hotspots WHERE nearest_hole_id >= 0 GROUP BY ALL)"
_BUCKET = "CASE WHEN min_hotspot_distance_px IS NULL THEN 'none' WHEN min_hotspot_distance_px <= 10 THEN 'near' WHEN min_hotspot_distance_px <= 24 THEN 'mid' ELSE 'far' END AS hotspot_proximity_bucket"


@query("hotspot_stats", sql("hotspots", "SELECT * FROM hstats", "hole_id, n_hotspots", "mean_hotspot_distance_px min_hotspot_distance_px", _HSTATS))
def _(spark, sf_dir):
    return hotspots.stats(views.hotspot_rows(spark, sf_dir))


_COMPARE = (
    PROFILE
    + ", hsum AS ("
    + _summary("hole_id", "profile")
    + "), "
    + _ZONES
    + ", "
    + _HSTATS
    + f", cmp AS (SELECT hsum.*, coalesce(reticulum_zone, 'unknown') AS reticulum_zone, coalesce(n_hotspots, 0) AS n_hotspots, mean_hotspot_distance_px, min_hotspot_distance_px, {_BUCKET} FROM hsum LEFT JOIN hstats USING (hole_id) LEFT JOIN zone USING (hole_id))"
)


def _compared(spark, sf_dir):
    return hotspots.compare(_hole_summary(spark, sf_dir), views.hotspot_rows(spark, sf_dir), radial.zones(views.holes(spark, sf_dir)))


@query(
    "hotspot_reticulum",
    sql("radial holes hotspots", "SELECT * FROM cmp", "hole_id, reticulum_zone, radial_conclusion_label, n_hotspots, hotspot_proximity_bucket", "delta_center_of_mass mean_inner_minus_outer mean_hotspot_distance_px min_hotspot_distance_px", _COMPARE),
)
def _(spark, sf_dir):
    cols = "hole_id reticulum_zone radial_conclusion_label n_hotspots hotspot_proximity_bucket delta_center_of_mass mean_inner_minus_outer mean_hotspot_distance_px min_hotspot_distance_px"
    return _compared(spark, sf_dir).select(*cols.split())


@query(
    "hotspot_reticulum_groups",
    sql(
        "radial holes hotspots",
        "SELECT reticulum_zone, hotspot_proximity_bucket, count(*) AS n_holes, avg(n_hotspots) AS mean_n_hotspots, avg(mean_hotspot_distance_px) AS mean_distance, avg(delta_center_of_mass) AS group_delta_center_of_mass FROM cmp GROUP BY ALL",
        "reticulum_zone, hotspot_proximity_bucket, n_holes",
        "mean_n_hotspots mean_distance group_delta_center_of_mass",
        _COMPARE,
    ),
)
def _(spark, sf_dir):
    return hotspots.compare_groups(_compared(spark, sf_dir), ["delta_center_of_mass"])


@query(
    "hotspot_tracks",
    sql(
        "hotspots",
        """SELECT track_id, min(f0) AS first_frame, max(f1) AS last_frame, max(f1) - min(f0) + 1 AS duration_frames, CAST(sum(area) AS DOUBLE) / CAST(100 * sum(n) AS DOUBLE) AS mean_area, CAST(sum(sc) AS DOUBLE) / CAST(100 * sum(n) AS DOUBLE) AS mean_score,
        CAST(sum(di) AS DOUBLE) / CAST(100 * sum(n) AS DOUBLE) AS mean_dist, arg_min(nearest_hole_id, {'n': -n, 'f': f0, 'h': h0}) AS most_common_hole FROM (
        SELECT track_id, nearest_hole_id, count(*) AS n, min(frame_id) AS f0, max(frame_id) AS f1, arg_min(hotspot_id, {'f': frame_id, 'h': hotspot_id}) AS h0, sum(CAST(round(area_px * 100) AS BIGINT)) AS area, sum(CAST(round(score * 100) AS BIGINT)) AS sc, sum(CAST(round(dist_to_hole_px * 100) AS BIGINT)) AS di FROM hotspots GROUP BY ALL) GROUP BY track_id""",
        "track_id, first_frame, last_frame, duration_frames, most_common_hole",
        "mean_area mean_score mean_dist",
    ),
)
def _(spark, sf_dir):
    return hotspots.tracks(views.hotspot_rows(spark, sf_dir))


@query("hotspots_per_frame", sql("hotspots", "SELECT *, lag(n_hotspots) OVER (ORDER BY frame_id) AS n_before FROM (SELECT frame_id, count(*) AS n_hotspots FROM hotspots GROUP BY ALL)", "frame_id, n_hotspots, n_before"))
def _(spark, sf_dir):
    return hotspots.per_frame(views.hotspot_rows(spark, sf_dir))


_POINTS = "pts AS (SELECT event_id, CAST(100 + (event_id * 37) % 360 AS DOUBLE) AS x, CAST(100 + (event_id * 91) % 400 AS DOUBLE) AS y FROM events)"


def _points(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id", (100 + F.col("event_id") * 37 % 360).cast("double").alias("x"), (100 + F.col("event_id") * 91 % 400).cast("double").alias("y")
    )


@query(
    "nearest_hole",
    sql(
        "holes",
        "SELECT p.event_id, p.x, p.y, arg_min(h.hole_id, {'d': sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2), 'h': h.hole_id}) AS nearest_hole_id, min(sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2)) AS dist_to_hole_px FROM pts p, holes h GROUP BY ALL",
        "event_id, nearest_hole_id",
        "x y dist_to_hole_px",
        _POINTS,
    ),
)
def _(spark, sf_dir):
    return hotspots.nearest_hole(_points(spark, sf_dir), views.holes(spark, sf_dir))


def _regions(spark, sf_dir):
    points = _points(spark, sf_dir)
    return points.select((F.col("event_id") % 40).cast("int").alias("frame_id"), F.col("event_id").alias("region_id"), "x", "y")


@query(
    "linked_regions",
    sql(
        "",
        "SELECT a.frame_id, a.region_id, a.x, a.y, arg_min(b.region_id, {'d': sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 'p': b.region_id}) AS prev_region_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS distance FROM regions a LEFT JOIN regions b ON a.frame_id = b.frame_id + 1 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 30 GROUP BY ALL",
        "frame_id, region_id, prev_region_id",
        "x y distance",
        _POINTS + ", regions AS (SELECT CAST(event_id % 40 AS INTEGER) AS frame_id, event_id AS region_id, x, y FROM pts)",
    ),
)
def _(spark, sf_dir):
    return hotspots.link_nearest(_regions(spark, sf_dir), 30.0)


def _placed_hotspots(spark, sf_dir):
    """Hotspots with stand-in places; every seventh has no hole."""
    place = {"x": F.col("hotspot_id") % 60 + 0.0, "y": F.col("hotspot_id") % 47 + 0.0, "nearest_hole_id": F.when(F.col("hotspot_id") % 7 > 0, F.col("nearest_hole_id"))}
    return views.hotspot_rows(spark, sf_dir).withColumns(place)


# A walk over each frame's candidates by ascending cost, step by step.
_LINKS = f"""hs AS (SELECT * REPLACE (CASE WHEN hotspot_id % 7 > 0 THEN nearest_hole_id END AS nearest_hole_id), CAST(hotspot_id % 60 AS DOUBLE) AS x, CAST(hotspot_id % 47 AS DOUBLE) AS y FROM hotspots),
    lc0 AS (SELECT b.frame_id, a.hotspot_id AS p, b.hotspot_id AS h, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, greatest(a.area_px, b.area_px) / greatest(least(a.area_px, b.area_px), 1.0) AS r, abs(a.score - b.score) AS s
      FROM hs a JOIN hs b ON b.frame_id = a.frame_id + 1 WHERE a.nearest_hole_id IS NULL OR b.nearest_hole_id IS NULL OR a.nearest_hole_id = b.nearest_hole_id),
    lc AS (SELECT frame_id, p, h, {_settled("(d + 0.5 * r + 0.25 * s)")} AS c FROM lc0 WHERE d <= 18 AND r <= 3),
    lo AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY c, p, h) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM lc),
    lw AS (SELECT frame_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS hh, max(n) AS n FROM lo GROUP BY frame_id UNION ALL
      SELECT w.frame_id, o.k, CASE WHEN list_contains(ps, p) OR list_contains(hh, h) THEN ps ELSE list_append(ps, p) END, CASE WHEN list_contains(ps, p) OR list_contains(hh, h) THEN hh ELSE list_append(hh, h) END, w.n FROM lw w JOIN lo o ON o.frame_id = w.frame_id AND o.k = w.k + 1),
    lk AS (SELECT u.frame_id, u.p AS prev_hotspot_id, u.h AS hotspot_id, lc.c AS cost FROM (SELECT frame_id, unnest(ps) AS p, unnest(hh) AS h FROM lw WHERE k = n) u JOIN lc USING (frame_id, p, h))"""


def _links(spark, sf_dir):
    return hotspots.link_greedy(_placed_hotspots(spark, sf_dir), 18.0)


@query("linked_hotspots", recursive(sql("hotspots", "SELECT * FROM lk", "frame_id, prev_hotspot_id, hotspot_id", "cost", _LINKS)))
def _(spark, sf_dir):
    return _links(spark, sf_dir)


_TRACKS = _LINKS + """, tk AS (SELECT frame_id, hotspot_id, frame_id AS hf, hotspot_id AS hh FROM hs ANTI JOIN lk USING (frame_id, hotspot_id)
      UNION ALL SELECT lk.frame_id, lk.hotspot_id, tk.hf, tk.hh FROM tk JOIN lk ON lk.frame_id = tk.frame_id + 1 AND lk.prev_hotspot_id = tk.hotspot_id)"""


@query("linked_tracks", recursive(sql("hotspots", "SELECT frame_id, hotspot_id, dense_rank() OVER (ORDER BY hf, hh) - 1 AS track_id FROM tk", "frame_id, hotspot_id, track_id", "", _TRACKS)))
def _(spark, sf_dir):
    return hotspots.track_ids(_placed_hotspots(spark, sf_dir), _links(spark, sf_dir))


# --- events of series --------------------------------------------------------------------------------------------------


def _events(name: str, source: str, keys: str) -> str:
    w, b = f"PARTITION BY {keys}", f"PARTITION BY {keys} ORDER BY pos"
    smooth = lambda v: f"CASE WHEN n < 3 THEN {v} ELSE (coalesce(lag({v}) OVER ({b}), {v}) + {v} + coalesce(lead({v}) OVER ({b}), {v})) / 3 END"
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY frame_id) - 1 AS pos, count(*) OVER ({w}) AS n FROM {source}),
    {name}1 AS (SELECT *, {smooth("value")} AS s FROM {name}0), {name}2 AS (SELECT *, {smooth("s")} AS s2 FROM {name}1),
    {name}3 AS (SELECT *, median(s2) FILTER (WHERE pos < greatest(3, n // 5)) OVER ({w}) AS mu, median(s) FILTER (WHERE pos < greatest(3, n // 5)) OVER ({w}) AS baseline_value FROM {name}2),
    {name}4 AS (SELECT *, median(abs(s2 - mu)) FILTER (WHERE pos < greatest(3, n // 5)) OVER ({w}) AS mad FROM {name}3),
    {name}5 AS (SELECT *, coalesce(s2 > mu + 2.0 * greatest(1.4826 * mad, 1e-6), false) AS above FROM {name}4),
    {name}6 AS (SELECT *, above AND coalesce(lead(above) OVER ({b}), false) AS starts FROM {name}5),
    {name}7 AS (SELECT *, min(pos) FILTER (WHERE starts) OVER ({w}) AS onset, first_value(pos) OVER (PARTITION BY {keys} ORDER BY s2 DESC NULLS LAST, pos) AS peak FROM {name}6),
    {name}8 AS (SELECT *, max(s) FILTER (WHERE pos = peak) OVER ({w}) AS peak_value FROM {name}7),
    {name}9 AS (SELECT *, s >= baseline_value + 0.5 * (peak_value - baseline_value) AS high FROM {name}8),
    {name} AS (SELECT {keys}, any_value(onset) AS onset_pos, any_value(peak) AS peak_pos, min(pos) FILTER (WHERE high) AS halfmax_pos, any_value(peak_value) AS peak_value,
      max(pos) FILTER (WHERE high AND pos >= onset) - min(pos) FILTER (WHERE high AND pos >= onset) + 1 AS duration_frames, any_value(baseline_value) AS baseline_value,
      max(frame_id) FILTER (WHERE pos = onset) AS onset_frame_id, max(frame_id) FILTER (WHERE pos = peak) AS peak_frame_id FROM {name}9 GROUP BY {keys})"""


_EV_K = "CAST(onset_pos AS INTEGER) AS onset_pos, CAST(peak_pos AS INTEGER) AS peak_pos, CAST(halfmax_pos AS INTEGER) AS halfmax_pos, CAST(duration_frames AS INTEGER) AS duration_frames, onset_frame_id, peak_frame_id"


@query("curve_events", sql("series", "SELECT * FROM ev", "entity_id, " + _EV_K, "peak_value baseline_value", _events("ev", "series", "entity_id")))
def _(spark, sf_dir):
    return events.curve_events(views.series(spark, sf_dir), ["entity_id"])


def _radial_events(spark, sf_dir):
    return events.curve_events(views.radial_rows(spark, sf_dir).withColumnRenamed("descriptor_value", "value"), ["hole_id", "annulus_id"])


_REV = _events("ev", "(SELECT hole_id, annulus_id, frame_id, descriptor_value AS value FROM radial)", "hole_id, annulus_id")


@query("annulus_events", sql("radial", "SELECT * FROM ev", "hole_id, annulus_id, " + _EV_K, "peak_value baseline_value", _REV))
def _(spark, sf_dir):
    return _radial_events(spark, sf_dir)


def _lag_part(name: str) -> str:
    p = f"{name}_pos"
    return f"""CASE WHEN count({p}) >= 2 THEN arg_max({p}, annulus_id) - arg_min({p}, annulus_id) END AS {name}_lag_frames, count({p}) AS n_valid_annuli_{name},
    CASE WHEN count({p}) = 0 THEN 0.0 WHEN count({p}) = 1 THEN 1.0 ELSE avg(CAST({p} - {name}_before >= 0 AS DOUBLE)) FILTER (WHERE {p} IS NOT NULL) END AS {name}_monotonic_fraction"""


_LAGSUM = f"""evb AS (SELECT *, last_value(onset_pos IGNORE NULLS) OVER w AS onset_before, last_value(peak_pos IGNORE NULLS) OVER w AS peak_before FROM ev WINDOW w AS (PARTITION BY hole_id ORDER BY annulus_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ls AS (SELECT hole_id, {_lag_part("onset")}, {_lag_part("peak")} FROM evb GROUP BY hole_id)"""
_LAG_K = "hole_id, CAST(onset_lag_frames AS INTEGER) AS onset_lag_frames, CAST(peak_lag_frames AS INTEGER) AS peak_lag_frames, n_valid_annuli_onset, n_valid_annuli_peak"


@query("event_lag_summary", sql("radial", "SELECT * FROM ls", _LAG_K, "onset_monotonic_fraction peak_monotonic_fraction", _REV + ", " + _LAGSUM))
def _(spark, sf_dir):
    return events.lag_summary(_radial_events(spark, sf_dir))


def _pf(name: str) -> str:
    return f"{name}_lag_frames / CAST(greatest(n_valid_annuli_{name} - 1, 1) AS DOUBLE) AS {name}_slope_per_annulus, n_valid_annuli_{name} >= 2 AND {name}_monotonic_fraction = 1.0 AS monotonic_{name}"


_FEAT = f"pf AS (SELECT *, {_pf('onset')}, {_pf('peak')}, coalesce(onset_lag_frames < 0, false) OR coalesce(peak_lag_frames < 0, false) AS negative_lag_flag FROM ls)"


@query(
    "propagation_features",
    sql("radial", "SELECT * FROM pf", _LAG_K + ", monotonic_onset, monotonic_peak, negative_lag_flag", "onset_monotonic_fraction peak_monotonic_fraction onset_slope_per_annulus peak_slope_per_annulus", f"{_REV}, {_LAGSUM}, {_FEAT}"),
)
def _(spark, sf_dir):
    return events.propagation_features(events.lag_summary(_radial_events(spark, sf_dir)))


@query(
    "temporal_validation",
    sql(
        "radial",
        """SELECT count(*) AS n_holes, avg(CAST(n_valid_annuli_onset >= 2 AS DOUBLE)) AS valid_onset_fraction, avg(CAST(n_valid_annuli_peak >= 2 AS DOUBLE)) AS valid_peak_fraction, avg(CAST(monotonic_onset AS DOUBLE)) AS monotonic_onset_fraction,
        avg(CAST(monotonic_peak AS DOUBLE)) AS monotonic_peak_fraction, avg(CAST(negative_lag_flag AS DOUBLE)) AS negative_lag_fraction FROM pf""",
        "n_holes",
        "valid_onset_fraction valid_peak_fraction monotonic_onset_fraction monotonic_peak_fraction negative_lag_fraction",
        f"{_REV}, {_LAGSUM}, {_FEAT}",
    ),
)
def _(spark, sf_dir):
    return events.validation(events.propagation_features(events.lag_summary(_radial_events(spark, sf_dir))))


def _propagation(spark, sf_dir):
    return events.propagation_features(events.lag_summary(_radial_events(spark, sf_dir)))


_PHENOTYPES = f"""{_REV}, {_LAGSUM}, {_FEAT}, {_kmeans("kp", "pf", phenotypes.FEATURES, 3)}, ph AS (SELECT * FROM pf JOIN kp USING (hole_id)),
    ps AS (SELECT cluster_id, {", ".join(f"{_settled(f'avg({f})')} AS {f}" for f in phenotypes.FEATURES[:3])} FROM ph GROUP BY cluster_id),
    pl AS (SELECT *, CASE WHEN onset_slope_per_annulus >= 0.5 AND peak_slope_per_annulus >= 0.5 AND onset_monotonic_fraction >= 0.75 THEN 'outward_propagating' WHEN abs(onset_slope_per_annulus) < 0.35 AND abs(peak_slope_per_annulus) < 0.35 THEN 'near_synchronous' WHEN onset_slope_per_annulus < 0 THEN 'outer_first' ELSE 'irregular' END AS semantic_label FROM ps),
    pn AS (SELECT cluster_id, semantic_label, CAST(row_number() OVER (ORDER BY list_position(['outward_propagating', 'near_synchronous', 'outer_first', 'irregular'], semantic_label), onset_slope_per_annulus NULLS LAST, peak_slope_per_annulus NULLS LAST, onset_monotonic_fraction DESC NULLS LAST, cluster_id) AS INTEGER) AS canonical_id FROM pl),
    phenotyped AS (SELECT ph.*, semantic_label, canonical_id, 'P' || canonical_id || '_' || semantic_label AS canonical_label, 'P' || canonical_id || '_' || semantic_label AS phenotype_label FROM ph JOIN pn USING (cluster_id))"""


@query("hole_phenotypes", recursive(sql("radial", "SELECT * FROM phenotyped", _LAG_K + ", monotonic_onset, monotonic_peak, negative_lag_flag, cluster_id, semantic_label, canonical_id, canonical_label, phenotype_label", "onset_monotonic_fraction peak_monotonic_fraction onset_slope_per_annulus peak_slope_per_annulus", _PHENOTYPES)))
def _(spark, sf_dir):
    return phenotypes.assign(_propagation(spark, sf_dir))


@query("phenotype_stability")
def _(spark, sf_dir):
    return phenotypes.stability(_propagation(spark, sf_dir))


_PHENO = f"""{_REV}, {_LAGSUM}, {_FEAT}, {_ZONES}, pz AS (SELECT reticulum_zone, count(*) AS count, {", ".join(f"{_settled(f'avg({f})')} AS {f}" for f in phenotypes.FEATURES)} FROM pf JOIN zone USING (hole_id) GROUP BY reticulum_zone),
    pm AS (SELECT *, CASE WHEN onset_slope_per_annulus >= 0.5 AND peak_slope_per_annulus >= 0.5 AND onset_monotonic_fraction >= 0.75 THEN 'outward_propagating' WHEN abs(onset_slope_per_annulus) < 0.35 AND abs(peak_slope_per_annulus) < 0.35 THEN 'near_synchronous' WHEN onset_slope_per_annulus < 0 THEN 'outer_first' ELSE 'irregular' END AS label FROM pz),
    pc AS (SELECT *, CAST(row_number() OVER (ORDER BY list_position(['outward_propagating', 'near_synchronous', 'outer_first', 'irregular'], label), onset_slope_per_annulus NULLS LAST, peak_slope_per_annulus NULLS LAST, onset_monotonic_fraction DESC NULLS LAST, reticulum_zone) AS INTEGER) AS canonical_id FROM pm)"""


@query("phenotype_semantics", sql("radial holes", "SELECT *, 'P' || canonical_id || '_' || label AS canonical_label FROM pc", "reticulum_zone, count, label, canonical_id, canonical_label", " ".join(phenotypes.FEATURES), _PHENO))
def _(spark, sf_dir):
    """Zones of the reticulum as clusters, so that SQL can state them."""
    return phenotypes.named(_propagation(spark, sf_dir).join(radial.zones(views.holes(spark, sf_dir)), "hole_id"), "reticulum_zone")


# --- lattice -----------------------------------------------------------------------------------------------------------

_LABELLED = _PHENOTYPES + ", labelled AS (SELECT h.hole_id, h.lattice_u, h.lattice_v, phenotype_label AS label FROM phenotyped JOIN holes h USING (hole_id))"


def _labelled(spark, sf_dir):
    """Holes with their phenotypes, written once."""
    labels = phenotypes.assign(_propagation(spark, sf_dir)).select("hole_id", F.col("phenotype_label").alias("label"))
    return checkpointed(views.holes(spark, sf_dir).select("hole_id", "lattice_u", "lattice_v").join(labels, "hole_id"))


@query(
    "phenotype_neighbors",
    recursive(sql("radial holes", "SELECT a.hole_id AS hole_id_a, b.hole_id AS hole_id_b, a.label AS label_a, b.label AS label_b, a.label = b.label AS same_label FROM labelled a JOIN labelled b ON abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v) = 1 AND (a.lattice_u, a.lattice_v) < (b.lattice_u, b.lattice_v)", "hole_id_a, hole_id_b, label_a, label_b, same_label", "", _LABELLED)),
)
def _(spark, sf_dir):
    return lattice.neighbour_pairs(_labelled(spark, sf_dir))


@query(
    "phenotype_smoothness",
    recursive(sql(
        "radial holes",
        """SELECT a.hole_id, any_value(a.label) AS label, sum(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END / (abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v))) / sum(1.0 / (abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v))) AS spatial_smoothness, count(b.hole_id) AS neighbor_count
        FROM labelled a LEFT JOIN labelled b ON abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v) BETWEEN 1 AND 2 GROUP BY a.hole_id""",
        "hole_id, label, neighbor_count",
        "spatial_smoothness",
        _LABELLED,
    )),
)
def _(spark, sf_dir):
    return lattice.smoothness(_labelled(spark, sf_dir))


@query("phenotype_counts", recursive(sql("radial holes", "SELECT label, count(*) AS n FROM labelled GROUP BY label", "label, n", "", _LABELLED)))
def _(spark, sf_dir):
    return reshape.count_by(_labelled(spark, sf_dir), "label")


@query(
    "phenotype_archetypes",
    recursive(sql("radial holes", "SELECT label, frame_id, annulus_id, avg(descriptor_value) AS mean_descriptor, stddev_pop(descriptor_value) AS std_descriptor, count(descriptor_value) AS n_holes FROM radial JOIN labelled USING (hole_id) GROUP BY ALL", "label, frame_id, annulus_id, n_holes", "mean_descriptor std_descriptor", _LABELLED)),
)
def _(spark, sf_dir):
    rows = views.radial_rows(spark, sf_dir).join(_labelled(spark, sf_dir).select("hole_id", "label"), "hole_id")
    return radial.aggregate(rows, ["label", "frame_id", "annulus_id"])


def _plane(z: str) -> str:
    det = "(regr_sxx(u, u) * regr_sxx(v, v) - regr_sxy(u, v) ** 2)"
    a = f"(regr_sxy({z}, u) * regr_sxx(v, v) - regr_sxy({z}, v) * regr_sxy(u, v)) / nullif({det}, 0)"
    b = f"(regr_sxy({z}, v) * regr_sxx(u, u) - regr_sxy({z}, u) * regr_sxy(u, v)) / nullif({det}, 0)"
    return f"{a} AS a_{z}, {b} AS b_{z}, avg({z}) - ({a}) * avg(u) - ({b}) * avg(v) AS origin_{z}"


@query("lattice_least_squares", sql("holes", f"SELECT {_plane('x')}, {_plane('y')}, count(*) AS n_holes FROM (SELECT x, y, CAST(lattice_u AS DOUBLE) AS u, CAST(lattice_v AS DOUBLE) AS v FROM holes)", "n_holes", "origin_x origin_y a_x a_y b_x b_y"))
def _(spark, sf_dir):
    return lattice.least_squares(views.holes(spark, sf_dir))


_PLAN = """gap AS (SELECT a.hole_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px) AS own FROM holes a JOIN holes b ON abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v) = 1 GROUP BY a.hole_id),
    tplan AS (SELECT hole_id, radius_outer_px, greatest(coalesce(own, (SELECT min(own) FROM gap)), 0.0) AS gap_px FROM holes LEFT JOIN gap USING (hole_id)),
    plan AS (SELECT hole_id, gap_px, greatest(gap_px / 2 / 8, 1.0) AS terrace_width_px, radius_outer_px + 8 * greatest(gap_px / 2 / 8, 1.0) AS terrace_outer_radius_px FROM tplan)"""


@query("terrace_plan", sql("holes", "SELECT * FROM plan", "hole_id", "gap_px terrace_width_px terrace_outer_radius_px", _PLAN))
def _(spark, sf_dir):
    return lattice.terrace_plan(views.holes(spark, sf_dir))


@query(
    "terrace_annuli",
    sql("holes", "SELECT hole_id, CAST(k AS INTEGER) AS annulus_id, terrace_outer_radius_px - 8 * terrace_width_px + k * terrace_width_px AS r_inner_px, terrace_outer_radius_px - 8 * terrace_width_px + (k + 1) * terrace_width_px AS r_outer_px FROM plan, range(8) t(k)", "hole_id, annulus_id", "r_inner_px r_outer_px", _PLAN),
)
def _(spark, sf_dir):
    return lattice.terrace_annuli(lattice.terrace_plan(views.holes(spark, sf_dir)))


@query(
    "buffer_relations",
    sql("holes", "SELECT hole_id, d AS center_distance_px, CASE WHEN d + r <= 200.5 THEN 'inside' WHEN d - r >= 199.5 THEN 'outside' ELSE 'intersects' END AS relation FROM (SELECT hole_id, sqrt((x - 280) ** 2 + (y - 280) ** 2) AS d, radius_outer_px AS r FROM holes)", "hole_id, relation", "center_distance_px"),
)
def _(spark, sf_dir):
    return lattice.relation(views.holes(spark, sf_dir), 280.0, 280.0, 200.0)


_EXCL = """ex0 AS (SELECT hole_id, x - r < 0 OR x + r > 460 OR y - r < 0 OR y + r > 460 AS hole_outside_frame, x - o < 0 OR x + o > 460 OR y - o < 0 OR y + o > 460 AS terrace_outside_frame, sqrt((x - 280) ** 2 + (y - 280) ** 2) + o > 220 AS terrace_outside_circle FROM (SELECT *, radius_outer_px AS r, radius_outer_px + 12 AS o FROM holes)),
    ex AS (SELECT *, concat_ws(';', CASE WHEN hole_outside_frame THEN 'hole_outside_frame' END, CASE WHEN terrace_outside_frame THEN 'terrace_outside_frame' END, CASE WHEN terrace_outside_circle THEN 'terrace_outside_circle' END) AS reasons FROM ex0)"""


def _excluded(spark, sf_dir):
    return lattice.exclusions(views.holes(spark, sf_dir), 460.0, 460.0, 12.0, 280.0, 280.0, 220.0)


@query("completeness", sql("holes", "SELECT *, reasons = '' AS is_complete FROM ex", "hole_id, hole_outside_frame, terrace_outside_frame, terrace_outside_circle, reasons, is_complete", "", _EXCL))
def _(spark, sf_dir):
    return _excluded(spark, sf_dir)


@query("completeness_reasons", sql("holes", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM ex WHERE reasons <> '') GROUP BY reason", "reason, n", "", _EXCL))
def _(spark, sf_dir):
    return lattice.reason_counts(_excluded(spark, sf_dir))


def _tiered(spark, sf_dir):
    return views.holes(spark, sf_dir).withColumn("tier", (F.col("hole_id") % 4 + 1).cast("int"))


for _name, _radius in (("chosen_holes", 200.0), ("chosen_holes_fallback", -100.0)):

    @query(
        _name,
        sql(
            "holes",
            "SELECT hole_id, tier, relation, NOT found AS fallback FROM (SELECT *, bool_or(relation = 'inside') OVER () AS found FROM ct) WHERE relation = 'inside' OR NOT found",
            "hole_id, tier, relation, fallback",
            "",
            f"ct AS (SELECT hole_id, tier, CASE WHEN d + r <= {_radius + 0.5} THEN 'inside' WHEN d - r >= {_radius - 0.5} THEN 'outside' ELSE 'intersects' END AS relation FROM (SELECT hole_id, CAST(hole_id % 4 + 1 AS INTEGER) AS tier, sqrt((x - 280) ** 2 + (y - 280) ** 2) AS d, radius_outer_px AS r FROM holes) WHERE tier <= 3)",
        ),
    )
    def _(spark, sf_dir, radius=_radius):
        """The second circle holds no hole, so that all of the tiers come back, flagged."""
        return lattice.chosen(_tiered(spark, sf_dir), lattice.relation(views.holes(spark, sf_dir), 280.0, 280.0, radius)).select("hole_id", "tier", "relation", "fallback")


@query("hole_variants", sql("holes", "SELECT hole_id, v AS variant, greatest(radius_inner_px + v * (radius_outer_px * 0.05), 1.0) AS radius_inner_px, greatest(radius_outer_px + v * (radius_outer_px * 0.05), 1.0) AS radius_outer_px FROM holes, (VALUES (-1), (1)) t(v)", "hole_id, variant", "radius_inner_px radius_outer_px"))
def _(spark, sf_dir):
    return lattice.variants(views.holes(spark, sf_dir)).select("hole_id", "variant", "radius_inner_px", "radius_outer_px")


@query(
    "lattice_places",
    sql(
        "holes",
        "SELECT hole_id, CAST(round_even(round(((x - origin_x) * b_y - (y - origin_y) * b_x) / (a_x * b_y - a_y * b_x), 6), 0) AS INTEGER) AS assigned_u, CAST(round_even(round(((y - origin_y) * a_x - (x - origin_x) * a_y) / (a_x * b_y - a_y * b_x), 6), 0) AS INTEGER) AS assigned_v FROM holes, lsq",
        "hole_id, assigned_u, assigned_v",
        "",
        f"lsq AS (SELECT {_plane('x')}, {_plane('y')} FROM (SELECT x, y, CAST(lattice_u AS DOUBLE) AS u, CAST(lattice_v AS DOUBLE) AS v FROM holes))",
    ),
)
def _(spark, sf_dir):
    rows = views.holes(spark, sf_dir)
    return lattice.assigned(rows, lattice.least_squares(rows)).select("hole_id", "assigned_u", "assigned_v")


def _pass(i: int) -> str:
    """A pass of the fixed point in SQL: plan on those left, then drop what does not fit."""
    gone = "x - radius_outer_px < 0 OR x + radius_outer_px > 470 OR y - radius_outer_px < 0 OR y + radius_outer_px > 470", "x - e < 0 OR x + e > 470 OR y - e < 0 OR y + e > 470", "sqrt((x - 280) ** 2 + (y - 280) ** 2) + e > 220"
    reasons = ", ".join(f"CASE WHEN {g} THEN '{n}' END" for g, n in zip(gone, ("hole_outside_frame", "terrace_outside_frame", "terrace_outside_circle"), strict=True))
    return f"""g{i} AS (SELECT a.hole_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px) AS own FROM left{i - 1} a JOIN left{i - 1} b ON abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v) = 1 GROUP BY a.hole_id),
    p{i} AS (SELECT h.*, radius_outer_px + (radius_outer_px + 8 * greatest(greatest(coalesce(own, (SELECT min(own) FROM g{i})), 0.0) / 2 / 8, 1.0) - radius_outer_px) AS e FROM left{i - 1} h LEFT JOIN g{i} USING (hole_id)),
    r{i} AS (SELECT *, concat_ws(';', {reasons}) AS reasons FROM p{i}), left{i} AS (SELECT * EXCLUDE (e, reasons) FROM r{i} WHERE reasons = '')"""


_PASSES = 6


@query(
    "complete_holes",
    sql(
        "holes",
        f"SELECT hole_id, CAST(row_number() OVER (ORDER BY hole_id) - 1 AS INTEGER) AS new_hole_id, 'kept' AS status, '' AS reasons, CAST(NULL AS INTEGER) AS exclusion_iteration FROM left{_PASSES} "
        + " ".join(f"UNION ALL SELECT hole_id, NULL, 'excluded', reasons, {i} FROM r{i} WHERE reasons <> ''" for i in range(1, _PASSES + 1)),
        "hole_id, new_hole_id, status, reasons, exclusion_iteration",
        "",
        "left0 AS (SELECT * FROM holes), " + ", ".join(_pass(i) for i in range(1, _PASSES + 1)),
    ),
)
def _(spark, sf_dir):
    return lattice.complete(views.holes(spark, sf_dir), 470.0, 470.0, 280.0, 280.0, 220.0)


_GEO = "geo AS (SELECT hole_id, frame_id, x + k % 5 AS x, y + k % 3 AS y, radius_outer_px + (k % 2) / 2 AS radius_outer_px FROM (SELECT hole_id, frame_id, count(*) AS k FROM radial GROUP BY ALL) JOIN holes USING (hole_id))"


def _hole_frames(spark, sf_dir):
    """Holes in the frames where they are measured; the number of measures stands in for drift."""
    seen = views.radial_rows(spark, sf_dir).groupBy("hole_id", "frame_id").agg(F.count(F.lit(1)).alias("_k"))
    return seen.join(views.holes(spark, sf_dir), "hole_id").select("hole_id", "frame_id", (F.col("x") + F.col("_k") % 5).alias("x"), (F.col("y") + F.col("_k") % 3).alias("y"), (F.col("radius_outer_px") + (F.col("_k") % 2) / 2).alias("radius_outer_px"))


def _smooth(c: str) -> str:
    return f"(sum({c}) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(3 - k, 0) * first_value({c}) OVER a + greatest(2 - n + k, 0) * last_value({c}) OVER a) / 5 AS {c}"


@query("geometry_frames", sql("radial holes", "SELECT * FROM geo", "hole_id, frame_id", "x y radius_outer_px", _GEO))
def _(spark, sf_dir):
    return _hole_frames(spark, sf_dir)


@query(
    "smoothed_geometry",
    sql(
        "radial holes",
        f"SELECT hole_id, frame_id, {_smooth('x')}, {_smooth('y')}, {_smooth('radius_outer_px')} FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY frame_id) AS k, count(*) OVER (PARTITION BY hole_id) AS n FROM geo) WINDOW w AS (PARTITION BY hole_id ORDER BY frame_id), a AS (PARTITION BY hole_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        "hole_id, frame_id",
        "x y radius_outer_px",
        _GEO,
    ),
)
def _(spark, sf_dir):
    return reshape.smoothed(_hole_frames(spark, sf_dir), ["hole_id"], "frame_id", ["x", "y", "radius_outer_px"], 5)


# --- cluster activity --------------------------------------------------------------------------------------------------


def _pooled(name: str, keys: str) -> str:
    return f"{name} AS (SELECT *, pixel_count / greatest(n_valid_pixels, 1) AS pixel_fraction FROM (SELECT {keys}, cluster_id, CAST(sum(pixel_count) AS BIGINT) AS pixel_count, CAST(sum(sum(pixel_count)) OVER (PARTITION BY {keys}) AS BIGINT) AS n_valid_pixels FROM tensor GROUP BY {keys}, cluster_id))"


@query("cluster_tensor", sql("tensor", "SELECT * FROM tensor", "frame_id, hole_id, terrace_index, sector_id, cluster_id, pixel_count"))
def _(spark, sf_dir):
    return views.cluster_tensor(spark, sf_dir)


@query("cluster_fractions", sql("tensor", "SELECT * FROM po", "frame_id, terrace_index, cluster_id, pixel_count, n_valid_pixels", "pixel_fraction", _pooled("po", "frame_id, terrace_index")))
def _(spark, sf_dir):
    return activity.pooled(views.cluster_tensor(spark, sf_dir), ["frame_id", "terrace_index"])


@query(
    "dominant_clusters",
    sql(
        "tensor",
        "SELECT frame_id, terrace_index, arg_max(cluster_id, {'v': pixel_count, 'k': -cluster_id}) AS dominant_cluster, max(pixel_fraction) AS dominant_fraction, -sum(CASE WHEN pixel_fraction > 0 THEN pixel_fraction * log2(pixel_fraction) ELSE 0 END) AS entropy_bits FROM po GROUP BY ALL",
        "frame_id, terrace_index, dominant_cluster",
        "dominant_fraction entropy_bits",
        _pooled("po", "frame_id, terrace_index"),
    ),
)
def _(spark, sf_dir):
    return activity.dominant(activity.pooled(views.cluster_tensor(spark, sf_dir), ["frame_id", "terrace_index"]), ["frame_id", "terrace_index"])


@query(
    "cluster_front_metrics",
    sql(
        "tensor",
        "SELECT frame_id, cluster_id, sum(terrace_index * pixel_fraction) / sum(pixel_fraction) AS mean_terrace, arg_max(terrace_index, {'v': pixel_fraction, 'k': -terrace_index}) AS peak_terrace, max(terrace_index) FILTER (WHERE pixel_fraction >= 0.15) AS front_terrace FROM po GROUP BY ALL",
        "frame_id, cluster_id, peak_terrace, front_terrace",
        "mean_terrace",
        _pooled("po", "frame_id, terrace_index"),
    ),
)
def _(spark, sf_dir):
    return activity.front_metrics(views.cluster_tensor(spark, sf_dir))


@query(
    "cluster_hole_spread",
    sql(
        "tensor",
        "SELECT frame_id, cluster_id, avg(pixel_fraction) AS mean_fraction, stddev_pop(pixel_fraction) AS std_fraction, quantile_cont(pixel_fraction, 0.1) AS p10_fraction, quantile_cont(pixel_fraction, 0.9) AS p90_fraction FROM po GROUP BY ALL",
        "frame_id, cluster_id",
        "mean_fraction std_fraction p10_fraction p90_fraction",
        _pooled("po", "frame_id, hole_id"),
    ),
)
def _(spark, sf_dir):
    return activity.hole_spread(views.cluster_tensor(spark, sf_dir))


@query(
    "cluster_js_similarity",
    sql(
        "tensor",
        "SELECT frame_id, hole_id, 1 - sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js_similarity FROM jp GROUP BY ALL",
        "frame_id, hole_id",
        "js_similarity",
        _pooled("ph", "frame_id, hole_id") + ", " + _pooled("pq", "frame_id") + ", jp AS (SELECT k.frame_id, k.hole_id, q.cluster_id, q.pixel_fraction AS q, coalesce(h.pixel_fraction, 0.0) AS p FROM (SELECT DISTINCT frame_id, hole_id FROM ph) k JOIN pq q ON q.frame_id = k.frame_id LEFT JOIN ph h ON h.frame_id = k.frame_id AND h.hole_id = k.hole_id AND h.cluster_id = q.cluster_id)",
    ),
)
def _(spark, sf_dir):
    return activity.js_similarity(views.cluster_tensor(spark, sf_dir))


def _act(keys: str) -> str:
    p = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""ac AS (SELECT frame_id, {keys}, cluster_id, sum(pixel_count) AS n FROM tensor GROUP BY ALL), av AS (SELECT frame_id, {keys}, sum(n) AS n_valid FROM ac GROUP BY ALL),
    ag AS (SELECT f.frame_id, {p}, c.cluster_id FROM (SELECT DISTINCT frame_id FROM ac) f, (SELECT DISTINCT {keys} FROM ac) p, (SELECT DISTINCT cluster_id FROM ac) c),
    ar AS (SELECT ag.*, CASE WHEN n_valid > 0 THEN coalesce(n, 0) / n_valid END AS raw_fraction FROM ag LEFT JOIN av USING (frame_id, {keys}) LEFT JOIN ac USING (frame_id, {keys}, cluster_id)),
    ab AS (SELECT *, avg(raw_fraction) FILTER (WHERE frame_id IN (SELECT DISTINCT frame_id FROM ac ORDER BY 1 LIMIT 3)) OVER (PARTITION BY {keys}, cluster_id) AS baseline_fraction FROM ar),
    aa AS (SELECT *, CASE WHEN raw_fraction - baseline_fraction IS NOT NULL THEN greatest(raw_fraction - baseline_fraction, 0.0) END AS active_fraction FROM ab),
    act AS (SELECT *, CASE WHEN sum(active_fraction) OVER (PARTITION BY frame_id, cluster_id) > 1e-12 THEN active_fraction / sum(active_fraction) OVER (PARTITION BY frame_id, cluster_id) END AS active_normalized FROM aa)"""


_ACT_M = "raw_fraction baseline_fraction active_fraction active_normalized"


@query("cluster_activity", sql("tensor", "SELECT * FROM act", "frame_id, terrace_index, cluster_id", _ACT_M, _act("terrace_index")))
def _(spark, sf_dir):
    return activity.activity(views.cluster_tensor(spark, sf_dir), ["terrace_index"])


@query("sector_cluster_activity", sql("tensor", "SELECT * FROM act", "frame_id, sector_id, terrace_index, cluster_id", _ACT_M, _act("sector_id, terrace_index")))
def _(spark, sf_dir):
    return activity.activity(views.cluster_tensor(spark, sf_dir), ["sector_id", "terrace_index"])


@query(
    "cluster_activity_front",
    sql(
        "tensor",
        "SELECT frame_id, cluster_id, t AS total_activity, CASE WHEN t > 1e-12 THEN t1 / t END AS front_terrace, CASE WHEN t > 1e-12 THEN sqrt(CASE WHEN t2 / t - (t1 / t) * (t1 / t) > 1e-12 THEN t2 / t - (t1 / t) * (t1 / t) ELSE 0.0 END) END AS front_spread FROM (SELECT frame_id, cluster_id, sum(active_fraction) AS t, sum(active_fraction * terrace_index) AS t1, sum(active_fraction * terrace_index * terrace_index) AS t2 FROM act GROUP BY ALL)",
        "frame_id, cluster_id",
        "total_activity front_terrace front_spread",
        _act("terrace_index"),
    ),
)
def _(spark, sf_dir):
    return activity.activity_front(activity.activity(views.cluster_tensor(spark, sf_dir), ["terrace_index"]))


_RESP = _pooled("po", "frame_id, hole_id, terrace_index") + """, pb AS (SELECT *, avg(pixel_fraction) FILTER (WHERE frame_id IN (SELECT DISTINCT frame_id FROM po ORDER BY 1 LIMIT 3)) OVER (PARTITION BY hole_id, terrace_index, cluster_id) AS b FROM po),
    resp AS (SELECT frame_id, hole_id, sum(CASE WHEN b IS NOT NULL THEN greatest(pixel_fraction - b, 0.0) END) AS response FROM pb GROUP BY ALL)"""


@query("hole_response", sql("tensor", "SELECT * FROM resp", "frame_id, hole_id", "response", _RESP))
def _(spark, sf_dir):
    return activity.hole_response(views.cluster_tensor(spark, sf_dir))


@query("hole_response_order", sql("tensor", "SELECT hole_id, arg_min(frame_id, {'r': -round(response, 9), 'f': frame_id}) AS peak_frame, sum(response) AS integrated_response FROM resp WHERE response IS NOT NULL GROUP BY hole_id", "hole_id, peak_frame", "integrated_response", _RESP))
def _(spark, sf_dir):
    return activity.response_order(activity.hole_response(views.cluster_tensor(spark, sf_dir)))


def _active(spark, sf_dir):
    return activity.activity(views.cluster_tensor(spark, sf_dir), ["sector_id", "terrace_index"], keep=("n_valid",))


@query(
    "sector_fan",
    sql(
        "tensor",
        "SELECT frame_id, sector_id, cluster_id, CAST(sum(coalesce(n_valid, 0)) AS BIGINT) AS n_pixels, CASE WHEN sum(coalesce(n_valid, 0)) > 0 THEN sum(coalesce(active_fraction, 0.0) * coalesce(n_valid, 0)) / sum(coalesce(n_valid, 0)) END AS active_fraction FROM act LEFT JOIN av USING (frame_id, sector_id, terrace_index) GROUP BY ALL",
        "frame_id, sector_id, cluster_id, n_pixels",
        "active_fraction",
        _act("sector_id, terrace_index"),
    ),
)
def _(spark, sf_dir):
    return activity.sector_fan(_active(spark, sf_dir))


@query(
    "ring_snapshots",
    sql(
        "tensor",
        f"SELECT frame_id, sector_id, terrace_index, coalesce(sum(active_fraction), 0.0) > 1e-12 AS is_active, CASE WHEN coalesce(sum(active_fraction), 0.0) > 1e-12 THEN arg_max(cluster_id, {{'v': {_settled('active_fraction')}, 'k': -cluster_id}}) FILTER (WHERE active_fraction IS NOT NULL) ELSE arg_max(cluster_id, {{'v': {_settled('raw_fraction')}, 'k': -cluster_id}}) FILTER (WHERE raw_fraction IS NOT NULL) END AS cluster_id FROM act GROUP BY ALL",
        "frame_id, sector_id, terrace_index, is_active, cluster_id",
        "",
        _act("sector_id, terrace_index"),
    ),
)
def _(spark, sf_dir):
    return activity.ring_snapshots(_active(spark, sf_dir), ["sector_id", "terrace_index"])


@query("front_totals", sql("tensor", "SELECT cluster_id, sum(t) AS total_activity, count(t) AS n_frames FROM (SELECT frame_id, cluster_id, sum(active_fraction) AS t FROM act GROUP BY ALL) GROUP BY cluster_id", "cluster_id, n_frames", "total_activity", _act("terrace_index")))
def _(spark, sf_dir):
    return activity.front_totals(activity.activity_front(activity.activity(views.cluster_tensor(spark, sf_dir), ["terrace_index"])))


# --- resampling --------------------------------------------------------------------------------------------------------

_BOOT = f"""kn AS (SELECT hole_id, frame_id, rdf_front_radius_norm AS y, row_number() OVER (PARTITION BY hole_id ORDER BY frame_id) - 1 AS rank, count(*) OVER (PARTITION BY hole_id) AS n FROM frames WHERE rdf_front_radius_norm IS NOT NULL),
    dr AS (SELECT c.hole_id, b.boot, ((CAST(c.hole_id AS BIGINT) * {resample.A} + b.boot * {resample.B} + d.draw * {resample.C} + {resample.D}) % {resample.M}) % c.n AS rank FROM (SELECT DISTINCT hole_id, n FROM kn WHERE n >= 2) c, range(128) b(boot), LATERAL (SELECT unnest(range(c.n)) AS draw) d),
    on1 AS (SELECT DISTINCT dr.hole_id, dr.boot, kn.frame_id, kn.y FROM dr JOIN kn ON kn.hole_id = dr.hole_id AND kn.rank = dr.rank),
    pb AS (SELECT hole_id, boot, avg(y) AS mean_front, arg_max(y, frame_id) - arg_min(y, frame_id) AS delta_front, CASE WHEN regr_sxx(y, frame_id) > 0 THEN regr_sxy(y, frame_id) / regr_sxx(y, frame_id) ELSE 0.0 END AS velocity FROM on1 GROUP BY ALL),
    bs AS (SELECT hole_id, count(*) AS n_boot, {", ".join(f"quantile_cont({c}, 0.025) AS bootstrap_{c}_ci_low, quantile_cont({c}, 0.975) AS bootstrap_{c}_ci_high, quantile_cont({c}, 0.975) - quantile_cont({c}, 0.025) AS bootstrap_{c}_ci_width" for c in ("mean_front", "delta_front", "velocity"))} FROM pb GROUP BY hole_id)"""
_BOOT_M = " ".join(f"bootstrap_{c}_ci_{e}" for c in ("mean_front", "delta_front", "velocity") for e in ("low", "high", "width"))


@query("rdf_bootstrap", sql("radial", "SELECT * FROM bs", "hole_id, n_boot", _BOOT_M, FRAMES + ", " + _BOOT))
def _(spark, sf_dir):
    return resample.bootstrap(_frames(spark, sf_dir))


@query("rdf_uncertainty", sql("radial", "SELECT hole_id, (bootstrap_mean_front_ci_width + bootstrap_delta_front_ci_width + bootstrap_velocity_ci_width) / 3 AS uncertainty_score FROM bs", "hole_id", "uncertainty_score", FRAMES + ", " + _BOOT))
def _(spark, sf_dir):
    return resample.uncertainty(resample.bootstrap(_frames(spark, sf_dir))).select("hole_id", "uncertainty_score")


# --- archetypes by centroid ----------------------------------------------------------------------------------------------

_CENTRES = f"{_ZONES}, cen AS (SELECT coalesce(reticulum_zone, 'all') AS label, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM features LEFT JOIN zone USING (hole_id) GROUP BY ALL), cm AS (SELECT {', '.join(f'coalesce(avg({f}), 0.0) AS {f}' for f in FEATURES)} FROM cen)"


def _nearest(name: str, source: str, keys: str) -> str:
    d = " + ".join(f"(coalesce(c.{f}, m.{f}) - coalesce(s.{f}, m.{f})) * (coalesce(c.{f}, m.{f}) - coalesce(s.{f}, m.{f}))" for f in FEATURES)
    return f"{name} AS (SELECT {keys}, arg_min(label, {{'d': d, 'l': label}}) AS label FROM (SELECT s.*, c.label, floor(({d}) * 1e9 + 0.5) AS d FROM {source} s, cen c, cm m) GROUP BY {keys})"


def _zone_centroids(spark, sf_dir, features):
    """A centroid for each zone of the reticulum: the archetypes that SQL can state."""
    zoned = features.join(radial.zones(views.holes(spark, sf_dir)), "hole_id", "left").withColumn("label", F.coalesce("reticulum_zone", F.lit("all")))
    return zoned.groupBy("label").agg(*[F.avg(f).alias(f) for f in FEATURES])


@query("nearest_archetypes", sql("radial holes", "SELECT * FROM near", "hole_id, label", "", f"{FRAMES}, {_FEATURE_SQL}, {_CENTRES}, {_nearest('near', 'features', 'hole_id')}"))
def _(spark, sf_dir):
    features = checkpointed(rdf.archetype_features(_frames(spark, sf_dir)))
    return clusters.nearest_centroid(features, _zone_centroids(spark, sf_dir, features), FEATURES).select("hole_id", "label")


_SUPPORT = f"""{FRAMES}, {_FEATURE_SQL}, {_CENTRES}, kf AS (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY frame_id) - 1 AS rank, count(*) OVER (PARTITION BY hole_id) AS n FROM frames),
    df AS (SELECT c.hole_id, b.boot, ((CAST(c.hole_id AS BIGINT) * {resample.A} + b.boot * {resample.B} + d.draw * {resample.C} + {resample.D}) % {resample.M}) % c.n AS rank FROM (SELECT DISTINCT hole_id, n FROM kf) c, range(128) b(boot), LATERAL (SELECT unnest(range(c.n)) AS draw) d),
    ff AS (SELECT kf.*, df.boot FROM df JOIN kf ON kf.hole_id = df.hole_id AND kf.rank = df.rank), {_features("fb", "ff", "hole_id, boot")}, {_nearest("nb", "fb", "hole_id, boot")},
    sup AS (SELECT hole_id, CAST(sum(k) AS BIGINT) AS n_boot, arg_min(label, {{'k': -k, 'l': label}}) AS archetype_label, max(k) / sum(k) AS support_fraction, count(*) AS n_labels FROM (SELECT hole_id, label, count(*) AS k FROM nb GROUP BY ALL) GROUP BY hole_id)"""


def _kept_frames(spark, sf_dir) -> DataFrame:
    """The fronts of holes and frames, written once for a query that uses them in several ways."""
    return checkpointed(_frames(spark, sf_dir))


def _support(spark, sf_dir, frames_):
    centroids = checkpointed(_zone_centroids(spark, sf_dir, rdf.archetype_features(frames_)))
    return resample.archetype_support(frames_, centroids, FEATURES)


@query("archetype_support", sql("radial holes", "SELECT * FROM sup", "hole_id, n_boot, archetype_label, n_labels", "support_fraction", _SUPPORT))
def _(spark, sf_dir):
    return _support(spark, sf_dir, _kept_frames(spark, sf_dir))


@query(
    "supported_uncertainty",
    sql(
        "radial holes",
        "SELECT hole_id, archetype_label, (bootstrap_mean_front_ci_width + bootstrap_delta_front_ci_width + bootstrap_velocity_ci_width + greatest(1 - support_fraction, 0.0)) / 4 AS uncertainty_score FROM bs JOIN sup USING (hole_id)",
        "hole_id, archetype_label",
        "uncertainty_score",
        _SUPPORT + ", " + _BOOT,
    ),
)
def _(spark, sf_dir):
    fronts = _kept_frames(spark, sf_dir)
    return resample.uncertainty(resample.bootstrap(fronts), _support(spark, sf_dir, fronts)).select("hole_id", "archetype_label", "uncertainty_score")


_HS = "hs AS (SELECT nearest_hole_id AS hole_id, count(*) AS n_hotspots, avg(dist_to_hole_px) AS mean_hotspot_distance_px, min(dist_to_hole_px) AS dmin FROM hotspots WHERE nearest_hole_id >= 0 GROUP BY ALL)"
_BUCKET = "CASE WHEN dmin IS NULL THEN 'none' WHEN dmin <= 10 THEN 'near' WHEN dmin <= 24 THEN 'mid' ELSE 'far' END"


@query(
    "uncertainty_groups",
    sql(
        "radial holes hotspots",
        f"SELECT coalesce(reticulum_zone, 'unknown') AS reticulum_zone, {_BUCKET} AS hotspot_proximity_bucket, count(*) AS n_holes, avg(support_fraction) AS mean_support, avg(bootstrap_velocity_ci_width) AS mean_velocity_ci_width, avg(bootstrap_mean_front_ci_width) AS mean_front_ci_width FROM sup LEFT JOIN bs USING (hole_id) LEFT JOIN hs USING (hole_id) LEFT JOIN zone USING (hole_id) GROUP BY ALL",
        "reticulum_zone, hotspot_proximity_bucket, n_holes",
        "mean_support mean_velocity_ci_width mean_front_ci_width",
        f"{_SUPPORT}, {_BOOT}, {_HS}",
    ),
)
def _(spark, sf_dir):
    fronts = _kept_frames(spark, sf_dir)
    rows = _support(spark, sf_dir, fronts).join(resample.bootstrap(fronts).drop("n_boot"), "hole_id", "left")
    zoned = hotspots.compare(rows, views.hotspot_rows(spark, sf_dir), radial.zones(views.holes(spark, sf_dir)))
    return zoned.groupBy("reticulum_zone", "hotspot_proximity_bucket").agg(
        F.count(F.lit(1)).alias("n_holes"), F.avg("support_fraction").alias("mean_support"), F.avg("bootstrap_velocity_ci_width").alias("mean_velocity_ci_width"),
        F.avg("bootstrap_mean_front_ci_width").alias("mean_front_ci_width"),
    )


@query(
    "rdf_hotspot_reticulum_groups",
    sql(
        "radial holes hotspots",
        f"SELECT coalesce(reticulum_zone, 'unknown') AS reticulum_zone, label, {_BUCKET} AS hotspot_proximity_bucket, count(*) AS n_holes, avg(coalesce(n_hotspots, 0)) AS mean_n_hotspots, avg(mean_hotspot_distance_px) AS mean_distance, avg(mean_front_radius_norm) AS group_mean_front_radius_norm, avg(delta_front_radius_norm) AS group_delta_front_radius_norm FROM features JOIN near USING (hole_id) LEFT JOIN hs USING (hole_id) LEFT JOIN zone USING (hole_id) GROUP BY ALL",
        "reticulum_zone, label, hotspot_proximity_bucket, n_holes",
        "mean_n_hotspots mean_distance group_mean_front_radius_norm group_delta_front_radius_norm",
        f"{FRAMES}, {_FEATURE_SQL}, {_CENTRES}, {_nearest('near', 'features', 'hole_id')}, {_HS}",
    ),
)
def _(spark, sf_dir):
    features = checkpointed(rdf.archetype_features(_frames(spark, sf_dir)))
    rows = clusters.nearest_centroid(features, _zone_centroids(spark, sf_dir, features), FEATURES)
    zoned = hotspots.compare(rows, views.hotspot_rows(spark, sf_dir), radial.zones(views.holes(spark, sf_dir)))
    return hotspots.compare_groups(zoned, ["mean_front_radius_norm", "delta_front_radius_norm"], ("reticulum_zone", "label", "hotspot_proximity_bucket"))


_MEANING = f"""{PROFILE}, {_ASYM}, {_ZONES}, hsum AS ({_summary("hole_id", "profile")}), aby AS (SELECT hole_id, avg(angular_asymmetry) AS mean_angular_asymmetry FROM asym GROUP BY hole_id),
    zs AS (SELECT reticulum_zone, avg(delta_center_of_mass) AS delta_center_of_mass, avg(mean_angular_asymmetry) AS mean_angular_asymmetry, count(*) AS count FROM hsum JOIN zone USING (hole_id) LEFT JOIN aby USING (hole_id) GROUP BY ALL),
    zm AS (SELECT *, CASE WHEN delta_center_of_mass IS NULL THEN 'unknown' WHEN delta_center_of_mass > 0.35 THEN 'outward_shift' WHEN delta_center_of_mass < -0.35 THEN 'inward_shift' WHEN mean_angular_asymmetry > 0.25 THEN 'stable_asymmetric' ELSE 'stable' END AS semantic_label FROM zs),
    zc AS (SELECT *, row_number() OVER (ORDER BY semantic_label, floor(coalesce(delta_center_of_mass, 0.0) * 1e9 + 0.5), reticulum_zone) AS canonical_id FROM zm)"""


@query(
    "zone_semantics",
    sql("radial sector holes", "SELECT *, 'R' || canonical_id || '_' || semantic_label AS canonical_label FROM zc", "reticulum_zone, count, semantic_label, CAST(canonical_id AS INTEGER) AS canonical_id, canonical_label", "delta_center_of_mass mean_angular_asymmetry", _MEANING),
)
def _(spark, sf_dir):
    uneven = radial.asymmetry_by(radial.angular_asymmetry(views.sector_rows(spark, sf_dir)), "hole_id").select("hole_id", "mean_angular_asymmetry")
    rows = _hole_summary(spark, sf_dir).join(radial.zones(views.holes(spark, sf_dir)), "hole_id").join(uneven, "hole_id", "left")
    return clusters.semantics(rows, "reticulum_zone")


_GROUPED = f"""{PROFILE}, {_ASYM}, hsum AS ({_summary("hole_id", "profile")}), aby AS (SELECT hole_id, avg(angular_asymmetry) AS mean_angular_asymmetry FROM asym GROUP BY hole_id), hz AS (SELECT * FROM hsum LEFT JOIN aby USING (hole_id)),
    {_kmeans("kr", "hz", ["delta_center_of_mass", "mean_inner_minus_outer", "mean_angular_asymmetry"], 3)}, kg AS (SELECT cluster_id, avg(delta_center_of_mass) AS d, avg(mean_angular_asymmetry) AS a FROM hz JOIN kr USING (hole_id) GROUP BY cluster_id),
    kn AS (SELECT *, CASE WHEN d IS NULL THEN 'unknown' WHEN d > 0.35 THEN 'outward_shift' WHEN d < -0.35 THEN 'inward_shift' WHEN a > 0.25 THEN 'stable_asymmetric' ELSE 'stable' END AS semantic_label FROM kg),
    ko AS (SELECT *, CAST(row_number() OVER (ORDER BY semantic_label, floor(coalesce(d, 0.0) * 1e9 + 0.5), cluster_id) AS INTEGER) AS canonical_id FROM kn)"""


@query("radial_archetypes", recursive(sql("radial sector", "SELECT *, 'R' || canonical_id || '_' || semantic_label AS canonical_label FROM kr JOIN ko USING (cluster_id)", "hole_id, cluster_id, semantic_label, canonical_id, canonical_label", "", _GROUPED)))
def _(spark, sf_dir):
    """Holes in three groups by profile summary, scaled."""
    uneven = radial.asymmetry_by(radial.angular_asymmetry(views.sector_rows(spark, sf_dir)), "hole_id").select("hole_id", "mean_angular_asymmetry")
    rows = _hole_summary(spark, sf_dir).join(uneven, "hole_id", "left")
    placed = clusters.kmeans(rows, ["delta_center_of_mass", "mean_inner_minus_outer", "mean_angular_asymmetry"], 3)
    named = clusters.semantics(placed, "cluster_id").select("cluster_id", "semantic_label", "canonical_id", "canonical_label")
    return placed.join(F.broadcast(named), "cluster_id").select("hole_id", "cluster_id", "semantic_label", "canonical_id", "canonical_label")


@query(
    "validation_summary",
    sql(
        "radial sector holes",
        """SELECT (SELECT avg(support_fraction) FROM sup) AS mean_support, (SELECT avg(bootstrap_velocity_ci_width) FROM bs) AS mean_velocity_ci_width, (SELECT avg((bootstrap_mean_front_ci_width + bootstrap_delta_front_ci_width + bootstrap_velocity_ci_width + greatest(1 - support_fraction, 0.0)) / 4) FROM bs JOIN sup USING (hole_id)) AS mean_uncertainty_score,
        (SELECT avg(f) FROM (SELECT count(sector_front_velocity_per_frame) / count(*) AS f FROM prop GROUP BY hole_id)) AS mean_sector_velocity_fraction""",
        "",
        "mean_support mean_velocity_ci_width mean_uncertainty_score mean_sector_velocity_fraction",
        f"{_SUPPORT}, {_BOOT}, {SFRAMES}, {_PROP}",
    ),
)
def _(spark, sf_dir):
    fronts = _kept_frames(spark, sf_dir)
    scored = resample.uncertainty(resample.bootstrap(fronts), _support(spark, sf_dir, fronts))
    return resample.summary(scored, sectors.propagation_summary(sectors.propagation(_sector_frames(spark, sf_dir))))


_SWEPT_FEATURES = f"""grid(sweep_id, bs, rs) AS (VALUES {", ".join(f"({i * 3 + k}, CAST({b} AS DOUBLE), CAST({r} AS DOUBLE))" for i, b in enumerate(sweeps.BRIGHTNESS) for k, r in enumerate(sweeps.RADIUS))}),
    swept AS (SELECT {{'s': sweep_id, 'h': hole_id}} AS hole_id, frame_id, CAST(floor(annulus_id * rs + 1e-9) AS INTEGER) AS annulus_id, avg(least(descriptor_value * bs, 1.0)) AS descriptor_value FROM radial, grid GROUP BY ALL),
    {FRAMES.replace("FROM radial", "FROM swept")}, {_FEATURE_SQL}, fs AS (SELECT hole_id.s AS sweep_id, bs AS brightness_scale, rs AS radius_scale, hole_id.h AS hole_id, features.* EXCLUDE (hole_id) FROM features JOIN grid ON grid.sweep_id = hole_id.s),
    bf AS (SELECT * FROM fs WHERE brightness_scale = 1 AND radius_scale = 1), {_CENTRES.replace("FROM features", "FROM bf")}, {_nearest("ns", "fs", "sweep_id, brightness_scale, radius_scale, hole_id")}"""


_SUMMARIES = {
    "bootstrap_validation": ("mean_bootstrap_class_support mean_velocity_ci_width mean_sector_propagation_valid_fraction", f"""SELECT (SELECT avg(support_fraction) FROM sup) AS mean_bootstrap_class_support, (SELECT avg(bootstrap_velocity_ci_width) FROM bs JOIN sup USING (hole_id)) AS mean_velocity_ci_width,
        (SELECT avg(f) FROM (SELECT count(sector_front_velocity_per_frame) / count(*) AS f FROM prop GROUP BY hole_id)) AS mean_sector_propagation_valid_fraction, true AS validation_enabled""", f"{_SUPPORT}, {_BOOT}, {SFRAMES}, {_PROP}"),
    "uncertainty_validation": ("mean_uncertainty_score mean_hotspot_linked_velocity_ci_width mean_sector_acceleration_valid_fraction", f"""SELECT (SELECT avg((bootstrap_mean_front_ci_width + bootstrap_delta_front_ci_width + bootstrap_velocity_ci_width + greatest(1 - support_fraction, 0.0)) / 4) FROM bs JOIN sup USING (hole_id)) AS mean_uncertainty_score,
        (SELECT avg(bootstrap_velocity_ci_width) FROM bs JOIN sup USING (hole_id)) AS mean_hotspot_linked_velocity_ci_width, (SELECT avg(f) FROM (SELECT CAST(count(*) / count(*) AS DOUBLE) AS f FROM acc GROUP BY hole_id)) AS mean_sector_acceleration_valid_fraction, true AS validation_enabled""", f"{_SUPPORT}, {_BOOT}, {SFRAMES}, {_ACC}"),
}
for _at, (_name, (_measures, _text, _ctes)) in enumerate(_SUMMARIES.items()):

    @query(_name, sql("radial sector holes", _text, "validation_enabled", _measures, _ctes))
    def _(spark, sf_dir, at=_at):
        fronts = _kept_frames(spark, sf_dir)
        scored = checkpointed(resample.uncertainty(resample.bootstrap(fronts), _support(spark, sf_dir, fronts)))
        by_sector = checkpointed(_sector_frames(spark, sf_dir))
        velocities, accelerations = sectors.propagation_summary(sectors.propagation(by_sector)), sectors.acceleration_summary(sectors.acceleration(by_sector))
        return resample.validation_summaries(scored, velocities, accelerations)[at]


@query(
    "archetype_sweeps",
    sql(
        "radial holes",
        "SELECT sweep_id, n.brightness_scale, n.radius_scale, avg(CAST(n.label = b.label AS DOUBLE)) AS stability_fraction, count(*) AS n_holes FROM ns n JOIN (SELECT hole_id, label FROM ns WHERE brightness_scale = 1 AND radius_scale = 1) b USING (hole_id) GROUP BY ALL",
        "sweep_id, n_holes",
        "brightness_scale radius_scale stability_fraction",
        _SWEPT_FEATURES,
    ),
)
def _(spark, sf_dir):
    swept = sweeps.archetype_features(views.radial_rows(spark, sf_dir))
    base = swept.where("brightness_scale = 1 AND radius_scale = 1")
    return sweeps.archetypes_kept(swept, _zone_centroids(spark, sf_dir, base), FEATURES)


@query(
    "curve_stability",
    sql(
        "radial",
        "SELECT hole_id, frame_id, avg(abs(a - b)) AS mae, max(abs(a - b)) AS max_abs FROM (SELECT hole_id, frame_id, k, avg(v) FILTER (WHERE s = 0.95) AS a, avg(v) FILTER (WHERE s = 1.05) AS b FROM (SELECT hole_id, frame_id, s, floor(annulus_id * s + 1e-9) AS k, least(descriptor_value, 1.0) AS v FROM radial, (VALUES (0.95::DOUBLE), (1.05::DOUBLE)) t(s)) GROUP BY ALL) GROUP BY ALL",
        "hole_id, frame_id",
        "mae max_abs",
    ),
)
def _(spark, sf_dir):
    return sweeps.curve_stability(views.radial_rows(spark, sf_dir))


# --- frames ------------------------------------------------------------------------------------------------------------

_HSL = """hsl0 AS (SELECT *, r / 255.0 AS r1, g / 255.0 AS g1, b / 255.0 AS b1 FROM (SELECT frame_id, region_id, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM pixels)),
    hsl1 AS (SELECT *, greatest(r1, g1, b1) AS hi, greatest(r1, g1, b1) - least(r1, g1, b1) AS c, (greatest(r1, g1, b1) + least(r1, g1, b1)) / 2 AS l FROM hsl0),
    hsl AS (SELECT *, CASE WHEN c = 0 THEN 0.0 WHEN hi = r1 THEN (CASE WHEN (g1 - b1) / c < 0 THEN (g1 - b1) / c + 6 ELSE (g1 - b1) / c END) / 6 WHEN hi = g1 THEN ((b1 - r1) / c + 2) / 6 ELSE ((r1 - g1) / c + 4) / 6 END AS h,
      CASE WHEN c = 0 THEN 0.0 ELSE c / (1 - abs(2 * l - 1) + 1e-6) END AS s FROM hsl1)"""


@query(
    "region_colour_stats",
    sql(
        "pixels",
        "SELECT frame_id, region_id, avg(r) AS mean_R, avg(g) AS mean_G, avg(b) AS mean_B, avg(h) AS mean_H, avg(s) AS mean_S, avg(l) AS mean_L, stddev_pop(r) AS std_R, stddev_pop(g) AS std_G, stddev_pop(b) AS std_B, count(*) AS area_px FROM hsl GROUP BY ALL",
        "frame_id, region_id, area_px",
        "mean_R mean_G mean_B mean_H mean_S mean_L std_R std_G std_B",
        _HSL,
    ),
)
def _(spark, sf_dir):
    return frames.region_stats(views.pixels(spark, sf_dir), ["frame_id", "region_id"])


_HIST = """hi AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY frame_id) AS BIGINT) AS share, CAST(sum(n) OVER (PARTITION BY frame_id ORDER BY bin) AS BIGINT) / CAST(sum(n) OVER (PARTITION BY frame_id) AS BIGINT) AS cdf
    FROM (SELECT frame_id, CAST(((299 * r + 587 * g + 114 * b) // 1000) * 64 // 256 AS INTEGER) AS bin, count(*) AS n FROM pixels GROUP BY ALL))"""


_GREY = _HIST.replace("* 64 // 256", "* 256 // 256")  # a bin for each grey value


@query("grey_histograms", sql("pixels", "SELECT * FROM hi", "frame_id, bin, n", "share cdf", _HIST))
def _(spark, sf_dir):
    return frames.histogram(views.pixels(spark, sf_dir))


@query(
    "histogram_jumps",
    sql(
        "pixels",
        "SELECT frame_id, CASE WHEN before IS NOT NULL THEN sqrt(greatest(2 - 2 * dot, 0.0)) END AS jump FROM (SELECT a.frame_id, a.before, sum(a.u * coalesce(b.u, 0.0)) AS dot FROM ub a LEFT JOIN un b ON b.frame_id = a.before AND b.bin = a.bin GROUP BY ALL)",
        "frame_id",
        "jump",
        _HIST + ", un AS (SELECT frame_id, bin, n / sqrt(sum(n * n) OVER (PARTITION BY frame_id)) AS u FROM hi), fb AS (SELECT frame_id, lag(frame_id) OVER (ORDER BY frame_id) AS before FROM (SELECT DISTINCT frame_id FROM hi)), ub AS (SELECT un.*, before FROM un JOIN fb USING (frame_id))",
    ),
)
def _(spark, sf_dir):
    return frames.histogram_jumps(frames.histogram(views.pixels(spark, sf_dir)))


@query(
    "transition_scores",
    sql(
        "pixels",
        "SELECT frame_id, 0.5 * sum(abs(dh)) + 2 * avg(dc) + 0.5 * (abs(sum(dh * bin)) / 255) AS score FROM (SELECT frame_id, bin, share - lag(share) OVER (PARTITION BY bin ORDER BY frame_id) AS dh, abs(cdf - lag(cdf) OVER (PARTITION BY bin ORDER BY frame_id)) AS dc FROM dc0) GROUP BY ALL",
        "frame_id",
        "score",
        _GREY + ", dn AS (SELECT f.frame_id, CAST(k AS INTEGER) AS bin, coalesce(hi.share, 0.0) AS share FROM (SELECT DISTINCT frame_id FROM hi) f CROSS JOIN range(256) t(k) LEFT JOIN hi ON hi.frame_id = f.frame_id AND hi.bin = k), dc0 AS (SELECT *, sum(share) OVER (PARTITION BY frame_id ORDER BY bin) AS cdf FROM dn)",
    ),
)
def _(spark, sf_dir):
    return frames.transition_scores(frames.histogram(views.pixels(spark, sf_dir), 256))


@query(
    "saturation_audit",
    sql(
        "pixels",
        "SELECT *, greatest(saturation_r, saturation_g, saturation_b) < 0.05 AS accepted FROM (SELECT frame_id, avg(CAST(r >= 250 AS DOUBLE)) AS saturation_r, avg(CAST(g >= 250 AS DOUBLE)) AS saturation_g, avg(CAST(b >= 250 AS DOUBLE)) AS saturation_b FROM pixels GROUP BY ALL)",
        "frame_id, accepted",
        "saturation_r saturation_g saturation_b",
    ),
)
def _(spark, sf_dir):
    return frames.saturation(views.pixels(spark, sf_dir))


_SEP = _HSL + """, sl AS (SELECT region_id < 2 AS i, unnest(['r', 'g', 'b', 'h', 's']) AS name, unnest([r1, g1, b1, h, s]) AS v FROM hsl),
    se AS (SELECT name AS descriptor, (avg(v) FILTER (WHERE i) - avg(v) FILTER (WHERE NOT i)) ** 2 / greatest(var_pop(v) FILTER (WHERE i) + var_pop(v) FILTER (WHERE NOT i), 1e-6) AS score FROM sl GROUP BY name)"""


@query("descriptor_separability", sql("pixels", "SELECT * FROM se", "descriptor", "score", _SEP))
def _(spark, sf_dir):
    return frames.separability(views.pixels(spark, sf_dir), F.col("region_id") < 2)


@query("primary_descriptor", sql("pixels", "SELECT arg_max(descriptor, {'s': score, 'd': descriptor}) AS descriptor, max(score) AS score FROM se", "descriptor", "score", _SEP))
def _(spark, sf_dir):
    return frames.best_descriptor(frames.separability(views.pixels(spark, sf_dir), F.col("region_id") < 2))


@query(
    "best_correction",
    sql("", "SELECT arg_min(method, {'s': score, 'm': method}) AS method, min(score) AS score FROM (SELECT event_type AS method, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS score FROM events GROUP BY 1)", "method", "score", "nothing AS (SELECT 1)"),
)
def _(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.round(F.col("value") * 100).cast("bigint").alias("score"))
    return frames.best_correction(rows)


@query("frame_window", sql("radial", "SELECT * FROM radial WHERE frame_id BETWEEN 2 AND 20 AND (frame_id - 2) % 3 = 0", "hole_id, frame_id, annulus_id", "descriptor_value"))
def _(spark, sf_dir):
    return frames.window(views.radial_rows(spark, sf_dir), 2, 20, 3).select("hole_id", "frame_id", "annulus_id", "descriptor_value")


CENTRES = [(0.4, 0.1, 0.5), (-0.3, 0.2, 0.6), (0.0, -0.4, 0.4), (0.1, 0.5, 0.3)]


@query(
    "pixel_cluster_labels",
    sql(
        "pixels",
        "SELECT frame_id, cluster_id, count(*) AS n FROM (SELECT frame_id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster_id FROM (SELECT frame_id, ["
        + ", ".join(f"round((s * cos(h * 2 * pi()) - ({a})) ** 2 + (s * sin(h * 2 * pi()) - ({b})) ** 2 + (l - ({c})) ** 2, 9)" for a, b, c in CENTRES)
        + "] AS ds FROM hsl)) GROUP BY ALL",
        "frame_id, cluster_id, n",
        "",
        _HSL,
    ),
)
def _(spark, sf_dir):
    return frames.nearest_centres(views.pixels(spark, sf_dir), CENTRES).groupBy("frame_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


_PALETTE = """ce AS (SELECT region_id AS cluster_id, avg(s * cos(h * 2 * pi())) AS hx, avg(s * sin(h * 2 * pi())) AS hy, avg(l) AS l, CASE WHEN region_id % 2 = 0 THEN round_even(avg(r), 0) END AS mr, round_even(avg(g), 0) AS mg, round_even(avg(b), 0) AS mb FROM hsl GROUP BY region_id),
    ch AS (SELECT *, CASE WHEN atan2(hy, hx) < 0 THEN atan2(hy, hx) / (2 * pi()) + 1 ELSE atan2(hy, hx) / (2 * pi()) END AS ch, least(sqrt(hx * hx + hy * hy), 1.0) AS cs FROM ce),
    co AS (SELECT *, (1 - abs(2 * l - 1)) * cs AS c, ch * 6 AS hp FROM ch),
    cx AS (SELECT *, c * (1 - abs(hp - 2 * floor(hp / 2) - 1)) AS xx, l - c / 2 AS m FROM co),
    cr AS (SELECT *, CASE WHEN hp < 1 THEN [c, xx, 0] WHEN hp < 2 THEN [xx, c, 0] WHEN hp < 3 THEN [0, c, xx] WHEN hp < 4 THEN [0, xx, c] WHEN hp < 5 THEN [xx, 0, c] ELSE [c, 0, xx] END AS v FROM cx),
    ci AS (SELECT *, CAST(round_even(round(255 * (v[1] + m), 9), 0) AS INTEGER) AS cr, CAST(round_even(round(255 * (v[2] + m), 9), 0) AS INTEGER) AS cg, CAST(round_even(round(255 * (v[3] + m), 9), 0) AS INTEGER) AS cb FROM cr)"""


@query(
    "cluster_palette",
    sql(
        "pixels",
        "SELECT cluster_id, ch AS center_h, cs AS center_s, l AS center_l, cr AS centroid_r, cg AS centroid_g, cb AS centroid_b, CASE WHEN mr IS NULL THEN cr ELSE CAST(mr AS INTEGER) END AS display_r, CASE WHEN mr IS NULL THEN cg ELSE CAST(mg AS INTEGER) END AS display_g, CASE WHEN mr IS NULL THEN cb ELSE CAST(mb AS INTEGER) END AS display_b, CASE WHEN mr IS NULL THEN 'centroid' ELSE 'observed' END AS display_source FROM ci",
        "cluster_id, centroid_r, centroid_g, centroid_b, display_r, display_g, display_b, display_source",
        "center_h center_s center_l",
        f"{_HSL}, {_PALETTE}",
    ),
)
def _(spark, sf_dir):
    """Regions as clusters, every other one without an observed red."""
    px = mixture.embedded(views.pixels(spark, sf_dir)).withColumnRenamed("region_id", "cluster_id")
    means = px.groupBy("cluster_id").agg(F.avg("_x").alias("hx"), F.avg("_y").alias("hy"), F.avg("_l").alias("l"), *[F.avg(c).alias(c) for c in "rgb"])
    return mixture.palette(means, means.withColumn("r", F.when(F.col("cluster_id") % 2 == 0, F.col("r"))))


# --- plots' tables and gates -------------------------------------------------------------------------------------------


@query("first_holes", sql("radial", "SELECT 'hole_' || hole_id AS label, v AS mean_descriptor FROM (SELECT hole_id, avg(descriptor_value) AS v FROM radial GROUP BY hole_id ORDER BY hole_id LIMIT 12)", "label", "mean_descriptor"))
def _(spark, sf_dir):
    """A top-k report: its limit is the feature."""
    return reshape.first_rows(views.radial_rows(spark, sf_dir).groupBy("hole_id").agg(F.avg("descriptor_value").alias("mean_descriptor")), "hole_id", "mean_descriptor")


@query("line_series", sql("radial", "SELECT h.hole_id, f.frame_id, v AS descriptor_value FROM (SELECT DISTINCT hole_id FROM radial ORDER BY 1 LIMIT 12) h CROSS JOIN (SELECT DISTINCT frame_id FROM radial WHERE hole_id IN (SELECT DISTINCT hole_id FROM radial ORDER BY 1 LIMIT 12)) f LEFT JOIN (SELECT hole_id, frame_id, arg_max(descriptor_value, annulus_id) AS v FROM radial GROUP BY ALL) x ON x.hole_id = h.hole_id AND x.frame_id = f.frame_id", "hole_id, frame_id", "descriptor_value"))
def _(spark, sf_dir):
    """A plot's first lines: their limit is the feature."""
    return reshape.line_series(views.radial_rows(spark, sf_dir), "hole_id", "frame_id", "descriptor_value", "annulus_id")


@query("radial_matrix", sql("radial", "SELECT frame_id, " + ", ".join(f"arg_max(descriptor_value, hole_id) FILTER (WHERE annulus_id = {i}) AS c{i}" for i in range(7)) + " FROM radial GROUP BY frame_id", "frame_id", " ".join(f"c{i}" for i in range(7))))
def _(spark, sf_dir):
    return reshape.matrix(views.radial_rows(spark, sf_dir), "frame_id", "annulus_id", "descriptor_value", list(range(7)), "hole_id")


@query("gates", sql("radial", "SELECT unnest(['has_rows', 'values_in_range', 'all_annuli']) AS name, unnest([count(*) > 0, min(descriptor_value) >= 0 AND max(descriptor_value) <= 1, count(DISTINCT annulus_id) = 7]) AS passed, 'rows=' || count(*) AS detail FROM radial", "name, passed, detail"))
def _(spark, sf_dir):
    v = "descriptor_value"
    checks = {"has_rows": F.count(F.lit(1)) > 0, "values_in_range": (F.min(v) >= 0) & (F.max(v) <= 1), "all_annuli": F.countDistinct("annulus_id") == 7}
    return gates.gates(views.radial_rows(spark, sf_dir), checks)


# --- pixel rows --------------------------------------------------------------------------------------------------------


def _placed_pixels(spark, sf_dir):
    """Order lines as pixels with a place: 60 columns by order, rows by part."""
    return views.table(spark, sf_dir, "lineitem").select(
        views._frame("l_shipdate").alias("frame_id"), (F.col("l_partkey") % 500).cast("int").alias("y"), (F.col("l_orderkey") % 500).cast("int").alias("x"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") % 256).cast("int").alias("b"),
    )


_PLACED = f"placed AS (SELECT {views._Q} AS frame_id, CAST(l_partkey % 500 AS INTEGER) AS y, CAST(l_orderkey % 500 AS INTEGER) AS x, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g, CAST(l_suppkey % 256 AS INTEGER) AS b FROM lineitem)"


@query(
    "bulk_pixels",
    sql("holes", "SELECT frame_id, count(*) AS area_px, avg(r) AS mean_r FROM placed p WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) <= h.radius_outer_px + 2) GROUP BY frame_id", "frame_id, area_px", "mean_r", _PLACED),
)
def _(spark, sf_dir):
    outside = pixels.outside_holes(_placed_pixels(spark, sf_dir), views.holes(spark, sf_dir), 2.0)
    return outside.groupBy("frame_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg("r").alias("mean_r"))


@query(
    "terrace_pixels",
    sql(
        "holes",
        """SELECT frame_id, m.hole_id, annulus_id, count(*) AS area_px, avg(r) AS mean_r FROM (SELECT *, min(d) OVER (PARTITION BY frame_id, y, x, n) AS least FROM (
        SELECT p.*, h.hole_id, sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) AS d FROM (SELECT *, row_number() OVER () AS n FROM placed) p JOIN holes h ON sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) <= 22)) m
        JOIN (SELECT hole_id, k AS annulus_id, radius_outer_px + k * 1.5 AS r0, radius_outer_px + (k + 1) * 1.5 AS r1 FROM holes, range(6) t(k)) a ON a.hole_id = m.hole_id AND d >= r0 AND d < r1 WHERE d = least GROUP BY ALL""",
        "frame_id, hole_id, CAST(annulus_id AS INTEGER) AS annulus_id, area_px",
        "mean_r",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    holes = views.holes(spark, sf_dir)
    annuli = holes.withColumn("annulus_id", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "hole_id", "annulus_id", (F.col("radius_outer_px") + F.col("annulus_id") * 1.5).alias("r_inner_px"), (F.col("radius_outer_px") + (F.col("annulus_id") + 1) * 1.5).alias("r_outer_px")
    )
    inside = pixels.terraces(_placed_pixels(spark, sf_dir), annuli, holes, 22.0)
    return inside.groupBy("frame_id", "hole_id", "annulus_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg("r").alias("mean_r"))


@query(
    "grey_world_means",
    sql(
        "",
        "SELECT frame_id, avg(floor(least(greatest(r * t / greatest(mr, 1e-6), 0.0), 255.0))) AS mean_r, avg(floor(least(greatest(g * t / greatest(mg, 1e-6), 0.0), 255.0))) AS mean_g, avg(floor(least(greatest(b * t / greatest(mb, 1e-6), 0.0), 255.0))) AS mean_b FROM placed JOIN (SELECT frame_id AS f, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (avg(r) + avg(g) + avg(b)) / 3 AS t FROM placed GROUP BY ALL) ON f = frame_id GROUP BY frame_id",
        "frame_id",
        "mean_r mean_g mean_b",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    return pixels.grey_world(_placed_pixels(spark, sf_dir)).groupBy("frame_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"])


@query(
    "hole_regions",
    sql(
        "holes",
        """SELECT frame_id, hole_id, region, count(*) AS area_px, avg(r) AS mean_r FROM (SELECT p.frame_id, p.r, h.hole_id, unnest(list_filter([CASE WHEN d <= greatest(radius_inner_px - 2, 1.0) THEN 'interior' END, CASE WHEN d <= radius_outer_px AND d > greatest(radius_outer_px - 2, 1.0) THEN 'rim' END], lambda k: k IS NOT NULL)) AS region
        FROM placed p JOIN holes h ON sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) <= 22, LATERAL (SELECT sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) AS d) q) GROUP BY ALL""",
        "frame_id, hole_id, region, area_px",
        "mean_r",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    inside = pixels.regions(_placed_pixels(spark, sf_dir), views.holes(spark, sf_dir), 22.0)
    return inside.groupBy("frame_id", "hole_id", "region").agg(F.count(F.lit(1)).alias("area_px"), F.avg("r").alias("mean_r"))


@query(
    "overlapping_terraces",
    sql(
        "holes",
        """SELECT frame_id, h.hole_id, annulus_id, count(*) AS area_px, avg(r) AS mean_r FROM placed p JOIN holes h ON sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) <= 40
        JOIN (SELECT hole_id, CAST(k AS INTEGER) AS annulus_id, radius_outer_px + k * 4.0 AS r0, radius_outer_px + (k + 1) * 4.0 AS r1 FROM holes, range(6) t(k)) a ON a.hole_id = h.hole_id AND sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) >= r0 AND sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) < r1 GROUP BY ALL""",
        "frame_id, hole_id, annulus_id, area_px",
        "mean_r",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    holes = views.holes(spark, sf_dir)
    annuli = holes.withColumn("annulus_id", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "hole_id", "annulus_id", (F.col("radius_outer_px") + F.col("annulus_id") * 4.0).alias("r_inner_px"), (F.col("radius_outer_px") + (F.col("annulus_id") + 1) * 4.0).alias("r_outer_px")
    )
    inside = pixels.terraces(_placed_pixels(spark, sf_dir), annuli, holes, 40.0, exclusive=False)
    return inside.groupBy("frame_id", "hole_id", "annulus_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg("r").alias("mean_r"))


_FIRST = _PLACED + ", base AS (SELECT y AS qy, x AS qx, min(r) AS br, min(g) AS bg, min(b) AS bb FROM placed WHERE frame_id = (SELECT min(frame_id) FROM placed) GROUP BY ALL)"


def _first_frame(px):
    return px.join(F.broadcast(px.agg(F.min("frame_id").alias("_f"))), F.col("frame_id") == F.col("_f")).drop("_f")


@query(
    "chromatic_distances",
    sql(
        "",
        "SELECT frame_id, avg(d) AS mean_distance, max(d) AS max_distance, count(d) AS n_px FROM (SELECT frame_id, sqrt((r - br) * (r - br) + (g - bg) * (g - bg) + (b - bb) * (b - bb)) AS d FROM placed LEFT JOIN base ON y = qy AND x = qx) GROUP BY frame_id",
        "frame_id, n_px",
        "mean_distance max_distance",
        _FIRST,
    ),
)
def _(spark, sf_dir):
    px = _placed_pixels(spark, sf_dir)
    out = pixels.chromatic_distance(px, _first_frame(px))
    return out.groupBy("frame_id").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.count("distance").alias("n_px"))


@query(
    "hotspot_scores",
    sql(
        "",
        "SELECT frame_id, avg(s) AS mean_score, max(s) AS max_score, count(s) AS n_px FROM (SELECT frame_id, abs(r / 255.0 - v) AS s FROM placed LEFT JOIN (SELECT qy, qx, br / 255.0 AS v FROM base) ON y = qy AND x = qx) GROUP BY frame_id",
        "frame_id, n_px",
        "mean_score max_score",
        _FIRST,
    ),
)
def _(spark, sf_dir):
    values = _placed_pixels(spark, sf_dir).select("frame_id", "y", "x", (F.col("r") / 255.0).alias("value"))
    out = pixels.hotspot_score(values, _first_frame(values))
    return out.groupBy("frame_id").agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("score").alias("n_px"))


@query(
    "hsv_stats",
    sql(
        "",
        """SELECT frame_id, avg(h) AS mean_h, avg(s) AS mean_s, avg(v) AS mean_v, avg(CAST(s >= 0.2 AS DOUBLE)) AS hue_share FROM (
        SELECT frame_id, (CAST(floor(30 * sixth + 0.5) AS BIGINT) % 180) / 179.0::DOUBLE AS h, floor(CASE WHEN hi = 0 THEN 0.0 ELSE 255 * c / hi END + 0.5) / 255.0::DOUBLE AS s, hi / 255.0::DOUBLE AS v FROM (
        SELECT *, CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN hi = r THEN (CASE WHEN (g - b) / c < 0 THEN (g - b) / c + 6 ELSE (g - b) / c END) WHEN hi = g THEN (b - r) / c + 2 ELSE (r - g) / c + 4 END AS sixth FROM (
        SELECT *, CAST(greatest(r, g, b) AS DOUBLE) AS hi, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS c FROM placed))) GROUP BY frame_id""",
        "frame_id",
        "mean_h mean_s mean_v hue_share",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    return frames.hsv_stats(_placed_pixels(spark, sf_dir))


@query(
    "black_rows",
    sql(
        "",
        """SELECT frame_id, CAST(coalesce(min(y) FILTER (WHERE NOT black), max(y) + 1) AS INTEGER) AS top_black_rows, CAST(coalesce(max(y) - max(y) FILTER (WHERE NOT black), max(y) + 1) AS INTEGER) AS bottom_black_rows FROM (
        SELECT frame_id, y, avg(CAST(l <= 12 AS DOUBLE)) >= 0.995 AND avg(l) <= 5 AND stddev_pop(l) <= 3.5 AS black FROM (SELECT *, (299 * r + 587 * g + 114 * b) / 1000 AS l FROM placed) GROUP BY ALL) GROUP BY frame_id""",
        "frame_id, top_black_rows, bottom_black_rows",
        "",
        _PLACED,
    ),
)
def _(spark, sf_dir):
    return pixels.black_rows(_placed_pixels(spark, sf_dir))


_DARK = "y < 4 + frame_id % 3 OR y >= 492 + frame_id % 2"


@query(
    "black_crop",
    sql(
        "",
        """SELECT n_frames, t + b > 0 AS applied, CAST(t AS INTEGER) AS top, CAST(b AS INTEGER) AS bottom, CAST(500 - t - b AS INTEGER) AS cropped_height, tf AS top_detected_fraction, bf AS bottom_detected_fraction, CASE WHEN t + b > 0 THEN 'detected_consistent_black_bands' ELSE 'no_consistent_black_bands' END AS reason FROM (
        SELECT n_frames, tf, bf, CASE WHEN tf >= 0.8 AND tq >= 2 THEN tq ELSE 0 END AS t, CASE WHEN bf >= 0.8 AND bq >= 2 THEN bq ELSE 0 END AS b FROM (
        SELECT count(*) AS n_frames, avg(CAST(t >= 2 AS DOUBLE)) AS tf, avg(CAST(b >= 2 AS DOUBLE)) AS bf, floor(quantile_cont(t, 0.1) FILTER (WHERE t >= 2)) AS tq, floor(quantile_cont(b, 0.1) FILTER (WHERE b >= 2)) AS bq FROM bands))""",
        "n_frames, applied, top, bottom, cropped_height, reason",
        "top_detected_fraction bottom_detected_fraction",
        _PLACED
        + f""", lr AS (SELECT frame_id, y, avg(CAST(l <= 12 AS DOUBLE)) >= 0.995 AND avg(l) <= 5 AND stddev_pop(l) <= 3.5 AS black FROM (SELECT *, CASE WHEN {_DARK} THEN 0 ELSE (299 * r + 587 * g + 114 * b) / 1000 END AS l FROM placed) GROUP BY ALL),
        bands AS (SELECT frame_id, coalesce(min(y) FILTER (WHERE NOT black), max(y) + 1) AS t, coalesce(max(y) - max(y) FILTER (WHERE NOT black), max(y) + 1) AS b FROM lr GROUP BY frame_id)""",
    ),
)
def _(spark, sf_dir):
    """The placed pixels under black bands whose height changes from frame to frame."""
    px = _placed_pixels(spark, sf_dir)
    return trim.black_crop(pixels.black_rows(px.withColumns({c: F.when(F.expr(_DARK), 0).otherwise(F.col(c)) for c in "rgb"})), 500)


_WIN = (
    _GREY
    + """, fp AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT frame_id FROM hi)),
    dn AS (SELECT pos, CAST(k AS INTEGER) AS bin, coalesce(hi.share, 0.0) AS share FROM fp CROSS JOIN range(256) t(k) LEFT JOIN hi ON hi.frame_id = fp.frame_id AND hi.bin = k),
    dp AS (SELECT *, sum(share) OVER (PARTITION BY pos ORDER BY bin) AS cdf, sum(share * bin / 255) OVER (PARTITION BY pos) AS mean FROM dn),
    ts AS (SELECT pos, 0.5 * sum(abs(dh)) + 2 * avg(dc) + 0.5 * (abs(sum(dh * bin)) / 255) AS score FROM (SELECT pos, bin, share - lag(share) OVER (PARTITION BY bin ORDER BY pos) AS dh, abs(cdf - lag(cdf) OVER (PARTITION BY bin ORDER BY pos)) AS dc FROM dp) GROUP BY pos),
    wm AS (SELECT f.pos AS first, dp.* FROM fp f JOIN dp ON dp.pos BETWEEN f.pos AND f.pos + 4 WHERE f.pos BETWEEN 1 AND f.n - 5),
    wr AS (SELECT first, bin, median(share) AS rs, median(cdf) AS rc, median(mean) AS rm FROM wm GROUP BY ALL),
    wd AS (SELECT first, pos, 0.5 * sum(abs(share - rs)) + 2 * avg(abs(cdf - rc)) + 0.5 * abs(any_value(mean) - any_value(rm)) AS constancy FROM wm JOIN wr USING (first, bin) GROUP BY ALL),
    wj AS (SELECT first, max(score) FILTER (WHERE pos = first) AS jump, quantile_cont(score, 0.9) FILTER (WHERE pos > first) AS post_p90, median(score) FILTER (WHERE pos > first) AS post_median, quantile_cont(constancy, 0.9) AS constancy_p90 FROM wd JOIN ts USING (pos) GROUP BY first),
    md AS (SELECT any_value(m) AS m, greatest(median(abs(score - m)), 1e-6) AS mad FROM ts, (SELECT median(score) AS m FROM ts))"""
)


@query(
    "stable_windows",
    sql(
        "pixels",
        f"""SELECT first, frame_id AS first_stable_frame, jump, post_p90, post_median, constancy_p90, m + 3 * mad AS threshold, {_settled("jump")} >= {_settled("greatest(m + 6 * mad, 3 * greatest(post_p90, constancy_p90, 1e-6))")}
        AND {_settled("post_p90")} <= {_settled("greatest(m + 3 * mad, 0.25 * jump)")} AND {_settled("constancy_p90")} <= {_settled("greatest(m + 3 * mad, 0.2 * jump)")} AS is_candidate FROM wj JOIN fp ON fp.pos = first, md""",
        "CAST(first AS INTEGER) AS first, first_stable_frame, is_candidate",
        "jump post_p90 post_median constancy_p90 threshold",
        _WIN,
    ),
)
def _(spark, sf_dir):
    return trim.stable_windows(frames.histogram(views.pixels(spark, sf_dir), 256), 5)


# --- streams -----------------------------------------------------------------------------------------------------------


_DAYS = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL"
_LAST = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("events_tumbling_stream", sql("", f"SELECT * FROM ({_DAYS}) WHERE day + INTERVAL 1 DAY <= {_LAST}", "strftime(day, '%Y-%m-%d') AS day, event_type, n, cents", "", ""))
def _(spark, sf_dir):
    """The table as a stream, run to its end: the windows that the watermark has closed."""
    out = stateful.to_table(stateful.tumbling(stateful.read_events(spark, sf_dir, 8, "events.parquet")), "tumbling")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


@query(
    "events_sliding_stream",
    sql("", f"SELECT day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS day, event_type FROM events, (VALUES (0), (1)) t(k)) GROUP BY ALL HAVING day + INTERVAL 2 DAY <= {_LAST}", "strftime(day, '%Y-%m-%d') AS day, event_type, n", "", ""),
)
def _(spark, sf_dir):
    out = stateful.to_table(stateful.sliding(stateful.read_events(spark, sf_dir, 8, "events.parquet")), "sliding")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "events_sessions_stream",
    sql(
        "",
        f"SELECT user_id, min(ts) AS begun, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_LAST}",
        "user_id, strftime(begun, '%Y-%m-%d %H:%M:%S') AS begun, n",
        "",
        "",
    ),
)
def _(spark, sf_dir):
    out = stateful.to_table(stateful.sessions(stateful.read_events(spark, sf_dir, 8, "events.parquet")), "sessions")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begun"), "n")


def _streamed(rows: DataFrame, part, make) -> DataFrame:
    """Write `rows` as files of the shared folder by `part` and run the stream `make` over them, a file at a time."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/files_{uuid4().hex}"
    try:
        stateful.dealt(rows, part, folder)
        return stateful.to_table(make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)), "stream")
    finally:
        stateful.remove(spark, folder)


# Hotspots of each event type as a sequence; frames are days, closed once the watermark, three days behind, is past their end.
_STREAM_TRACKS = """hs AS (SELECT event_type AS sequence, ts, CAST(dayofyear(ts) AS INTEGER) AS frame_id, event_id AS hotspot_id, CASE WHEN event_id % 7 > 0 THEN user_id % 15 END AS hole, CAST(event_id % 60 AS DOUBLE) AS x, CAST(event_id % 47 AS DOUBLE) AS y, CAST(event_id % 50 + 12 AS DOUBLE) AS area, value AS score FROM events
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)),
    lc0 AS (SELECT b.sequence, b.frame_id, a.hotspot_id AS p, b.hotspot_id AS h, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, greatest(a.area, b.area) / greatest(least(a.area, b.area), 1.0) AS r, abs(a.score - b.score) AS s
      FROM hs a JOIN hs b ON b.sequence = a.sequence AND b.frame_id = a.frame_id + 1 WHERE a.hole IS NULL OR b.hole IS NULL OR a.hole = b.hole),
    lo AS (SELECT sequence, frame_id, p, h, row_number() OVER (PARTITION BY sequence, frame_id ORDER BY c, p, h) AS k, count(*) OVER (PARTITION BY sequence, frame_id) AS n FROM (SELECT *, floor((d + 0.5 * r + 0.25 * s) * 1e9 + 0.5) AS c FROM lc0 WHERE d <= 18 AND r <= 3)),
    lw AS (SELECT sequence, frame_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS hh, max(n) AS n FROM lo GROUP BY ALL UNION ALL
      SELECT w.sequence, w.frame_id, o.k, CASE WHEN list_contains(ps, p) OR list_contains(hh, h) THEN ps ELSE list_append(ps, p) END, CASE WHEN list_contains(ps, p) OR list_contains(hh, h) THEN hh ELSE list_append(hh, h) END, w.n
      FROM lw w JOIN lo o ON o.sequence = w.sequence AND o.frame_id = w.frame_id AND o.k = w.k + 1),
    lk AS (SELECT sequence, frame_id, unnest(ps) AS p, unnest(hh) AS h FROM lw WHERE k = n),
    tk AS (SELECT sequence, frame_id, hotspot_id, frame_id AS hf, hotspot_id AS hh FROM hs WHERE hotspot_id NOT IN (SELECT h FROM lk)
      UNION ALL SELECT tk.sequence, lk.frame_id, lk.h, tk.hf, tk.hh FROM tk JOIN lk ON lk.sequence = tk.sequence AND lk.frame_id = tk.frame_id + 1 AND lk.p = tk.hotspot_id)"""


@query("hotspot_tracks_stream", recursive(sql("", "SELECT sequence, frame_id, hotspot_id, dense_rank() OVER (PARTITION BY sequence ORDER BY hf, hh) - 1 AS track_id FROM tk", "sequence, frame_id, hotspot_id, track_id", "", _STREAM_TRACKS)))
def _(spark, sf_dir):
    """Tracks carried as state over four files, some rows of which come a file later than the others of their frame."""
    ends = F.unix_millis((F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
    rows = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("event_type").alias("sequence"), "ts", F.dayofyear("ts").alias("frame_id"), ends.alias("ends"), F.col("event_id").alias("hotspot_id"), F.when(F.col("event_id") % 7 > 0, F.col("user_id") % 15).alias("nearest_hole_id"),
        (F.col("event_id") % 60).alias("x"), (F.col("event_id") % 47).alias("y"), (F.col("event_id") % 50 + 12).alias("area_px"), F.col("value").alias("score"),
    )
    part = F.expr("(frame_id + hotspot_id % 3) div 9")
    return _streamed(rows, part, lambda stream: stateful.tracked(stream, 18.0, 3.0, "3 days"))


@query("histogram_jumps_stream", ORACLE["histogram_jumps"])
def _(spark, sf_dir):
    """Pixels dealt to three files by a hash, so that every frame comes in parts and out of order."""
    rows = views.pixels(spark, sf_dir).select(F.lit("all").alias("sequence"), "frame_id", "r", "g", "b")
    told = _streamed(rows, F.pmod(F.xxhash64("frame_id", "r", "g", "b"), F.lit(3)), stateful.histogram_jumps)
    return stateful.latest(told, ["sequence", "frame_id"]).select("frame_id", "jump")


@query("baselines_stream", sql("radial", "SELECT *, descriptor_value - baseline_descriptor_value AS delta_descriptor_value FROM (SELECT *, first_value(descriptor_value) OVER (PARTITION BY hole_id, annulus_id ORDER BY frame_id) AS baseline_descriptor_value FROM radial)", "hole_id, annulus_id, frame_id", "descriptor_value baseline_descriptor_value delta_descriptor_value"))
def _(spark, sf_dir):
    """Measures dealt to three files by a hash: first frames come late, and baselines correct themselves."""
    rows = views.measures(spark, sf_dir)
    told = _streamed(rows, F.pmod(F.xxhash64("hole_id", "frame_id", "cents"), F.lit(3)), stateful.first_frame_deltas)
    return stateful.latest(told, ["hole_id", "annulus_id", "frame_id"]).drop("baseline_frame_id")


# --- sweeps, mixtures --------------------------------------------------------------------------------------------------

_GRID = ", ".join(f"({i * 3 + k}, CAST({b} AS DOUBLE), CAST({r} AS DOUBLE))" for i, b in enumerate(sweeps.BRIGHTNESS) for k, r in enumerate(sweeps.RADIUS))
_SWEPT = f"""grid(sweep_id, bs, rs) AS (VALUES {_GRID}),
    sw AS (SELECT sweep_id, bs AS brightness_scale, rs AS radius_scale, hole_id, frame_id, CAST(floor(annulus_id * rs + 1e-9) AS INTEGER) AS annulus_id, avg(least(descriptor_value * bs, 1.0)) AS v FROM radial, grid GROUP BY ALL),
    sa AS (SELECT sweep_id, brightness_scale, radius_scale, frame_id, annulus_id, avg(v) AS v FROM sw GROUP BY ALL), {_profile("spr", "sa", "sweep_id, brightness_scale, radius_scale, frame_id", "v")},
    sr AS ({_summary("sweep_id, brightness_scale, radius_scale", "spr")}), sb AS (SELECT radial_conclusion_label AS bl, delta_center_of_mass AS bd FROM sr WHERE brightness_scale = 1 AND radius_scale = 1),
    sc AS (SELECT y.sweep_id, y.frame_id, CASE WHEN stddev_pop(x.v) < 1e-9 OR stddev_pop(y.v) < 1e-9 THEN CASE WHEN max(abs(x.v - y.v)) < 1e-9 THEN 1.0 ELSE 0.0 END ELSE (avg(x.v * y.v) - avg(x.v) * avg(y.v)) / (stddev_pop(x.v) * stddev_pop(y.v)) END AS c
      FROM sa y JOIN sa x ON x.frame_id = y.frame_id AND x.annulus_id = y.annulus_id AND x.brightness_scale = 1 AND x.radius_scale = 1 GROUP BY ALL)"""


@query(
    "perturbation_sweeps",
    sql(
        "radial",
        "SELECT sr.sweep_id, brightness_scale, radius_scale, radial_conclusion_label, radial_conclusion_label = bl AS conclusion_stable, delta_center_of_mass - bd AS center_drift, m.profile_correlation FROM sr, sb, (SELECT sweep_id, avg(c) AS profile_correlation FROM sc GROUP BY 1) m WHERE m.sweep_id = sr.sweep_id",
        "sweep_id, radial_conclusion_label, conclusion_stable",
        "brightness_scale radius_scale center_drift profile_correlation",
        _SWEPT,
    ),
)
def _(spark, sf_dir):
    return sweeps.compare(views.radial_rows(spark, sf_dir))


@query(
    "transition_candidates",
    sql(
        "pixels",
        "SELECT frame_id, score, m + 6 * mad AS threshold, score >= m + 6 * mad AS is_jump FROM ts, (SELECT median(abs(score - m)) AS mad, any_value(m) AS m FROM ts, (SELECT median(score) AS m FROM ts))",
        "frame_id, is_jump",
        "score threshold",
        _GREY + ", dn AS (SELECT f.frame_id, CAST(k AS INTEGER) AS bin, coalesce(hi.share, 0.0) AS share FROM (SELECT DISTINCT frame_id FROM hi) f CROSS JOIN range(256) t(k) LEFT JOIN hi ON hi.frame_id = f.frame_id AND hi.bin = k), dc0 AS (SELECT *, sum(share) OVER (PARTITION BY frame_id ORDER BY bin) AS cdf FROM dn), ts AS (SELECT * FROM (SELECT frame_id, 0.5 * sum(abs(dh)) + 2 * avg(dc) + 0.5 * (abs(sum(dh * bin)) / 255) AS score FROM (SELECT frame_id, bin, share - lag(share) OVER (PARTITION BY bin ORDER BY frame_id) AS dh, abs(cdf - lag(cdf) OVER (PARTITION BY bin ORDER BY frame_id)) AS dc FROM dc0) GROUP BY ALL) WHERE score IS NOT NULL)",
    ),
)
def _(spark, sf_dir):
    return sweeps.transition_candidates(frames.transition_scores(frames.histogram(views.pixels(spark, sf_dir), 256)))


def _dense_pixels(spark, sf_dir):
    """The same pixels on 16 x 16 places, so that blocks of four are full."""
    return _placed_pixels(spark, sf_dir).withColumn("y", F.col("y") % 16).withColumn("x", F.col("x") % 16)


# Whole luma of 16 x 16 places, blocks of four and their details; the audit record of each frame.
_WHOLE = _PLACED + """, d16 AS (SELECT frame_id, y % 16 AS y, x % 16 AS x, r, g, b FROM placed), frs AS (SELECT DISTINCT frame_id FROM d16),
    wg AS (SELECT frame_id, y, x, CAST(floor(avg((299 * r + 587 * g + 114 * b) // 1000)) AS DOUBLE) AS v FROM d16 GROUP BY ALL)"""
_BLUR = _WHOLE + """, bk AS (SELECT frame_id, y // 2 AS cy, x // 2 AS cx, max(v) FILTER (WHERE x % 2 = 0 AND y % 2 = 0) / 255 AS a, max(v) FILTER (WHERE x % 2 = 1 AND y % 2 = 0) / 255 AS b, max(v) FILTER (WHERE x % 2 = 0 AND y % 2 = 1) / 255 AS c, max(v) FILTER (WHERE x % 2 = 1 AND y % 2 = 1) / 255 AS d FROM wg GROUP BY ALL),
    bl AS (SELECT frame_id, avg(abs(a - b + c - d) / 2) + avg(abs(a + b - c - d) / 2) + avg(abs(a - b - c + d) / 2) AS blur_score FROM bk WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY frame_id)"""
_LAPLACE = _WHOLE + """, gr AS (SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, coalesce(v, 0.0) AS v FROM (SELECT frame_id, i AS y, j AS x FROM frs, range(16) a(i), range(16) c(j)) LEFT JOIN wg USING (frame_id, y, x)),
    lp AS (SELECT p.frame_id, var_pop(n.s - 4 * p.v) AS blur_score FROM gr p JOIN (SELECT p.frame_id, p.y, p.x, sum(q.v) AS s FROM gr p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)
      JOIN gr q ON q.frame_id = p.frame_id AND q.y = CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy > 15 THEN 14 ELSE p.y + dy END AND q.x = CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx > 15 THEN 14 ELSE p.x + dx END GROUP BY ALL) n USING (frame_id, y, x) GROUP BY p.frame_id)"""
_AUDIT = _BLUR + """, hi AS (SELECT frame_id, bin, n, n / sqrt(sum(n * n) OVER (PARTITION BY frame_id)) AS u FROM (SELECT frame_id, CAST(((299 * r + 587 * g + 114 * b) // 1000) * 64 // 256 AS INTEGER) AS bin, count(*) AS n FROM d16 GROUP BY ALL)),
    fb AS (SELECT frame_id, lag(frame_id) OVER (ORDER BY frame_id) AS before FROM frs),
    ju AS (SELECT frame_id, CASE WHEN before IS NULL THEN 0.0 ELSE sqrt(greatest(2 - 2 * dot, 0.0)) END AS jump FROM (SELECT fb.frame_id, fb.before, sum(a.u * coalesce(b.u, 0.0)) AS dot FROM fb JOIN hi a ON a.frame_id = fb.frame_id LEFT JOIN hi b ON b.frame_id = fb.before AND b.bin = a.bin GROUP BY ALL)),
    sa AS (SELECT frame_id, avg(CAST(r >= 250 AS DOUBLE)) AS saturation_r, avg(CAST(g >= 250 AS DOUBLE)) AS saturation_g, avg(CAST(b >= 250 AS DOUBLE)) AS saturation_b FROM d16 GROUP BY ALL),
    au AS (SELECT *, greatest(saturation_r, saturation_g, saturation_b) < 0.05 AND coalesce(floor(blur_score * 1e9 + 0.5) / 1e9 >= 0.48, false) AS accepted FROM sa LEFT JOIN bl USING (frame_id) JOIN ju USING (frame_id))"""
SIDE, LEAST_BLUR = 16, 0.48


@query("haar_blur", sql("", "SELECT * FROM bl", "frame_id", "blur_score", _BLUR))
def _(spark, sf_dir):
    return stencils.haar_blur(_dense_pixels(spark, sf_dir), SIDE, SIDE)


@query("laplacian_blur", sql("", "SELECT * FROM lp", "frame_id", "blur_score", _LAPLACE))
def _(spark, sf_dir):
    return stencils.laplacian_blur(_dense_pixels(spark, sf_dir), SIDE, SIDE)


def _audit(spark, sf_dir):
    px = checkpointed(_dense_pixels(spark, sf_dir))
    return frames.audit(px, stencils.haar_blur(px, SIDE, SIDE), LEAST_BLUR)


@query("frame_audit", sql("", "SELECT * FROM au", "frame_id, accepted", "blur_score saturation_r saturation_g saturation_b jump", _AUDIT))
def _(spark, sf_dir):
    return _audit(spark, sf_dir)


@query("reference_frame", sql("", "SELECT coalesce(arg_max(frame_id, {'s': floor(blur_score * 1e9 + 0.5), 'f': -frame_id}) FILTER (WHERE accepted), min(frame_id)) AS reference_frame_id, bool_or(accepted) AS accepted FROM au", "reference_frame_id, accepted", "", _AUDIT))
def _(spark, sf_dir):
    return sweeps.reference_frame(_audit(spark, sf_dir).withColumn("blur_score", settled(F.col("blur_score"))), "blur_score")


def _gauss(sigma: int) -> str:
    """Weights w from place a to place b of a line of 16, its ends mirrored again and again."""
    reach = 4 * sigma
    return f"""kn{sigma} AS (SELECT k, exp(-0.5 * (k / {sigma}.0) ** 2) AS e FROM range(-{reach}, {reach + 1}) t(k)),
    wt{sigma} AS (SELECT a, CASE WHEN m > 15 THEN 30 - m ELSE m END AS b, sum(e) AS w FROM (SELECT i AS a, ((i + k) % 30 + 30) % 30 AS m, e / (SELECT sum(e) FROM kn{sigma}) AS e FROM range(16) r(i), kn{sigma}) GROUP BY ALL)"""


_LUMA = "(299 * r + 587 * g + 114 * b) / 1000"
_FLAT = _PLACED + f""", d16 AS (SELECT frame_id, y % 16 AS y, x % 16 AS x, r, g, b FROM placed), gy AS (SELECT frame_id, y, x, avg({_LUMA}) AS v FROM d16 GROUP BY ALL), {_gauss(32)}, {_gauss(5)},
    g1 AS (SELECT frame_id, y, a AS x, sum(v * w) AS v FROM gy JOIN wt32 ON b = x GROUP BY ALL), g2 AS (SELECT frame_id, a AS y, x, greatest(sum(v * w), 1.0) AS v FROM g1 JOIN wt32 ON b = y GROUP BY ALL),
    gm AS (SELECT frame_id, y, x, floor(avg(v) OVER (PARTITION BY frame_id) / v * 1e9 + 0.5) / 1e9 AS k FROM g2),
    ff AS (SELECT frame_id, y, x, {", ".join(f"floor(least(greatest(floor({c} * k * 1e9 + 0.5) / 1e9, 0.0), 255.0)) AS {c}" for c in "rgb")} FROM d16 JOIN gm USING (frame_id, y, x)),
    h1 AS (SELECT frame_id, y, a AS x, sum(v * w) AS v FROM gy JOIN wt5 ON b = x GROUP BY ALL), h2 AS (SELECT frame_id, a AS y, x, sum(v * w) AS v FROM h1 JOIN wt5 ON b = y GROUP BY ALL),
    pp AS (SELECT frame_id, coalesce(avg(o) FILTER (WHERE o > 0), 0.0) AS prominence FROM (SELECT frame_id, floor((gy.v - h2.v) * 1e9 + 0.5) / 1e9 AS o FROM gy JOIN h2 USING (frame_id, y, x)) GROUP BY frame_id)"""


@query("flat_field", sql("", "SELECT frame_id, y, x, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM ff GROUP BY ALL", "frame_id, y, x, n, r, g, b", "", _FLAT))
def _(spark, sf_dir):
    even = stencils.flat_field(_dense_pixels(spark, sf_dir), SIDE, SIDE)
    return even.groupBy("frame_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


@query("positive_prominence", sql("", "SELECT * FROM pp", "frame_id", "prominence", _FLAT))
def _(spark, sf_dir):
    return stencils.positive_prominence(_dense_pixels(spark, sf_dir), SIDE, SIDE)


_EDGE = _FLAT + """, gw AS (SELECT frame_id AS f, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (avg(r) + avg(g) + avg(b)) / 3 AS t FROM d16 GROUP BY ALL),
    ways AS (SELECT 'none' AS method, frame_id, y, x, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM d16 UNION ALL SELECT 'flat_field', frame_id, y, x, r, g, b FROM ff
      UNION ALL SELECT 'grey_world', frame_id, y, x, floor(least(greatest(r * t / greatest(mr, 1e-6), 0.0), 255.0)), floor(least(greatest(g * t / greatest(mg, 1e-6), 0.0), 255.0)), floor(least(greatest(b * t / greatest(mb, 1e-6), 0.0), 255.0)) FROM d16 JOIN gw ON f = frame_id),
    pl AS (SELECT method, frame_id, y, x, avg((299 * r + 587 * g + 114 * b) / 1000) AS l FROM ways GROUP BY ALL),
    sob AS (SELECT p.method, p.frame_id, p.y, p.x, sum(dx * (2 - abs(dy)) * coalesce(q.l, 0.0)) AS gx, sum(dy * (2 - abs(dx)) * coalesce(q.l, 0.0)) AS gy FROM pl p CROSS JOIN (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) c(dx)
      LEFT JOIN pl q ON q.method = p.method AND q.frame_id = p.frame_id AND q.y = CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy > 15 THEN 14 ELSE p.y + dy END AND q.x = CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx > 15 THEN 14 ELSE p.x + dx END GROUP BY ALL),
    en AS (SELECT method, frame_id, avg(sqrt(gx * gx + gy * gy)) FILTER (WHERE o) / greatest(avg(sqrt(gx * gx + gy * gy)) FILTER (WHERE NOT o), 1e-6) AS edge_energy_ratio FROM (SELECT *, y < 2 OR y >= 14 OR x < 2 OR x >= 14 AS o FROM sob) GROUP BY ALL)"""


def _corrections(spark, sf_dir):
    px = checkpointed(_dense_pixels(spark, sf_dir))  # every correction starts from them
    ways = {"none": px, "grey_world": pixels.grey_world(px), "flat_field": stencils.flat_field(px, SIDE, SIDE)}
    return gates.union([stencils.edge_energy(p, SIDE, SIDE, 2).withColumn("method", F.lit(name)) for name, p in ways.items()])


@query("edge_energy", sql("", "SELECT * FROM en", "method, frame_id", "edge_energy_ratio", _EDGE))
def _(spark, sf_dir):
    return _corrections(spark, sf_dir).select("method", "frame_id", "edge_energy_ratio")


@query("correction_choice", sql("", "SELECT arg_min(method, {'s': s, 'm': method}) AS method, min(s) AS score FROM (SELECT method, avg(edge_energy_ratio) AS s FROM en GROUP BY method)", "method", "score", _EDGE))
def _(spark, sf_dir):
    return frames.best_correction(_corrections(spark, sf_dir).withColumnRenamed("edge_energy_ratio", "score"))


# Places that some pixel of the frame darkens make the region.
_REGION = _PLACED + """, rg AS (SELECT DISTINCT frame_id, y % 16 AS y, x % 16 AS x FROM placed WHERE r < 250), al AS (SELECT frame_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x FROM (SELECT DISTINCT frame_id FROM rg), range(16) a(i), range(16) c(j)),
    ou AS (SELECT * FROM al ANTI JOIN rg USING (frame_id, y, x)),
    di AS (SELECT rg.frame_id, rg.y, rg.x, sqrt(min((rg.y - ou.y) ** 2 + (rg.x - ou.x) ** 2)) AS distance FROM rg JOIN ou ON ou.frame_id = rg.frame_id GROUP BY ALL),
    dt AS (SELECT *, CAST(floor(floor(distance * 3 / max(distance) OVER (PARTITION BY frame_id) * 1e9 + 0.5) / 1e9) AS INTEGER) AS terrace FROM di)"""


@query("distance_terraces", sql("", "SELECT * FROM dt WHERE terrace < 3", "frame_id, y, x, terrace", "distance", _REGION))
def _(spark, sf_dir):
    return stencils.distance_terraces(_dense_pixels(spark, sf_dir).where("r < 250").select("frame_id", "y", "x").distinct(), SIDE, SIDE, 3)


# Stand-ins: frames divisible by three have a mask of their size, others one of another size, every second a circle.
_SUPPORTED = _PLACED + """, fr AS (SELECT DISTINCT frame_id FROM placed), mk AS (SELECT DISTINCT frame_id, CASE WHEN frame_id % 3 = 0 THEN 16 ELSE 8 END AS height, 16 AS width, y % 16 AS y, x % 16 AS x FROM placed WHERE g < 200),
    ci AS (SELECT frame_id, 7.5 AS x, frame_id % 5 + 4.0 AS y, 5.0 AS radius FROM fr WHERE frame_id % 2 = 0),
    su AS (SELECT frame_id, y, x FROM mk WHERE height = 16 UNION ALL SELECT fr.frame_id, i, j FROM fr CROSS JOIN range(16) a(i) CROSS JOIN range(16) c(j) LEFT JOIN ci ON ci.frame_id = fr.frame_id WHERE fr.frame_id % 3 <> 0 AND (ci.frame_id IS NULL OR (j - ci.x) ** 2 + (i - ci.y) ** 2 <= ci.radius ** 2))"""


def _supported(spark, sf_dir):
    px = _dense_pixels(spark, sf_dir)
    ids = px.select("frame_id").distinct()
    mask = px.where("g < 200").select("frame_id", F.when(F.col("frame_id") % 3 == 0, 16).otherwise(8).alias("height"), F.lit(16).alias("width"), "y", "x")
    circle = ids.where("frame_id % 2 = 0").select("frame_id", F.lit(7.5).alias("x"), (F.col("frame_id") % 5 + 4.0).alias("y"), F.lit(5.0).alias("radius"))
    return stencils.support(SIDE, SIDE, ids, mask, circle)


@query("support_places", sql("", "SELECT frame_id, count(*) AS n, CAST(sum(y * 16 + x) AS BIGINT) AS places FROM su GROUP BY frame_id", "frame_id, n, places", "", _SUPPORTED))
def _(spark, sf_dir):
    return _supported(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 16 + F.col("x")).alias("places"))


_GUARD = """fh AS (SELECT f AS frame_id, hole_id, radius_outer_px FROM holes, range(3) t(f) WHERE hole_id % 3 <= f), mx AS (SELECT CAST(max(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM fh GROUP BY frame_id)), md AS (SELECT median(radius_outer_px) AS m FROM fh),
    ar AS (SELECT count(*) AS a FROM (SELECT DISTINCT y, x FROM placed))"""


@query(
    "radial_input_guard",
    sql(
        "holes",
        "SELECT n <= p AS ok, CASE WHEN n > p THEN 'hole_count_exceeds_physical_nonoverlap_limit' END AS reason, n AS max_frame_holes, p AS physical_max_holes, m AS median_hole_radius_px, a AS support_area_px FROM (SELECT n, m, a, CAST(greatest(1, floor(a / (pi() * m * m))) AS BIGINT) AS p FROM mx, md, ar)",
        "ok, reason, max_frame_holes, physical_max_holes, support_area_px",
        "median_hole_radius_px",
        _PLACED + ", " + _GUARD,
    ),
)
def _(spark, sf_dir):
    """Holes by three frames, which have more of them one after the other; the places with pixels are the support."""
    of = views.holes(spark, sf_dir).withColumn("frame_id", F.explode(F.array(*[F.lit(f) for f in range(3)]))).where("hole_id % 3 <= frame_id")
    return gates.radial_input_guard(of.select("frame_id").distinct(), of, _placed_pixels(spark, sf_dir))


_PLACES = _RESP + """, on_ AS (SELECT hole_id, min(frame_id) AS onset_frame FROM resp WHERE response > 0.4 AND hole_id % 4 <> 1 GROUP BY ALL),
    rp AS (SELECT r.hole_id, CASE WHEN r.hole_id % 5 = 0 THEN '' ELSE 'P' || CAST(r.hole_id % 3 AS VARCHAR) END AS phenotype_label, any_value(o.onset_frame) AS onset_frame,
      arg_min(r.frame_id, {'r': coalesce(-floor(response * 1e9 + 0.5), 1e300), 'f': r.frame_id}) AS peak_frame, floor(coalesce(sum(response), 0.0) * 1e9 + 0.5) / 1e9 AS integrated_response FROM resp r LEFT JOIN on_ o ON o.hole_id = r.hole_id GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (ORDER BY phenotype_label, onset_frame NULLS LAST, peak_frame, integrated_response DESC, hole_id) - 1 AS place FROM rp)"""


def _response_places(spark, sf_dir):
    """Stand-in labels by hole, none for every fifth; onsets are the first frames above 0.4, none for every fourth."""
    response = activity.hole_response(views.cluster_tensor(spark, sf_dir))
    holes = response.select("hole_id").distinct()
    labels = holes.where("hole_id % 5 <> 0").select("hole_id", F.concat(F.lit("P"), (F.col("hole_id") % 3).cast("string")).alias("phenotype_label"))
    onsets = activity.onsets(response.where("hole_id % 4 <> 1"), 0.4)
    return response, activity.response_places(response, labels, onsets)


@query("response_places", sql("tensor", "SELECT * FROM pl", "place, hole_id, phenotype_label, onset_frame, peak_frame", "integrated_response", _PLACES))
def _(spark, sf_dir):
    return _response_places(spark, sf_dir)[1]


@query("response_barcode", sql("tensor", "SELECT place, pl.hole_id, f.frame_id, response FROM pl CROSS JOIN (SELECT DISTINCT frame_id FROM resp) f LEFT JOIN resp ON resp.hole_id = pl.hole_id AND resp.frame_id = f.frame_id", "place, hole_id, frame_id", "response", _PLACES))
def _(spark, sf_dir):
    return activity.barcode(*_response_places(spark, sf_dir))


# --- shares by hole, colours of frames, perturbed pixels and holes --------------------------------------------------------


_HOLE_FRONTS = _pooled("ph", "frame_id, hole_id, terrace_index") + """, hp AS (SELECT frame_id, cluster_id, hole_id, sum(pixel_fraction) AS p, sum((terrace_index + 1) * pixel_fraction) AS tp FROM ph GROUP BY ALL),
    hf AS (SELECT frame_id, cluster_id, avg(own) AS hole_mean_weighted_mean_terrace, stddev_pop(own) AS hole_sd_weighted_mean_terrace, quantile_cont(own, 0.1) AS hole_q10_weighted_mean_terrace, quantile_cont(own, 0.9) AS hole_q90_weighted_mean_terrace, count(own) AS n_holes
      FROM (SELECT *, CASE WHEN p > 0 THEN tp / greatest(p, 1e-12) END AS own FROM hp) GROUP BY ALL),
    hm AS (SELECT frame_id, cluster_id, sum((terrace_index + 1) * pixel_fraction) / greatest(sum(pixel_fraction), 1e-12) AS weighted_mean_terrace, arg_max(terrace_index, {'v': floor(pixel_fraction * 1e9 + 0.5), 'k': -terrace_index}) + 1 AS peak_terrace, max(terrace_index + 1) FILTER (WHERE pixel_fraction >= 0.15) AS outer_front_terrace FROM ph GROUP BY ALL)"""
_HOLE_FRONTS_M = "weighted_mean_terrace hole_mean_weighted_mean_terrace hole_sd_weighted_mean_terrace hole_q10_weighted_mean_terrace hole_q90_weighted_mean_terrace"


@query("hole_front_metrics", sql("tensor", "SELECT * FROM hm JOIN hf USING (frame_id, cluster_id)", "frame_id, cluster_id, CAST(peak_terrace AS INTEGER) AS peak_terrace, CAST(outer_front_terrace AS INTEGER) AS outer_front_terrace, n_holes", _HOLE_FRONTS_M, _HOLE_FRONTS))
def _(spark, sf_dir):
    return activity.hole_front_metrics(views.cluster_tensor(spark, sf_dir))


@query("full_cluster_tensor", sql("tensor", "SELECT f.frame_id, f.hole_id, f.terrace_index, f.sector_id, (f.sector_id + 0.5) * 90.0 AS theta_center_deg, k.cluster_id, CAST(coalesce(t.pixel_count, 0) AS BIGINT) AS pixel_count, coalesce(t.pixel_count, 0) / f.n AS pixel_fraction, CAST(f.n AS BIGINT) AS n_valid_pixels FROM (SELECT frame_id, hole_id, terrace_index, sector_id, sum(pixel_count) AS n FROM tensor GROUP BY ALL) f CROSS JOIN (SELECT DISTINCT cluster_id FROM tensor) k LEFT JOIN tensor t ON t.frame_id = f.frame_id AND t.hole_id = f.hole_id AND t.terrace_index = f.terrace_index AND t.sector_id = f.sector_id AND t.cluster_id = k.cluster_id", "frame_id, hole_id, terrace_index, sector_id, cluster_id, pixel_count, n_valid_pixels", "theta_center_deg pixel_fraction"))
def _(spark, sf_dir):
    return activity.full_tensor(views.cluster_tensor(spark, sf_dir), 4)


_CONSISTENT = _pooled("hc", "frame_id, terrace_index, hole_id") + ", " + _pooled("wc", "frame_id, terrace_index") + """, hx AS (SELECT h.frame_id, h.terrace_index, h.hole_id, coalesce(p.pixel_fraction, 0.0) AS p, w.pixel_fraction AS q FROM (SELECT DISTINCT frame_id, terrace_index, hole_id FROM hc) h JOIN wc w ON w.frame_id = h.frame_id AND w.terrace_index = h.terrace_index
      LEFT JOIN hc p ON p.frame_id = h.frame_id AND p.terrace_index = h.terrace_index AND p.hole_id = h.hole_id AND p.cluster_id = w.cluster_id),
    hj AS (SELECT frame_id, terrace_index, hole_id, 1 - sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0.0 END) / 2 AS s FROM hx GROUP BY ALL)"""


@query("hole_consistency", sql("tensor", "SELECT frame_id, terrace_index, avg(s) AS mean_js_similarity, stddev_pop(s) AS sd_js_similarity, count(s) AS n_holes FROM hj GROUP BY ALL", "frame_id, terrace_index, n_holes", "mean_js_similarity sd_js_similarity", _CONSISTENT))
def _(spark, sf_dir):
    return activity.hole_consistency(views.cluster_tensor(spark, sf_dir))


_SIX = """hv AS (SELECT frame_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, (CAST(floor(30 * sixth + 0.5) AS BIGINT) % 180) / 179.0::DOUBLE AS h, floor(CASE WHEN hi = 0 THEN 0.0 ELSE 255 * c / hi END + 0.5) / 255.0::DOUBLE AS s, hi / 255.0::DOUBLE AS v FROM (
        SELECT *, CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN hi = r THEN (CASE WHEN (g - b) / c < 0 THEN (g - b) / c + 6 ELSE (g - b) / c END) WHEN hi = g THEN (b - r) / c + 2 ELSE (r - g) / c + 4 END AS sixth FROM (
        SELECT *, CAST(greatest(r, g, b) AS DOUBLE) AS hi, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS c FROM placed)))"""
_SERIES_M = " ".join([f"mean_{c}" for c in "rgbhsv"] + [f"std_{c}" for c in "rgb"])


@query("frame_colour_series", sql("", "SELECT frame_id, " + ", ".join([f"avg({c}) AS mean_{c}" for c in "rgbhsv"] + [f"stddev_pop({c}) AS std_{c}" for c in "rgb"]) + " FROM hv GROUP BY frame_id", "frame_id", _SERIES_M, f"{_PLACED}, {_SIX}"))
def _(spark, sf_dir):
    return frames.colour_series(_placed_pixels(spark, sf_dir))


@query("bulk_colour_series", sql("holes", "SELECT frame_id, " + ", ".join([f"avg({c}) AS mean_{c}" for c in "rgbhsv"] + [f"stddev_pop({c}) AS std_{c}" for c in "rgb"]) + " FROM hv WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE sqrt((hv.x - h.x) ** 2 + (hv.y - h.y) ** 2) <= h.radius_outer_px + 2) GROUP BY frame_id", "frame_id", _SERIES_M, f"{_PLACED}, {_SIX}"))
def _(spark, sf_dir):
    """The colours of what lies outside all holes."""
    return frames.colour_series(pixels.outside_holes(_placed_pixels(spark, sf_dir), views.holes(spark, sf_dir), 2.0))


@query("brightness_means", sql("", " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS factor, frame_id, " + ", ".join(f"avg(floor(least(floor({c} * {f} * 1e9 + 0.5) / 1e9, 255.0))) AS mean_{c}" for c in "rgb") + " FROM placed GROUP BY frame_id" for f in sweeps.BRIGHTNESS), "factor, frame_id", "mean_r mean_g mean_b", _PLACED))
def _(spark, sf_dir):
    px = _placed_pixels(spark, sf_dir)
    return gates.union([frames.brightness(px, f).groupBy("frame_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"]).withColumn("factor", F.lit(f)) for f in sweeps.BRIGHTNESS])


@query("scaled_holes", sql("holes", " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS factor, hole_id, greatest(radius_inner_px * {f}, 1.0) AS radius_inner_px, greatest(radius_outer_px * {f}, 1.0) AS radius_outer_px FROM holes" for f in (0.05, *sweeps.RADIUS)), "factor, hole_id", "radius_inner_px radius_outer_px"))
def _(spark, sf_dir):
    holes = views.holes(spark, sf_dir)
    return gates.union([lattice.scaled(holes, f).select("hole_id", "radius_inner_px", "radius_outer_px").withColumn("factor", F.lit(f)) for f in (0.05, *sweeps.RADIUS)])


@query("place_overlap", sql("", "SELECT i / (a + b - i) AS iou, i / least(a, b) AS overlap_fraction FROM (SELECT (SELECT count(*) FROM pa) AS a, (SELECT count(*) FROM pb) AS b, (SELECT count(*) FROM pa JOIN pb USING (y, x)) AS i)", "", "iou overlap_fraction", _PLACED + ", pa AS (SELECT DISTINCT y, x FROM placed WHERE frame_id < 14), pb AS (SELECT DISTINCT y, x FROM placed WHERE frame_id >= 14)"))
def _(spark, sf_dir):
    """The places of the first half of the frames against those of the second."""
    px = _placed_pixels(spark, sf_dir)
    return pixels.overlap(*[px.where(half).select("y", "x").distinct() for half in ("frame_id < 14", "frame_id >= 14")])


@query("first_hole_matrix", sql("radial", "SELECT frame_id, " + ", ".join(f"any_value(descriptor_value) FILTER (WHERE annulus_id = {i}) AS c{i}" for i in range(7)) + " FROM radial WHERE hole_id = (SELECT min(hole_id) FROM radial) GROUP BY frame_id", "frame_id", " ".join(f"c{i}" for i in range(7))))
def _(spark, sf_dir):
    """Frame x annulus of the first hole; one hole is the feature."""
    rows = views.radial_rows(spark, sf_dir)
    first = rows.agg(F.min("hole_id").alias("_first"))
    return reshape.matrix(rows.join(F.broadcast(first), F.col("hole_id") == F.col("_first")), "frame_id", "annulus_id", "descriptor_value", list(range(7)), "hole_id")


@query("bar_rows", sql("radial", "SELECT CAST(hole_id AS VARCHAR) AS label, coalesce(v, 0.0) AS value FROM (SELECT hole_id, avg(descriptor_value) FILTER (WHERE hole_id % 3 > 0) AS v FROM radial GROUP BY hole_id ORDER BY hole_id LIMIT 12)", "label", "value"))
def _(spark, sf_dir):
    """A plot's first bars: their limit is the feature."""
    means = views.radial_rows(spark, sf_dir).groupBy("hole_id").agg(F.avg(F.when(F.col("hole_id") % 3 > 0, F.col("descriptor_value"))).alias("v"))
    return reshape.bars(means, "hole_id", "v", "hole_id")


@query("last_lattice_places", sql("radial", "SELECT annulus_id, arg_max(lattice_u, {'f': frame_id, 'h': hole_id}) AS lattice_u, arg_max(lattice_v, {'f': frame_id, 'h': hole_id}) AS lattice_v FROM radial GROUP BY annulus_id", "annulus_id, lattice_u, lattice_v"))
def _(spark, sf_dir):
    """A lookup whose last row wins: for each annulus the place of the last hole of the last frame."""
    rows = views.radial_rows(spark, sf_dir).select("annulus_id", "frame_id", "hole_id", "lattice_u", "lattice_v")
    return reshape.last_rows(rows, ["annulus_id"], ["frame_id", "hole_id"]).select("annulus_id", "lattice_u", "lattice_v")


@query("snapshot_frames", sql("tensor", "SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS place, row_number() OVER (ORDER BY frame_id) <= 3 AS is_baseline FROM (SELECT DISTINCT frame_id FROM tensor)", "frame_id, place, is_baseline"))
def _(spark, sf_dir):
    return reshape.snapshot_frames(views.cluster_tensor(spark, sf_dir))


@query("hole_signatures", sql("radial", "SELECT hole_id, sha256(string_agg(m, '' ORDER BY m)) AS signature FROM (SELECT hole_id, md5(concat_ws('|', frame_id, annulus_id, area_px)) AS m FROM radial) GROUP BY hole_id", "hole_id, signature"))
def _(spark, sf_dir):
    return reshape.signatures(views.radial_rows(spark, sf_dir), ["hole_id"], ["frame_id", "annulus_id", "area_px"])


# --- geometry, records and raw frames ------------------------------------------------------------------------------------


_QUALITY = f"""ls AS (SELECT {_plane('x')}, {_plane('y')} FROM (SELECT x, y, CAST(lattice_u AS DOUBLE) AS u, CAST(lattice_v AS DOUBLE) AS v FROM holes)),
    lr AS (SELECT avg(sqrt((x - origin_x - a_x * lattice_u - b_x * lattice_v) ** 2 + (y - origin_y - a_y * lattice_u - b_y * lattice_v) ** 2)) AS residual_px FROM holes, ls),
    fq AS (SELECT *, 1 / (1 + residual_px / greatest(least(spacing_u_px, spacing_v_px), 1e-6)) AS confidence FROM (SELECT *, sqrt(a_x * a_x + a_y * a_y) AS spacing_u_px, sqrt(b_x * b_x + b_y * b_y) AS spacing_v_px FROM ls, lr))"""


def _quality(spark, sf_dir):
    holes = views.holes(spark, sf_dir)
    return lattice.fit_quality(holes, lattice.least_squares(holes))


@query("lattice_quality", sql("holes", "SELECT * FROM fq", "", "origin_x origin_y a_x a_y b_x b_y spacing_u_px spacing_v_px residual_px confidence", _QUALITY))
def _(spark, sf_dir):
    return _quality(spark, sf_dir).drop("n_holes")


_CHECKS = _PLACED + ", " + _QUALITY + """, hn AS (SELECT count(*) AS n, count(*) FILTER (WHERE sqrt((x - 280.0) ** 2 + (y - 280.0) ** 2) > 201.0) AS outside FROM holes), ar AS (SELECT count(*) AS area FROM (SELECT DISTINCT y, x FROM placed)),
    fz AS (SELECT coalesce(confidence, 0.0) AS confidence, coalesce(spacing_u_px, 0.0) AS su, coalesce(spacing_v_px, 0.0) AS sv FROM fq),
    cx AS (SELECT *, 12.0 / nullif(CASE WHEN su > 0 AND sv > 0 THEN least(su, sv) ELSE greatest(su, sv) END, 0.0) AS ratio, greatest(1, floor(area / (pi() * 144.0))) AS fits, area / 250000.0 AS share, area / 250000.0 > 0.985 AS whole FROM fz, hn, ar),
    ck AS (SELECT unnest([{'name': 'minimum_hole_count', 'passed': n >= 8, 'severity': 'fail', 'value': CAST(n AS DOUBLE)},
      {'name': 'lattice_confidence', 'passed': confidence >= CASE WHEN whole AND n >= 12 THEN 0.65 ELSE 0.75 END, 'severity': 'fail', 'value': confidence},
      {'name': 'radius_spacing_ratio', 'passed': coalesce(ratio BETWEEN 0.08 AND 0.42, false), 'severity': 'warn', 'value': ratio}, {'name': 'physical_nonoverlap_hole_count', 'passed': n <= fits, 'severity': 'fail', 'value': CAST(fits AS DOUBLE)},
      {'name': 'support_not_empty', 'passed': area > 0, 'severity': 'fail', 'value': CAST(area AS DOUBLE)}, {'name': 'support_is_object_specific', 'passed': NOT whole, 'severity': 'warn', 'value': share},
      {'name': 'full_frame_support_hole_count', 'passed': NOT (whole AND n > 180), 'severity': 'warn', 'value': CAST(n AS DOUBLE)},
      {'name': 'support_circle_scale', 'passed': true, 'severity': CASE WHEN whole THEN 'warn' ELSE 'fail' END, 'value': 200.0},
      {'name': 'hole_centers_inside_support', 'passed': outside = 0, 'severity': 'fail', 'value': CAST(outside AS DOUBLE)}], recursive := true) FROM cx),
    vd AS (SELECT count(*) FILTER (WHERE NOT passed AND severity = 'fail') AS fail_count, count(*) FILTER (WHERE NOT passed AND severity = 'warn') AS warning_count FROM ck)"""


def _checks(spark, sf_dir):
    """The places with pixels of a 500 x 500 frame are the support, in a circle around its middle."""
    return gates.geometry_checks(views.holes(spark, sf_dir), _quality(spark, sf_dir), 500, 500, 12.0, _placed_pixels(spark, sf_dir), (280.0, 280.0, 200.0))


@query("geometry_checks", sql("holes", "SELECT * FROM ck", "name, passed, severity", "value", _CHECKS))
def _(spark, sf_dir):
    return _checks(spark, sf_dir)


@query("geometry_verdict", sql("holes", "SELECT fail_count = 0 AS passed, CASE WHEN fail_count > 0 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'ok' END AS status, fail_count, warning_count FROM vd", "passed, status, fail_count, warning_count", "", _CHECKS))
def _(spark, sf_dir):
    return gates.verdict(_checks(spark, sf_dir))


@query(
    "run_summary",
    sql(
        "holes radial hotspots",
        """SELECT (SELECT count(*) FROM au) AS n_frames, (SELECT count(*) FROM au WHERE accepted) AS accepted_frames, (SELECT count(*) FROM au WHERE NOT accepted) AS rejected_frames, (SELECT arg_min(method, {'s': s, 'm': method}) FROM (SELECT method, avg(edge_energy_ratio) AS s FROM en GROUP BY method)) AS winner_correction,
        confidence AS lattice_confidence, spacing_u_px, spacing_v_px, degrees(atan2(a_y, a_x)) AS angle_deg, (SELECT coalesce(arg_max(frame_id, {'s': floor(blur_score * 1e9 + 0.5), 'f': -frame_id}) FILTER (WHERE accepted), min(frame_id)) FROM au) AS reference_frame_id,
        (SELECT CASE WHEN fail_count > 0 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'ok' END FROM vd) AS geometry_status, (SELECT count(*) FROM holes) AS n_candidates, (SELECT count(*) FROM radial) AS n_radial_rows, (SELECT count(*) FROM hotspots) AS n_hotspots FROM fq""",
        "n_frames, accepted_frames, rejected_frames, winner_correction, reference_frame_id, geometry_status, n_candidates, n_radial_rows, n_hotspots",
        "lattice_confidence spacing_u_px spacing_v_px angle_deg",
        _EDGE + ", " + _AUDIT.removeprefix(_PLACED + ", ").replace("d16", "e16") + ", " + _CHECKS.removeprefix(_PLACED + ", "),
    ),
)
def _(spark, sf_dir):
    audit = _audit(spark, sf_dir)
    winner = frames.best_correction(_corrections(spark, sf_dir).withColumnRenamed("edge_energy_ratio", "score"))
    reference = sweeps.reference_frame(audit.withColumn("blur_score", settled(F.col("blur_score"))), "blur_score")
    counted = {"n_candidates": views.holes(spark, sf_dir), "n_radial_rows": views.radial_rows(spark, sf_dir), "n_hotspots": views.hotspot_rows(spark, sf_dir)}
    return gates.run_summary(audit, winner, _quality(spark, sf_dir), reference, _checks(spark, sf_dir), counted)


# Every tenth hole has no place on the lattice, so that it has no neighbours.
_WIDTHS = """hw AS (SELECT * REPLACE (CASE WHEN hole_id % 10 = 7 THEN NULL ELSE lattice_u END AS lattice_u) FROM holes),
    nb AS (SELECT a.hole_id, count(*) AS n, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS c, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px) FILTER (WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px > 0) AS g
      FROM hw a JOIN hw b ON abs(a.lattice_u - b.lattice_u) + abs(a.lattice_v - b.lattice_v) = 1 GROUP BY a.hole_id),
    al AS (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS c, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px) FILTER (WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.radius_outer_px - b.radius_outer_px > 0) AS g FROM hw a JOIN hw b ON a.hole_id < b.hole_id),
    wp AS (SELECT h.hole_id, radius_outer_px, coalesce(n, 0) AS n, coalesce(nb.c, al.c) AS c, coalesce(nb.g, al.g) AS g, nb.g AS own FROM hw h LEFT JOIN nb USING (hole_id), al),
    wm AS (SELECT 'fixed' AS mode, *, greatest(2.5 * greatest(radius_outer_px, 8.0), 0.0) AS room, n = 0 OR own IS NULL AS global FROM wp UNION ALL SELECT 'half_gap', *, 0.5 * g, n = 0 OR own IS NULL FROM wp UNION ALL SELECT 'full_pitch', *, c, n = 0 FROM wp)"""


@query(
    "terrace_width_plans",
    sql(
        "holes",
        "SELECT mode, hole_id, n AS neighbor_count, c AS min_center_pitch_px, g AS min_border_gap_px, greatest(room / 8, 2.5) * 8 AS usable_annulus_span_px, greatest(room / 8, 2.5) AS annulus_width_px, CASE WHEN global THEN 'global_min_gap' ELSE 'neighbors' END AS fallback_mode, radius_outer_px + greatest(room / 8, 2.5) * 8 AS terrace_outer_radius_px FROM wm",
        "mode, hole_id, neighbor_count, fallback_mode",
        "min_center_pitch_px min_border_gap_px usable_annulus_span_px annulus_width_px terrace_outer_radius_px",
        _WIDTHS,
    ),
)
def _(spark, sf_dir):
    holes = views.holes(spark, sf_dir).withColumn("lattice_u", F.when(F.col("hole_id") % 10 != 7, F.col("lattice_u")))
    modes = {"fixed": ("fixed", "border_gap"), "half_gap": ("half_gap", "border_gap"), "full_pitch": ("full_gap", "center_pitch")}
    return gates.union([lattice.terrace_width_plan(holes, 8, *ways, min_width=2.5).withColumn("mode", F.lit(mode)) for mode, ways in modes.items()])


# The mask leaves out a stripe of every seventh column from 200 on; the frame is 480 x 460.
_INSIDE = """hz AS (SELECT *, radius_outer_px AS hr, radius_outer_px + 5 + hole_id % 4 AS tr FROM holes), mk AS (SELECT i AS y, j AS x FROM range(480) a(i), range(460) c(j) WHERE NOT (j >= 200 AND j % 7 = 3)),
    dk AS (SELECT hole_id, bool_and(i >= 0 AND j >= 0 AND mk.y IS NOT NULL) AS t, bool_and(mk.y IS NOT NULL) FILTER (WHERE (j - hz.x) ** 2 + (i - hz.y) ** 2 <= hr * hr) AS h
      FROM hz, range(700) a(i), range(700) c(j) LEFT JOIN mk ON mk.y = i AND mk.x = j WHERE (j - hz.x) ** 2 + (i - hz.y) ** 2 <= tr * tr GROUP BY hole_id),
    cn AS (SELECT hz.hole_id, hz.x - hr >= 0 AND hz.y - hr >= 0 AND hz.x + hr <= 459 AND hz.y + hr <= 479 AS hole_inside_frame, hz.x - tr >= 0 AND hz.y - tr >= 0 AND hz.x + tr <= 459 AND hz.y + tr <= 479 AS terrace_inside_frame, h, t,
      sqrt((hz.x - 250.0) ** 2 + (hz.y - 240.0) ** 2) + hr <= 180.0 + 1e-6 AS hc, sqrt((hz.x - 250.0) ** 2 + (hz.y - 240.0) ** 2) + tr <= 180.0 + 1e-6 AS tc FROM hz JOIN dk USING (hole_id)),
    cf AS (SELECT 'mask' AS by_, hole_id, hole_inside_frame, terrace_inside_frame, hole_inside_frame AND coalesce(h, false) AS hole_inside_wafer, terrace_inside_frame AND coalesce(t, false) AS terrace_inside_wafer FROM cn UNION ALL SELECT 'circle', hole_id, hole_inside_frame, terrace_inside_frame, hc, tc FROM cn)"""


@query(
    "containment",
    sql(
        "holes",
        "SELECT *, concat_ws(';', CASE WHEN NOT hole_inside_frame THEN 'hole_outside_frame' END, CASE WHEN NOT terrace_inside_frame THEN 'terrace_outside_frame' END, CASE WHEN NOT hole_inside_wafer THEN 'hole_outside_wafer' END, CASE WHEN NOT terrace_inside_wafer THEN 'terrace_outside_wafer' END) AS reasons FROM cf",
        "by_, hole_id, hole_inside_frame, terrace_inside_frame, hole_inside_wafer, terrace_inside_wafer, reasons",
        "",
        _INSIDE,
    ),
)
def _(spark, sf_dir):
    holes = views.holes(spark, sf_dir).withColumn("terrace_outer_radius_px", F.col("radius_outer_px") + 5 + F.col("hole_id") % 4)
    mask = spark.range(480 * 460).select(F.expr("CAST(id div 460 AS INT)").alias("y"), (F.col("id") % 460).cast("int").alias("x")).where("NOT (x >= 200 AND x % 7 = 3)")
    ways = {"mask": lattice.containment(holes, 480, 460, None, mask), "circle": lattice.containment(holes, 480, 460, (250.0, 240.0, 180.0))}
    return gates.union([df.withColumn("by_", F.lit(name)) for name, df in ways.items()])


@query("run_activity", sql("tensor", """SELECT c.frame_id, c.cluster_id, CAST(c.n AS BIGINT) AS pixel_count, CAST(c.whole AS BIGINT) AS n_valid_px, raw_fraction, baseline_fraction, active_fraction, CASE WHEN max(active_fraction) OVER () > 0 THEN active_fraction / max(active_fraction) OVER () ELSE 0.0 END AS normalized_active_fraction
    FROM (SELECT *, n / greatest(whole, 1) AS raw_fraction, coalesce(b, 0.0) AS baseline_fraction, greatest(n / greatest(whole, 1) - coalesce(b, 0.0), 0.0) AS active_fraction FROM rg LEFT JOIN rb USING (cluster_id)) c""", "frame_id, cluster_id, pixel_count, n_valid_px", "raw_fraction baseline_fraction active_fraction normalized_active_fraction", """rc AS (SELECT frame_id, cluster_id, sum(pixel_count) AS n FROM tensor GROUP BY ALL), rw AS (SELECT frame_id, sum(n) AS whole FROM rc GROUP BY ALL),
    rb AS (SELECT cluster_id, avg(n / whole) AS b FROM rc JOIN rw USING (frame_id) WHERE frame_id IN (SELECT frame_id FROM rw ORDER BY 1 LIMIT 3) GROUP BY ALL),
    rg AS (SELECT rw.frame_id, k.cluster_id, coalesce(rc.n, 0) AS n, whole FROM rw CROSS JOIN (SELECT DISTINCT cluster_id FROM rc) k LEFT JOIN rc ON rc.frame_id = rw.frame_id AND rc.cluster_id = k.cluster_id)"""))
def _(spark, sf_dir):
    return activity.run_activity(views.cluster_tensor(spark, sf_dir))


def _window_mean(width: int) -> str:
    pad = width // 2
    return f"SELECT {width} AS width, entity_id, p AS place, CASE WHEN n < 3 THEN any_value(own) ELSE avg(value) END AS value FROM (SELECT a.entity_id, a.n, k - 1 AS p, s.value, o.value AS own FROM (SELECT entity_id, count(*) AS n FROM sq GROUP BY ALL) a, range(1, 1000) r(k), range({width}) w(j) JOIN sq s ON s.entity_id = a.entity_id AND s.at = least(greatest(k - {pad} + j, 1), a.n) LEFT JOIN sq o ON o.entity_id = a.entity_id AND o.at = k WHERE k <= CASE WHEN n < 3 THEN n ELSE n + {2 * pad + 1 - width} END) GROUP BY entity_id, p, n"


@query("smoothed_series", sql("series", " UNION ALL ".join(_window_mean(w) for w in (3, 4, 7)), "CAST(width AS INTEGER) AS width, entity_id, CAST(place AS INTEGER) AS place", "value", "sq AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY frame_id) AS at FROM series)"))
def _(spark, sf_dir):
    series = views.series(spark, sf_dir)
    return gates.union([reshape.smooth_values(series, ["entity_id"], "frame_id", "value", w).withColumn("width", F.lit(w)) for w in (3, 4, 7)])


@query("descriptor_values", sql("", " UNION ALL ".join(f"SELECT '{c}' AS descriptor, frame_id, avg({c}) AS mean_value FROM hv GROUP BY frame_id" for c in "rgbhs"), "descriptor, frame_id", "mean_value", f"{_PLACED}, {_SIX}"))
def _(spark, sf_dir):
    px = _placed_pixels(spark, sf_dir)
    return gates.union([frames.descriptor(px, c).groupBy("frame_id").agg(F.avg("value").alias("mean_value")).withColumn("descriptor", F.lit(c)) for c in frames.DESCRIPTORS])


@query("masked_hue", sql("", "SELECT frame_id, count(*) FILTER (WHERE s >= 0.8) AS n_known, avg(h) FILTER (WHERE s >= 0.8) AS mean_hue FROM hv GROUP BY frame_id", "frame_id, n_known", "mean_hue", f"{_PLACED}, {_SIX}"))
def _(spark, sf_dir):
    return frames.masked_hue(_placed_pixels(spark, sf_dir), 0.8).groupBy("frame_id").agg(F.count("hue").alias("n_known"), F.avg("hue").alias("mean_hue"))


_BULK = "bp AS (SELECT DISTINCT frame_id, y, x FROM placed), bv AS (SELECT * FROM bp p WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE sqrt((p.x - h.x) ** 2 + (p.y - h.y) ** 2) <= h.radius_outer_px))"


@query("bulk_region_rows", sql("holes", "SELECT frame_id, n AS n_support_px, n - v AS n_hole_px, v AS n_valid_px, least(v, 100) AS n_sampled_px, v / n AS valid_fraction_of_support FROM (SELECT frame_id, count(*) AS n FROM bp GROUP BY ALL) JOIN (SELECT frame_id, count(*) AS v FROM bv GROUP BY ALL) USING (frame_id)", "frame_id, n_support_px, n_hole_px, n_valid_px, n_sampled_px", "valid_fraction_of_support", f"{_PLACED}, {_BULK}"))
def _(spark, sf_dir):
    """Up to 100 places of each frame would be sampled; all are counted."""
    return pixels.bulk_rows(_placed_pixels(spark, sf_dir).select("frame_id", "y", "x").distinct(), views.holes(spark, sf_dir), 100)[1]


# Raw frames of 8 x 8 places with one 16-bit number each: the sums of part keys.
_RAW = "rv AS (SELECT frame_id, y % 8 AS y, x % 8 AS x, CAST(sum(g * 37 + r * 11) % 65536 AS BIGINT) AS v FROM placed GROUP BY ALL)"


def _raw_frames(spark, sf_dir):
    px = _placed_pixels(spark, sf_dir).withColumns({"y": F.col("y") % 8, "x": F.col("x") % 8})
    values = px.groupBy("frame_id", "y", "x").agg((F.sum(F.col("g") * 37 + F.col("r") * 11) % 65536).alias("v"))
    hex_ = F.concat(F.lpad(F.hex(F.col("v") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("v") / 256)), 2, "0"))
    cells = values.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("k"), hex_.alias("h")))).alias("_m"))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.col("_m")[k], F.lit("0000"))), ""))
    return cells.select("frame_id", F.lit(0.0).alias("time_s"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"), F.lit("uint16").alias("dtype"))


@query("raw_frame_pixels", sql("", "SELECT f.frame_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, CAST(round(coalesce(v, 0) * 255 / 65535.0) AS INTEGER) AS r, CAST(round(coalesce(v, 0) * 255 / 65535.0) AS INTEGER) AS b FROM (SELECT DISTINCT frame_id FROM placed) f CROSS JOIN range(8) a(i) CROSS JOIN range(8) c(j) LEFT JOIN rv ON rv.frame_id = f.frame_id AND rv.y = i AND rv.x = j WHERE f.frame_id >= 2 AND (f.frame_id - 2) % 3 = 0 AND f.frame_id <= 20", "frame_id, y, x, r, b", "", f"{_PLACED}, {_RAW}"))
def _(spark, sf_dir):
    """Every third raw frame from 2 to 20, brought to 8 bits."""
    return tables.frame_pixels(tables.windowed(_raw_frames(spark, sf_dir), 2, 20, 3)).drop("g")


@query("frame_probe", sql("", "SELECT count(DISTINCT frame_id) AS n_frames, 25.0::DOUBLE AS fps, 8 AS width, 8 AS height, 1 AS channels FROM placed", "n_frames, fps, width, height, channels", "", _PLACED))
def _(spark, sf_dir):
    return tables.probe(_raw_frames(spark, sf_dir), 25.0)


@query("known_holes", sql("radial hotspots", "SELECT hole_id FROM radial UNION SELECT nearest_hole_id FROM hotspots", "hole_id", ""))
def _(spark, sf_dir):
    """The holes of either table, each once."""
    return gates.union([views.radial_rows(spark, sf_dir).select("hole_id"), views.hotspot_rows(spark, sf_dir).select(F.col("nearest_hole_id").alias("hole_id"))], distinct=True)


# Frames before the tenth are darker, so that there is a jump to be found.
_STEP = f"pixels AS (SELECT {views._Q} AS frame_id, CAST(CASE WHEN {views._Q} < 10 THEN l_orderkey % 64 ELSE 128 + l_orderkey % 128 END AS INTEGER) AS r, CAST(CASE WHEN {views._Q} < 10 THEN l_partkey % 64 ELSE 128 + l_partkey % 128 END AS INTEGER) AS g, CAST(l_suppkey % 64 AS INTEGER) AS b FROM lineitem)"
_SUGGEST = _STEP + ", " + _WIN + f""", cw AS (SELECT wj.*, m + 3 * mad AS threshold FROM wj, md WHERE {_settled("jump")} >= {_settled("greatest(m + 6 * mad, 3 * greatest(post_p90, constancy_p90, 1e-6))")}
        AND {_settled("post_p90")} <= {_settled("greatest(m + 3 * mad, 0.25 * jump)")} AND {_settled("constancy_p90")} <= {_settled("greatest(m + 3 * mad, 0.2 * jump)")}),
    la AS (SELECT w.first, d.pos, 0.5 * sum(abs(d.share - r.rs)) + 2 * avg(abs(d.cdf - r.rc)) + 0.5 * abs(any_value(d.mean) - any_value(r.rm)) AS constancy FROM cw w JOIN wr r ON r.first = w.first JOIN dp d ON d.pos > w.first AND d.bin = r.bin GROUP BY ALL),
    br AS (SELECT la.first, min(la.pos) AS e FROM la JOIN cw ON cw.first = la.first JOIN ts ON ts.pos = la.pos WHERE NOT (ts.score <= greatest(threshold, 0.25 * jump) AND la.constancy <= greatest(threshold, 0.2 * jump)) GROUP BY ALL),
    rn AS (SELECT cw.*, coalesce(e, n) - cw.first AS run, n FROM cw LEFT JOIN br ON br.first = cw.first, (SELECT any_value(n) AS n FROM fp)),
    me AS (SELECT *, floor(jump * jump / greatest(post_p90, post_median, constancy_p90, 1e-6) * (1 + run / greatest(n - first, 1)) * sqrt(run) * 1e9 + 0.5) AS merit FROM rn)"""


@query(
    "trim_suggestion",
    sql(
        "",
        "SELECT c.frame_id AS cursor_frame, f.frame_id AS first_stable_frame, CAST(run AS INTEGER) AS stable_run_frames, least(jump / greatest(post_p90, constancy_p90, threshold, 1e-6) / 8, 1.0) AS confidence, jump, post_p90, constancy_p90 FROM (SELECT * FROM me ORDER BY merit DESC, first LIMIT 1) b JOIN fp c ON c.pos = b.first - 1 JOIN fp f ON f.pos = b.first",
        "cursor_frame, first_stable_frame, stable_run_frames",
        "confidence jump post_p90 constancy_p90",
        _SUGGEST,
    ),
)
def _(spark, sf_dir):
    """The one best place to cut."""
    dark = F.col("frame_id") < 10
    px = views.pixels(spark, sf_dir).withColumns({**{c: F.when(dark, F.col(k) % 64).otherwise(128 + F.col(k) % 128).cast("int") for c, k in (("r", "r"), ("g", "g"))}, "b": F.col("b") % 64})
    return trim.suggestion(frames.histogram(px, 256), 5).drop("stable_window_frames")


def _mixture(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return mixture.prevalence(px, mixture.choose(mixture.colours(px)))


@query("colour_mixture_candidates")
def _(spark, sf_dir):
    """Each k that was tried, with its criteria, relevance and which one is selected."""
    return mixture.judged(mixture.fit(mixture.colours(views.pixels(spark, sf_dir)))[1])


@query("colour_mixture_prevalence")
def _(spark, sf_dir):
    return _mixture(spark, sf_dir)


@query("colour_mixture_context")
def _(spark, sf_dir):
    return mixture.frame_context(_mixture(spark, sf_dir))


# Sets of candidates made from the orders of each customer: the choice alone.
_JUDGED = """ca AS (SELECT o_custkey AS set_id, CAST(o_orderkey % 8 + 1 AS INTEGER) AS k, min(floor(o_totalprice / 1000)) AS icl, max(floor(o_totalprice / 900)) AS bic, avg(o_orderkey % 10) / 20.0 AS w, 0.2 AS wf, CAST(max(o_orderkey % 7) AS DOUBLE) AS sep FROM orders GROUP BY ALL),
    cb AS (SELECT *, first_value(sep) OVER (PARTITION BY set_id ORDER BY k <> 2, k) AS base FROM ca), cf AS (SELECT *, CASE WHEN base > 0 THEN 0.8 * base ELSE 0.0 END AS sf FROM cb),
    cr AS (SELECT *, k <= 2 OR (w >= wf AND sep >= sf) AS rel FROM cf), ce AS (SELECT *, CASE WHEN bool_or(rel) OVER (PARTITION BY set_id) THEN rel ELSE k = first_value(k) OVER (PARTITION BY set_id ORDER BY icl, k) END AS el FROM cr),
    cs AS (SELECT *, min(icl) FILTER (WHERE el) OVER (PARTITION BY set_id) AS best FROM ce), ck AS (SELECT *, k = min(k) FILTER (WHERE el AND icl <= best + 10) OVER (PARTITION BY set_id) AS selected, bic - min(bic) OVER (PARTITION BY set_id) AS bic_delta_from_best, icl - min(icl) OVER (PARTITION BY set_id) AS icl_delta_from_best FROM cs)"""


@query("mixture_choice", sql("", "SELECT set_id, k, rel AS is_relevant, selected, sf AS center_separation_floor, bic_delta_from_best, icl_delta_from_best FROM ck", "set_id, k, is_relevant, selected", "center_separation_floor bic_delta_from_best icl_delta_from_best", _JUDGED))
def _(spark, sf_dir):
    thousands = F.floor(F.col("o_totalprice") / 1000).cast("double")
    sets = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("set_id"), (F.col("o_orderkey") % 8 + 1).cast("int").alias("k")).agg(
        F.min(thousands).alias("icl"), F.max(F.floor(F.col("o_totalprice") / 900).cast("double")).alias("bic"), (F.avg(F.col("o_orderkey") % 10) / 20.0).alias("min_component_weight"),
        F.lit(0.2).alias("component_weight_floor"), F.max(F.col("o_orderkey") % 7).cast("double").alias("min_center_sigma_separation"),
    )
    out = mixture.judged(sets, keys=("set_id",))
    return out.select("set_id", "k", "is_relevant", "selected", "center_separation_floor", "bic_delta_from_best", "icl_delta_from_best")
