"""Column expressions shared by the operators: nulls instead of NaN, tie-safe picks, fits in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-6


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null, the one marker of a missing measure."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    clean = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in floating}
    return df.withColumns(clean) if clean else df


def settled(value: Column) -> Column:
    """Rounded to nine decimals, before values are compared or divided: what sums leave of noise then decides nothing."""
    return F.floor(value * 1e9 + 0.5) / 1e9


def pick_first(value: str, by: str, order: str) -> Column:
    """The `value` at the largest `by`, the least `order` among equals; rows without `by` don't count."""
    return F.max_by(F.col(value), F.when(F.col(by).isNotNull(), F.struct(F.col(by), -F.col(order))))


def weighted_centre(position: str, value: str, keys: list[str]) -> tuple[Column, Column]:
    """Window column with the group's least value, and the aggregate that uses it (as `_low`): the centre with weights above that."""
    low = F.min(value).over(Window.partitionBy(*keys))
    weight = F.when(F.col(value).isNotNull(), F.col(value) - F.col("_low") + TINY)
    return low, F.try_divide(F.sum(F.col(position) * weight), F.sum(weight))


def line_fit(x: str, y: str) -> dict[str, Column]:
    """Aggregates of a straight fit of y over x: slope, intercept, n, and total and residual squares. Null pairs don't count."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y))
    sxx, syy, sxy = F.regr_sxx(ys, xs), F.regr_syy(ys, xs), F.regr_sxy(ys, xs)
    slope = F.try_divide(sxy, sxx)
    return {
        "n": F.count(ys),
        "slope": slope,
        "intercept": F.avg(ys) - slope * F.avg(xs),
        "total": syy,
        "residual": syy - F.try_divide(sxy * sxy, sxx),
    }


def r_squared(residual: Column, total: Column, least: float = 0.0) -> Column:
    """1 - residual / total; 1 where the total is not above `least`."""
    return F.when(total > least, 1 - residual / total).when(total.isNotNull(), F.lit(1.0))


def parabola(df: DataFrame, keys: list[str], x: str, y: str, line: bool = False) -> DataFrame:
    """Quadratic least squares of y over x for each group with three distinct x or more: a, b, c, qres, qtot, qn.

    With `line` also the straight fit's columns (line_fit's names after an underscore), from the same pass; then groups of
    fewer x stay, with nulls for the curve.
    x is centred on the group's mean before the power sums, which keeps the normal equations well conditioned.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_mx", F.avg(F.col(x).cast("double")).over(w))
    rows = rows.withColumn("_my", F.avg(y).over(w)).withColumn("_x", F.col(x) - F.col("_mx")).withColumn("_y", F.col(y) - F.col("_my"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("qn"),
        F.countDistinct(x).alias("_d"),
        F.first("_mx").alias("_mx"),
        F.first("_my").alias("_my"),
        *[F.sum(F.pow("_x", F.lit(float(k)))).alias(f"_s{k}") for k in (2, 3, 4)],
        *[F.sum(F.pow("_x", F.lit(float(k))) * F.col("_y")).alias(f"_t{k}") for k in (1, 2)],
        F.sum(F.col("_y") * F.col("_y")).alias("qtot"),
        *([v.alias(f"_{k}") for k, v in line_fit(x, y).items()] if line else []),
    )
    # with centred x and y: minimise over a (x^2 - s2/n) + b x
    q = F.col("_s4") - F.col("_s2") * F.col("_s2") / F.col("qn")
    det = q * F.col("_s2") - F.col("_s3") * F.col("_s3")
    curved = F.col("_d") >= 3
    a = F.when(curved, F.try_divide(F.col("_t2") * F.col("_s2") - F.col("_t1") * F.col("_s3"), det))
    b = F.when(curved, F.try_divide(F.col("_t1") * q - F.col("_t2") * F.col("_s3"), det))
    fitted = (sums if line else sums.where(curved)).withColumn("a", a).withColumn("_b", b)
    fitted = fitted.withColumn("qres", F.when(curved, F.greatest(F.lit(0.0), F.col("qtot") - F.col("a") * F.col("_t2") - F.col("_b") * F.col("_t1"))))
    return fitted.select(
        *keys,
        "qn",
        "a",
        (F.col("_b") - 2 * F.col("a") * F.col("_mx")).alias("b"),
        (F.col("_my") - F.col("a") * F.col("_s2") / F.col("qn") - F.col("_b") * F.col("_mx") + F.col("a") * F.col("_mx") * F.col("_mx")).alias("c"),
        "qres",
        F.when(curved, F.col("qtot")).alias("qtot"),
        *(["_n", "_slope", "_intercept", "_total", "_residual"] if line else []),
    )


def smoothed(value: str, keys: list[str], order: str) -> Column:
    """Centred average of three, the end values standing in for what is missing beyond the ends; series under three as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(n < 3, F.col(value)).otherwise((before + F.col(value) + after) / 3)


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and lightness (0 to 1) of channels in 0..255."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    c = high - low
    light = (high + low) / 2
    sixth = F.when(c == 0, F.lit(0.0)).when(high == r, F.pmod((g - b) / c, F.lit(6.0))).when(high == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    return sixth / 6, F.when(c == 0, F.lit(0.0)).otherwise(c / (1 - F.abs(2 * light - 1) + TINY)), light


def rgb8(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    """Channels in whole numbers of 0..255 of a hue (any turn), saturation and lightness."""
    half = s * F.least(light, 1 - light)

    def channel(shift: int) -> Column:
        step = F.pmod(F.lit(float(shift)) + 12 * h, F.lit(12.0))
        value = light - half * F.greatest(F.lit(-1.0), F.least(step - 3, 9 - step, F.lit(1.0)))
        return F.least(F.greatest(F.rint(settled(255 * value)), F.lit(0.0)), F.lit(255.0)).cast("int")

    return channel(0), channel(8), channel(4)


def hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of channels in 0..255 in 8-bit steps (hue in steps of two degrees), scaled to 0..1."""
    high, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    c = high - low
    sixth = F.when(c == 0, F.lit(0.0)).when(high == r, F.pmod((g - b) / c, F.lit(6.0))).when(high == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    hue = F.pmod(F.floor(30 * sixth + 0.5), F.lit(180))
    return hue / 179.0, F.floor(F.when(high == 0, F.lit(0.0)).otherwise(255 * c / high) + 0.5) / 255.0, high / 255.0


def proximity(distance: Column) -> Column:
    """How near the nearest hotspot is: none, near (to 10 px), mid (to 24 px) or far."""
    return F.when(distance.isNull(), "none").when(distance <= 10, "near").when(distance <= 24, "mid").otherwise("far")
