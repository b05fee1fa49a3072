"""Scaling factors and revenue weights of all levels, from the rows there are: no dense grid is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.hierarchy import to_levels
from tidegrid.operators.panel import date_index
from tidegrid.spec import DEFAULT, PanelSpec

LEAST = 1e-8
SCALE_MODES = ("from_first", "inclusive")


def scales_of(series: DataFrame, keys: list[str], value: str, mode: str = "from_first") -> DataFrame:
    """keys and scale: the mean squared one-step change of each series from its first nonzero value on.

    series: keys, t (grid position), last_t and the value, rows with zeros optional. Between nonzero
    values x at t and x' at t' the squared changes add up to (x' - x)^2 if t' = t + 1, else to x^2 +
    x'^2; a last value before the grid's end adds x^2. from_first divides by the steps after the
    first value, and fewer than two nonzero values give the least scale. inclusive counts the step
    into the first value as well, if there is one.
    """
    if mode not in SCALE_MODES:
        raise ValueError(f"unknown scale mode {mode!r}; known: {', '.join(SCALE_MODES)}")
    w = Window.partitionBy(*keys).orderBy("t")
    x = F.col(value)
    before, at = F.lag(value).over(w), F.lag("t").over(w)
    step = F.when(at.isNull(), 0.0).when(F.col("t") == at + 1, (x - before) ** 2).otherwise(before**2 + x**2)
    live = series.where(x != 0).select(*keys, "t", "last_t", value, step.alias("step"))
    out = live.groupBy(*keys).agg(F.sum("step").alias("steps"), F.count("*").alias("n"), F.min("t").alias("first"), F.max("last_t").alias("last_t"), F.max_by(value, "t").alias("end"), F.min_by(value, "t").alias("begin"), F.max("t").alias("until"))
    total = F.col("steps") + F.when(F.col("until") < F.col("last_t"), F.col("end") ** 2).otherwise(0.0)
    if mode == "inclusive":
        total = total + F.when(F.col("first") > 1, F.col("begin") ** 2).otherwise(0.0)
        n = F.col("last_t") - F.greatest(F.col("first") - 1, F.lit(1))
        scale = F.when(n >= 1, total / n).otherwise(LEAST)
    else:
        n = F.col("last_t") - F.col("first")
        scale = F.when((F.col("n") >= 2) & (n >= 1), total / n).otherwise(LEAST)
    scaled = out.select(*keys, F.greatest(scale, F.lit(LEAST)).alias("scale"))
    everyone = series.select(*keys).distinct()
    return everyone.join(scaled, keys, "left").select(*keys, F.coalesce("scale", F.lit(LEAST)).alias("scale"))


def priced(hist: DataFrame, mode: str = "history", days: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The history with t, last_t and revenue: target times price on the last `days` dates of the grid, else 0. Missing prices are filled as in price_fill()."""
    index = date_index(hist, spec)
    last = index.agg(F.max("t").alias("last_t"))
    rows = hist.join(index, spec.date).crossJoin(F.broadcast(last))
    recent = F.col("t") > F.col("last_t") - days
    price = F.col(spec.price) if mode == "history" else F.when(recent, F.col(spec.price))
    order = Window.partitionBy(spec.id).orderBy("t")
    before = F.last(price, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(price, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("revenue", F.when(recent, F.col(spec.target) * F.coalesce(before, after, F.lit(1.0))).otherwise(0.0))


def weights_scales(hist: DataFrame, static: DataFrame | None = None, scale_mode: str = "from_first", price_mode: str = "history", days: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """level, id, scale and weight of every series of every level, from the lowest level's history.

    weight: the share of a level's revenue over the last `days` dates; uniform if a level has none.
    """
    rows = priced(hist, price_mode, days, spec)
    if static is not None:
        rows = rows.drop(*spec.static).join(static.select(spec.id, *spec.static), spec.id, "left")
    summed = to_levels(rows.select(spec.id, *spec.static, F.struct(spec.date, "t", "last_t").alias(spec.date), spec.target, "revenue"), [spec.target, "revenue"], spec, "All")
    series = summed.select("level", F.col("agg_id").alias("id"), F.col(f"{spec.date}.t").alias("t"), F.col(f"{spec.date}.last_t").alias("last_t"), spec.target, "revenue")
    scale = scales_of(series, ["level", "id"], spec.target, scale_mode)
    revenue = series.groupBy("level", "id").agg(F.sum("revenue").alias("revenue"))
    # a row for each level, so that no task holds a level's series
    total = revenue.groupBy("level").agg(F.sum("revenue").alias("total"), F.count("*").alias("series"))
    weight = F.when(F.col("total") > 0, F.try_divide(F.col("revenue"), F.col("total"))).otherwise(1.0 / F.col("series"))
    revenue = revenue.join(F.broadcast(total), "level")
    return scale.join(revenue.select("level", "id", weight.alias("weight")), ["level", "id"]).select("level", "id", "scale", "weight")
