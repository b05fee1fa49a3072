"""Scores of forecasts: weighted, scaled errors over all levels and point errors at the lowest."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.hierarchy import to_levels
from tidegrid.spec import DEFAULT, PanelSpec


def common_dates(forecast: DataFrame, actual: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The dates that both have. An actual date without forecasts is left out of every score."""
    return forecast.select(spec.date).intersect(actual.select(spec.date))


def missing_series(static: DataFrame, forecast: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Known series without any forecast; they are scored as 0."""
    return static.select(spec.id).join(forecast.select(spec.id).distinct(), spec.id, "left_anti")


def aligned(forecast: DataFrame, actual: DataFrame, static: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The rows of both on common dates and known series, with their static keys: f and a, 0 where one is absent.

    A row stands for a grid cell that either frame has; cells that neither has are 0 on both sides,
    so sums of errors do not need them. Series that are not known are ignored.
    """
    zero = F.lit(0.0)
    both = forecast.select(spec.id, spec.date, F.col(spec.target).alias("f"), zero.alias("a")).unionByName(actual.select(spec.id, spec.date, zero.alias("f"), F.col(spec.target).alias("a")))
    cells = both.join(F.broadcast(common_dates(forecast, actual, spec)), spec.date).groupBy(spec.id, spec.date).agg(F.sum("f").alias("f"), F.sum("a").alias("a"))
    return cells.join(static.select(spec.id, *spec.static), spec.id)


def check(forecast: DataFrame, actual: DataFrame, static: DataFrame, spec: PanelSpec = DEFAULT) -> None:
    """Raises if there is no common date or a key occurs twice; warns of dates and series that do not match."""
    if common_dates(forecast, actual, spec).isEmpty():
        raise ValueError("forecast and actual values have no date in common")
    for name, frame in (("forecast", forecast), ("actual", actual)):
        if not frame.groupBy(spec.id, spec.date).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: a series has two rows for a date")
    late = actual.select(spec.date).distinct().subtract(forecast.select(spec.date)).count()
    if late:
        warnings.warn(f"{late} actual dates have no forecast and are left out of the score", stacklevel=2)
    n = missing_series(static, forecast, spec).count()
    if n:
        warnings.warn(f"{n} series have no forecast and are scored as 0", stacklevel=2)


def rmsse_by_series(forecast: DataFrame, actual: DataFrame, weights_scales: DataFrame, static: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """level, id, mse, scale, weight and rmsse of every series of every level, over the common dates."""
    sums = to_levels(aligned(forecast, actual, static, spec), ["f", "a"], spec, "All")
    dates = common_dates(forecast, actual, spec).agg(F.count("*").alias("dates"))
    errors = sums.groupBy("level", F.col("agg_id").alias("id")).agg(F.sum((F.col("a") - F.col("f")) ** 2).alias("squares"))
    out = weights_scales.join(errors, ["level", "id"], "left").crossJoin(F.broadcast(dates))
    return out.withColumn("mse", F.coalesce(F.col("squares"), F.lit(0.0)) / F.col("dates")).select("level", "id", "mse", "scale", "weight", F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"))


def level_scores(by_series: DataFrame) -> DataFrame:
    """level and score: the weighted sum of a level's rmsse."""
    return by_series.groupBy("level").agg(F.sum(F.col("weight") * F.col("rmsse")).alias("score"))


def wrmsse(scores: DataFrame) -> DataFrame:
    """One row: the unweighted mean of the levels' scores."""
    return scores.agg(F.round(F.avg("score"), 6).alias("wrmsse"))


def point_metrics(forecast: DataFrame, actual: DataFrame, static: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: wape, rmse and mae at the lowest level, over the whole grid of known series and common dates."""
    cells = aligned(forecast, actual, static, spec)
    n = static.select(F.countDistinct(spec.id).alias("series")).crossJoin(common_dates(forecast, actual, spec).agg(F.count("*").alias("dates")))
    error = F.col("a") - F.col("f")
    sums = cells.agg(F.coalesce(F.sum(F.abs(error)), F.lit(0.0)).alias("absolute"), F.coalesce(F.sum(error**2), F.lit(0.0)).alias("squares"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("actual"))
    size = F.col("series") * F.col("dates")
    return sums.crossJoin(n).select((F.col("absolute") / F.greatest("actual", F.lit(1e-8))).alias("wape"), F.sqrt(F.try_divide(F.col("squares"), size)).alias("rmse"), F.try_divide(F.col("absolute"), size).alias("mae"))


def level_report(scores: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """level, wrmsse and the level's keys as text, by level."""
    text = F.create_map(*[x for level, keys in spec.levels.items() for x in (F.lit(level), F.lit(str(list(keys))))])
    return scores.select("level", F.round("score", 6).alias("wrmsse"), F.element_at(text, F.col("level")).alias("description")).orderBy("level")


def evaluate(forecast: DataFrame, actual: DataFrame, weights_scales: DataFrame, static: DataFrame, spec: PanelSpec = DEFAULT) -> dict:
    """All metrics as one dictionary, for the metrics file: WRMSSE and level scores rounded to 6 decimals, point errors as they are."""
    check(forecast, actual, static, spec)
    scores = level_scores(rmsse_by_series(forecast, actual, weights_scales, static, spec)).collect()
    levels = {f"RMSSE_L{r['level']}": round(r["score"], 6) for r in sorted(scores, key=lambda r: r["level"])}
    point = point_metrics(forecast, actual, static, spec).first()
    overall = sum(r["score"] for r in scores) / len(scores)
    return {"WRMSSE": round(overall, 6), "level_scores": levels, "WAPE_L12": point["wape"], "RMSE_L12": point["rmse"], "MAE_L12": point["mae"]}
