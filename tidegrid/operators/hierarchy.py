"""The twelve levels at once: a bridge from series to level labels, and bottom-up sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.spec import DEFAULT, PanelSpec


def level_labels(spec: PanelSpec = DEFAULT, total: str = "Total") -> Column:
    """An array of (level, agg_id) of a row that carries the static keys. A level whose key is null is left out, the total never is."""
    entries = []
    for level, keys in spec.levels.items():
        label = F.concat_ws("_", *keys) if keys else F.lit(total)
        ok = F.lit(True)
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        entries.append(F.when(ok, F.struct(F.lit(level).alias("level"), label.alias("agg_id"))))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def bridge(static: DataFrame, spec: PanelSpec = DEFAULT, total: str = "Total") -> DataFrame:
    """id, level and agg_id: twelve rows for each series."""
    return static.select(spec.id, F.explode(level_labels(spec, total)).alias("x")).select(spec.id, "x.level", "x.agg_id")


def to_levels(rows: DataFrame, values: list[str], spec: PanelSpec = DEFAULT, total: str = "Total") -> DataFrame:
    """level, agg_id, date and the sums of some columns, from rows that carry the static keys.

    Rows are summed by their keys and date first and only then expanded, and the expansion is summed
    within a task before it is shuffled.
    """
    long = rows.select(spec.date, *values, F.explode(level_labels(spec, total)).alias("x"))
    return long.groupBy(F.col("x.level").alias("level"), F.col("x.agg_id").alias("agg_id"), spec.date).agg(*[F.sum(v).alias(v) for v in values])


def bottom_up(forecast: DataFrame, static: DataFrame, expected_series: int | None = None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """level, id, date and the summed forecast of all levels, from forecasts of the lowest. Unknown series count in the total only.

    expected_series, if given, must be the number of series forecast.
    """
    if expected_series is not None:
        n = forecast.select(spec.id).distinct().count()
        if n != expected_series:
            raise ValueError(f"{n} series are forecast, {expected_series} are expected")
    rows = forecast.select(spec.id, spec.date, spec.target).join(static.select(spec.id, *spec.static), spec.id, "left")
    return to_levels(rows, [spec.target], spec).select("level", F.col("agg_id").alias(spec.id), spec.date, spec.target)
