"""Exploratory statistics of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.spec import DEFAULT, PanelSpec

# The order of weekdays that the column wday counts from 1.
WEEKDAYS = ("Sat", "Sun", "Mon", "Tue", "Wed", "Thu", "Fri")


def series_stats(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, raw_length, zero_frac, first_sale_date, last_date, active_length and static keys of each series, in one grouping."""
    sold = F.when(F.col(spec.target) > 0, F.col(spec.date))
    static = [c for c in spec.static if c in panel.columns]
    out = panel.groupBy(spec.id).agg(
        F.count(spec.date).alias("raw_length"),
        F.avg((F.col(spec.target) == 0).cast("double")).alias("zero_frac"),
        F.min(sold).alias("first_sale_date"),
        F.max(spec.date).alias("last_date"),
        *[F.min(c).alias(c) for c in static],
    )
    return out.withColumn("active_length", F.datediff("last_date", "first_sale_date") + 1)


def describe(stats: DataFrame, columns: list[str]) -> DataFrame:
    """statistic and one column for each of `columns`: count, mean, std, min, exact quartiles and max, rounded to one decimal."""
    measures = (
        ("count", lambda c: F.count(c).cast("double")),
        ("mean", F.avg),
        ("std", F.stddev_samp),
        ("min", lambda c: F.min(c).cast("double")),
        ("25%", lambda c: F.percentile(c, F.lit(0.25))),
        ("50%", lambda c: F.percentile(c, F.lit(0.5))),
        ("75%", lambda c: F.percentile(c, F.lit(0.75))),
        ("max", lambda c: F.max(c).cast("double")),
    )
    one = stats.agg(*[F.round(f(c), 1).alias(f"{name}|{c}") for c in columns for name, f in measures])
    entries = F.array(*[F.struct(F.lit(name).alias("statistic"), *[F.col(f"`{name}|{c}`").alias(c) for c in columns]) for name, _ in measures])
    return one.select(F.explode(entries).alias("x")).select("x.*")


def counts_by(stats: DataFrame, key: str) -> DataFrame:
    return stats.groupBy(key).agg(F.count("*").alias("series")).orderBy(key)


def median_by(stats: DataFrame, key: str, value: str) -> DataFrame:
    """key and the median of a value, largest first; nulls are skipped."""
    return stats.groupBy(key).agg(F.median(value).alias(f"median_{value}")).orderBy(F.col(f"median_{value}").desc(), key)


def weekday_profile(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """wday, weekday and the mean target. Without a column wday, ISO weekdays from Monday = 0."""
    if "wday" in panel.columns:
        label = F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.col("wday").cast("int"))
        day = F.col("wday").cast("int")
    else:
        day = F.weekday(spec.date)
        label = F.element_at(F.array(*[F.lit(x) for x in (*WEEKDAYS[2:], *WEEKDAYS[:2])]), day + 1)
    return panel.groupBy(day.alias("wday"), label.alias("weekday")).agg(F.avg(spec.target).alias("mean_target"))


def histogram(frame: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), low, high and n: equal widths between the least and the largest value, the largest in the last bin. Nulls are skipped; empty bins are absent."""
    rows = frame.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("a"), width)), F.lit(bins - 1))).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def sample_nonzero(panel: DataFrame, n: int = 300_000, seed: int = 42, spec: PanelSpec = DEFAULT) -> DataFrame:
    """At most n nonzero values, drawn without replacement."""
    return panel.where(F.col(spec.target) > 0).select(spec.id, spec.date, spec.target).orderBy(F.rand(seed)).limit(n)
