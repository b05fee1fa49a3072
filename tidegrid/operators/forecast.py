"""Forecasters. Those that are sums and windows stay in the plan; those with recursions or searches run over Arrow batches of whole series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import kernels, statmodels
from tidegrid.operators.panel import date_index, grid_size, sparse_series
from tidegrid.spec import DEFAULT, PanelSpec

SQL_METHODS = ("naive", "snaive", "ma", "croston", "sba", "ses_fixed")


def check_methods(methods: tuple[str, ...], more: tuple[str, ...] = ()) -> None:
    unknown = [m for m in methods if m not in (*kernels.METHODS, *more)]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known: {', '.join((*kernels.METHODS, *more))}")


def indexed(hist: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, t, y, last_t, last_date and step of each row."""
    return hist.join(date_index(hist, spec), spec.date).crossJoin(F.broadcast(grid_size(hist, spec))).select(spec.id, "t", F.col(spec.target).cast("double").alias("y"), "last_t", "last_date", "step")


def _one(name: str):
    return F.max(name).alias(name)


def _dated(values: DataFrame, horizon: int, value, spec: PanelSpec) -> DataFrame:
    """A row for each forecast date; value: a column that may use h."""
    rows = values.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return rows.select(spec.id, F.date_add("last_date", F.col("h") * F.col("step")).alias(spec.date), F.greatest(value, F.lit(0.0)).alias(spec.target))


def naive(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The value on the grid's last date; 0 for a series without a row there."""
    last = indexed(hist, spec).groupBy(spec.id).agg(F.coalesce(F.max(F.when(F.col("t") == F.col("last_t"), F.col("y"))), F.lit(0.0)).alias("y"), _one("last_date"), _one("step"))
    return _dated(last, horizon, F.col("y"), spec)


def seasonal_naive(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The last season's values in turn; a series that began later cycles through what there is."""
    recent = F.when((F.col("t") > F.col("last_t") - spec.season) & (F.col("y") != 0), F.struct("t", "y"))
    tail = indexed(hist, spec).groupBy(spec.id).agg(F.map_from_entries(F.collect_list(recent)).alias("tail"), F.min(F.when(F.col("y") != 0, F.col("t"))).alias("first"), _one("last_t"), _one("last_date"), _one("step"))
    n = F.least(F.lit(spec.season), F.col("last_t") - F.coalesce("first", F.lit(1)) + 1)
    at = F.col("last_t") - n + 1 + F.pmod(F.col("h") - 1, n)
    return _dated(tail, horizon, F.coalesce(F.try_element_at("tail", at), F.lit(0.0)), spec)


def ses_fixed(hist: DataFrame, alpha: float = 0.1, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Exponential smoothing with a fixed factor, as one weighted sum over the nonzero rows."""
    rows = indexed(hist, spec).where("y <> 0").withColumn("first", F.min("t").over(Window.partitionBy(spec.id)))
    age = F.col("last_t") - F.col("t")
    weight = F.when(F.col("t") == F.col("first"), 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), age)
    level = rows.groupBy(spec.id).agg(F.sum(weight * F.col("y")).alias("y"))
    everyone = hist.select(spec.id).distinct().crossJoin(F.broadcast(grid_size(hist, spec)))
    return _dated(everyone.join(level, spec.id, "left"), horizon, F.coalesce("y", F.lit(0.0)), spec)


def intervals(hist: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, k, demand and gap: the k-th nonzero value of each series and the steps since the one before (1 for the first)."""
    w = Window.partitionBy(spec.id).orderBy("t")
    rows = indexed(hist, spec).where("y <> 0")
    return rows.select(spec.id, F.row_number().over(w).alias("k"), F.col("y").alias("demand"), F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(1)).cast("double").alias("gap"), "last_date", "step")


def croston(hist: DataFrame, horizon: int = 28, factor: float = 1.0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Smoothed demand over smoothed interval, both as weighted sums; 0 for a series without demand. factor: 0.95 gives the bias-corrected form."""
    a = kernels.CROSTON_SMOOTHING
    w = Window.partitionBy(spec.id)
    rows = intervals(hist, spec).withColumn("m", F.max("k").over(w))
    weight = F.when(F.col("k") == 1, 1.0).otherwise(a) * F.pow(F.lit(1 - a), F.col("m") - F.col("k"))
    rate = rows.groupBy(spec.id).agg((F.sum(weight * F.col("demand")) / F.greatest(F.sum(weight * F.col("gap")), F.lit(kernels.LEAST)) * factor).alias("y"))
    everyone = hist.select(spec.id).distinct().crossJoin(F.broadcast(grid_size(hist, spec)))
    return _dated(everyone.join(rate, spec.id, "left"), horizon, F.coalesce("y", F.lit(0.0)), spec)


def sba(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    return croston(hist, horizon, kernels.SBA_FACTOR, spec)


def moving_average(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The best of thirteen moving averages of each series, as array sums over its dense values."""
    series = sparse_series(hist, spec)
    first = F.coalesce(F.get("t", F.lit(0)), F.lit(1))
    gaps = F.transform(F.sequence(F.lit(0), F.size("t")), lambda i: F.coalesce(F.get("t", i), F.col("last_t") + 1) - F.when(i == 0, first - 1).otherwise(F.get("t", i - 1)) - 1)
    zeros = F.transform(gaps, lambda g: F.array_repeat(F.lit(0.0), g))
    dense = F.flatten(F.transform(zeros, lambda z, i: F.concat(z, F.when(i < F.size("y"), F.array(F.get("y", i))).otherwise(F.array().cast("array<double>")))))
    rows = series.select(spec.id, F.posexplode(dense).alias("i", "x"))
    order = Window.partitionBy(spec.id).orderBy("i")
    errors = []
    for k in kernels.MA_ORDERS:
        trailing = F.avg("x").over(order.rowsBetween(-k, -1))
        errors.append(F.when(F.col("i") >= k, (F.col("x") - trailing) ** 2).alias(f"e{k}"))
    wide = rows.select(spec.id, "i", "x", F.count("*").over(Window.partitionBy(spec.id)).alias("n"), *errors)
    tails = [F.avg(F.when(F.col("i") >= F.col("n") - k, F.col("x"))).alias(f"m{k}") for k in kernels.MA_ORDERS]
    sums = wide.groupBy(spec.id).agg(*[F.avg(f"e{k}").alias(f"e{k}") for k in kernels.MA_ORDERS], *tails)
    choices = F.filter(F.array(*[F.struct(F.col(f"e{k}").alias("e"), F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in kernels.MA_ORDERS]), lambda c: c["e"].isNotNull())
    best = sums.select(spec.id, F.coalesce(F.array_min(choices)["m"], F.col("m2")).alias("y")).crossJoin(F.broadcast(grid_size(hist, spec)))
    return _dated(best, horizon, F.col("y"), spec)


def block_sums(hist: DataFrame, size: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, block (1 is the last) and total of the full blocks of `size` grid steps, counted from the end of each trimmed series."""
    rows = indexed(hist, spec)
    first = rows.groupBy(spec.id).agg(F.coalesce(F.min(F.when(F.col("y") != 0, F.col("t"))), F.lit(1)).alias("first"), _one("last_t"))
    n = F.floor((F.col("last_t") - F.col("first") + 1) / size).cast("int")
    blocks = first.select(spec.id, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("block"))
    sums = rows.groupBy(spec.id, (F.floor((F.col("last_t") - F.col("t")) / size) + 1).cast("int").alias("block")).agg(F.sum("y").alias("total"))
    return blocks.join(sums, [spec.id, "block"], "left").select(spec.id, "block", F.coalesce("total", F.lit(0.0)).alias("total"))


def dense_arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and the dense values of each series of a batch from sparse_series()."""
    for i, (n, t, y) in enumerate(zip(batch["last_t"].to_pylist(), batch["t"].to_pylist(), batch["y"].to_pylist())):
        x = np.zeros(n)
        x[np.array(t, np.int64) - 1] = y
        yield i, x


def grouped(hist: DataFrame, run, horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date, method and target of all series; run(x, horizon) returns the forecasts of a dense series by method.

    A series is one row of sparse arrays, and many rows share an Arrow batch.
    """
    series = sparse_series(hist, spec)

    def work(batches):
        for batch in batches:
            who, h, names, values = [], [], [], []
            for i, x in dense_arrays(batch):
                for name, path in run(x, horizon).items():
                    who += [i] * horizon
                    h += range(1, horizon + 1)
                    names += [name] * horizon
                    values += path.tolist()
            yield pa.RecordBatch.from_pydict({spec.id: batch[spec.id].take(pa.array(who, pa.int32())), "h": pa.array(h, pa.int32()), "method": pa.array(names, pa.string()), spec.target: pa.array(values, pa.float64())})

    out = series.mapInArrow(work, f"{spec.id} string, h int, method string, {spec.target} double").crossJoin(F.broadcast(grid_size(hist, spec)))
    return out.select(spec.id, F.date_add("last_date", F.col("h") * F.col("step")).alias(spec.date), "method", spec.target)


def local(hist: DataFrame, methods: tuple[str, ...] = kernels.METHODS, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date, method and target of local methods, all in one pass over the series."""
    check_methods(methods)
    season = spec.season
    return grouped(hist, lambda x, h: {m: kernels.forecast(x, h, m, season) for m in methods}, horizon, spec)


def smoothing_model(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    season = spec.season
    return grouped(hist, lambda x, h: {"es_bu": statmodels.ets(x, h, season)}, horizon, spec)


def autoregression(hist: DataFrame, horizon: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    season = spec.season
    return grouped(hist, lambda x, h: {"arima_bu": statmodels.arima(x, h, season)}, horizon, spec)
