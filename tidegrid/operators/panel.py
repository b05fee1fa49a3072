"""Panel preparation: cleaning, aggregation to a level, splitting, trimming, dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.sources.panels import strip_suffix
from tidegrid.spec import DEFAULT, PanelSpec

TRIM_MODES = ("positive", "nonzero", "drop_empty")


def clean(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Events without a name become "none"; types follow the roles of the columns."""
    kinds = {"wm_yr_wk": "short", "year": "short", "wday": "byte", "month": "byte", spec.price: "double", spec.target: "double"}
    out = []
    for name in panel.columns:
        c = F.col(name)
        if name in spec.events:
            c = F.coalesce(c.cast("string"), F.lit("none"))
        elif name in spec.flags:
            c = c.cast("byte")
        elif name == spec.date:
            c = F.to_date(c)
        elif name in kinds:
            c = c.cast(kinds[name])
        elif name in spec.static or name == spec.id:
            c = c.cast("string")
        out.append(c.alias(name))
    return panel.select(*out)


def level_id(level: int, spec: PanelSpec = DEFAULT, total: str = "All") -> Column:
    """The label of a level's series: its keys joined by "_", or the label of the total."""
    keys = spec.levels[level]
    return strip_suffix(F.concat_ws("_", *keys)) if keys else F.lit(total)


def aggregate_level(panel: DataFrame, level: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The panel at a level: targets summed, flags by maximum, events by the least name (which does not depend on row order), the rest averaged.

    Keys of the level stay as columns. Rows with a null key vanish, as in any grouping by that key.
    """
    keys = spec.levels[level]
    have = set(panel.columns)
    columns = [F.sum(spec.target).alias(spec.target)]
    columns += [F.avg(c).alias(c) for c in spec.means if c in have]
    columns += [F.min(c).alias(c) for c in spec.events if c in have]
    columns += [F.max(c).alias(c) for c in spec.flags if c in have]
    if level == 12:
        columns += [F.min(c).alias(c) for c in spec.static if c in have]
    rows = panel
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    out = rows.groupBy(*[F.col(k) for k in keys], spec.date).agg(*columns)
    out = out.withColumn("label", level_id(level, spec))
    kept = [k for k in keys if k != spec.id]
    static = [c for c in spec.static if c in have] if level == 12 else []
    return out.select(F.col("label").alias(spec.id), spec.date, spec.target, *[c for c in (*spec.means, *spec.events, *spec.flags) if c in have], *kept, *static)


def split(panel: DataFrame, cutoff: str, spec: PanelSpec = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and all later rows without the target. Both filters reach the scan."""
    day = F.to_date(F.lit(cutoff))
    return panel.where(F.col(spec.date) <= day), panel.where(F.col(spec.date) > day).drop(spec.target)


def static_columns(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row of static keys for each series; the least of several values, so that there is one."""
    have = [c for c in spec.static if c in panel.columns]
    return panel.groupBy(spec.id).agg(*[F.min(c).alias(c) for c in have]) if have else panel.select(spec.id).distinct()


def trim(panel: DataFrame, mode: str = "positive", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows from a series' first active date on, found by a window and no join.

    positive: active is target > 0 and a series without sales stays whole; nonzero: active is target
    <> 0; drop_empty: as positive, but a series without sales goes.
    """
    if mode not in TRIM_MODES:
        raise ValueError(f"unknown trim mode {mode!r}; known: {', '.join(TRIM_MODES)}")
    active = F.col(spec.target) != 0 if mode == "nonzero" else F.col(spec.target) > 0
    first = F.min(F.when(active, F.col(spec.date))).over(Window.partitionBy(spec.id))
    keep = F.col(spec.date) >= F.col("_first")
    if mode != "drop_empty":
        keep = F.col("_first").isNull() | keep
    return panel.withColumn("_first", first).where(keep).drop("_first")


def date_index(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """date and t: the distinct dates numbered from 1. The grid is the dates that occur, not the calendar; it is as small as the calendar."""
    return panel.select(spec.date).distinct().withColumn("t", F.row_number().over(Window.orderBy(spec.date)).cast("int"))


def grid_size(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: last_t (the number of dates), last_date and step, the days between later dates (1 unless the last fourteen dates are evenly spaced)."""
    last = panel.select(spec.date).distinct().orderBy(F.col(spec.date).desc()).limit(14)
    gap = F.datediff(F.col(spec.date), F.lag(spec.date).over(Window.orderBy(spec.date)))
    steps = last.select(spec.date, gap.alias("gap")).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.max(spec.date).alias("last_date"))
    even = (F.col("n") >= 3) & (F.col("least") == F.col("most"))
    return panel.agg(F.countDistinct(spec.date).cast("int").alias("last_t")).crossJoin(steps.select("last_date", F.when(even, F.col("least")).otherwise(1).cast("int").alias("step")))


def future_dates(panel: DataFrame, horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """horizon and date of the dates to forecast, after the panel's last one."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")
    return grid_size(panel, spec).select("last_date", "step", h).select("horizon", F.date_add("last_date", F.col("horizon") * F.col("step")).alias(spec.date))


def densify(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Every series on every date of the grid, 0 where there is no row. For inspection: the operators of this library work on the rows there are."""
    ids, dates = panel.select(spec.id).distinct(), panel.select(spec.date).distinct()
    return ids.crossJoin(F.broadcast(dates)).join(panel.select(spec.id, spec.date, spec.target), [spec.id, spec.date], "left").withColumn(spec.target, F.coalesce(spec.target, F.lit(0.0)))


def sparse_series(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row for each series: id, last_t, and its nonzero values y at sorted grid positions t. What a dense matrix holds, without its zeros."""
    rows = panel.join(date_index(panel, spec), spec.date)
    last = panel.agg(F.countDistinct(spec.date).cast("int").alias("last_t"))
    pairs = F.sort_array(F.collect_list(F.when(F.col(spec.target) != 0, F.struct("t", F.col(spec.target).cast("double").alias("y")))))
    out = rows.groupBy(spec.id).agg(pairs.alias("p"))
    return out.crossJoin(F.broadcast(last)).select(spec.id, "last_t", F.col("p.t").alias("t"), F.col("p.y").alias("y"))


def duplicates(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Keys that occur more than once; a panel must have none."""
    return panel.groupBy(spec.id, spec.date).agg(F.count("*").alias("n")).where("n > 1")


def price_fill(panel: DataFrame, mode: str = "history", days: int = 28, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date and price of every series on the last `days` dates of the grid: the last known price, else the next one, else 1.

    history: earlier prices from before the window count; window: only those inside it.
    """
    index = date_index(panel, spec)
    top = index.agg(F.max("t").alias("top"))
    recent = index.crossJoin(F.broadcast(top)).where(F.col("t") > F.col("top") - days).select(spec.date, "t")
    rows = panel.select(spec.id, spec.date, spec.price)
    grid = panel.select(spec.id).distinct().crossJoin(F.broadcast(recent))
    if mode == "window":
        known = rows.join(F.broadcast(recent.select(spec.date)), spec.date)
    elif mode == "history":
        known = rows
    else:
        raise ValueError("price fill mode must be history or window")
    full = grid.select(spec.id, spec.date, F.lit(1).alias("asked")).join(known, [spec.id, spec.date], "full")
    order = Window.partitionBy(spec.id).orderBy(spec.date)
    before = F.last(spec.price, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(spec.price, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return full.withColumn("price", F.coalesce(before, after, F.lit(1.0))).where("asked = 1").select(spec.id, spec.date, "price")


def covariate_frames(hist: DataFrame, future: DataFrame, known: tuple[str, ...], past: tuple[str, ...] = (), spec: PanelSpec = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The training and the future projection for a model with covariates: known ones must be in both frames, past ones in the history; others are left out."""
    both = [c for c in known if c in hist.columns and c in future.columns]
    only = [c for c in past if c in hist.columns and c not in both]
    return hist.select(spec.id, spec.date, spec.target, *both, *only), future.select(spec.id, spec.date, *both)
