"""Readers: raw panels in parquet, wide truth in CSV, and panels derived from a star schema or an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.spec import DEFAULT, PanelSpec

CALENDAR_SCHEMA = T.StructType([T.StructField("d", T.StringType()), T.StructField("date", T.DateType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The columns of a parquet data set, from its footers alone."""
    return spark.read.parquet(path).columns


def read_panel(spark: SparkSession, path: str, level: int = 12, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The columns of a raw panel that a level needs, the target under its own name. Absent optional columns are left out."""
    frame = spark.read.parquet(path)
    have = set(frame.columns)
    target = next((a for a in (*spec.target_aliases, spec.target) if a in have), None)
    if target is None:
        raise ValueError(f"no target column: none of {(*spec.target_aliases, spec.target)} in {sorted(have)}")
    keys = spec.static if level == 12 else spec.levels[level]
    optional = [c for c in dict.fromkeys((*spec.covariates, *keys, *spec.static)) if c in have]
    return frame.select(spec.id, F.to_date(spec.date).alias(spec.date), F.col(target).cast("double").alias(spec.target), *optional)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CALENDAR_SCHEMA)


def read_wide_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of one line a series and one column a day; numbers stay text until they are melted."""
    return spark.read.csv(path, header=True)


def melt_truth(wide: DataFrame, calendar: DataFrame, prefix: str = "d_", spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date and target of a wide truth table. Day columns start with the prefix; a day the calendar lacks has no date.

    Without an id column, ids are item, store and the suffix that strip_suffix() takes off.
    """
    days = [c for c in wide.columns if c.startswith(prefix)]
    if spec.id not in wide.columns:
        wide = wide.withColumn(spec.id, F.concat_ws("_", "item_id", "store_id", F.lit("evaluation")))
    long = wide.select(spec.id, *[F.col(c).cast("double").alias(c) for c in days]).unpivot(spec.id, days, "d", spec.target)
    return long.join(calendar.select("d", spec.date), "d", "left").select(spec.id, spec.date, spec.target)


def strip_suffix(id_: Column, suffixes: tuple[str, ...] = ("_evaluation",)) -> Column:
    for s in suffixes:
        id_ = F.replace(id_, F.lit(s), F.lit(""))
    return id_


def calendar_columns(date: Column) -> dict[str, Column]:
    """Deterministic calendar covariates: weeks begin on Saturday (wday 1), flags follow the day of the month."""
    since = F.datediff(date, F.to_date(F.lit("1994-12-31")))
    day = F.dayofmonth(date)
    first = day == 1
    return {
        "wm_yr_wk": F.floor(since / 7).cast("short"),
        "wday": (F.pmod(since, F.lit(7)) + 1).cast("byte"),
        "month": F.month(date).cast("byte"),
        "year": F.year(date).cast("short"),
        "event_name_1": F.when(first, F.concat(F.lit("MonthStart_"), F.month(date).cast("string"))),
        "event_type_1": F.when(first, F.lit("Calendar")),
        "snap_CA": (day <= 10).cast("byte"),
        "snap_TX": day.between(6, 15).cast("byte"),
        "snap_WI": day.between(11, 20).cast("byte"),
    }


def star_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel brand x nation of a star schema: sales are summed, prices averaged; brands nest in departments and categories.

    Line items are summed by part, supplier and day before they meet the dimensions, so the joins see fewer rows.
    """
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("prices"), F.count("*").alias("n"))
    )
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    dept = F.floor((brand - 1) / 5).cast("int")
    item = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item_id"), F.concat(F.lit("DEPT_"), dept.cast("string")).alias("dept_id"), F.concat(F.lit("CAT_"), F.floor(dept / 2).cast("string")).alias("cat_id"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    store = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    keys = ("item_id", "dept_id", "cat_id", "store_id", "state_id", "date")
    daily = (
        sold.join(item, F.col("l_partkey") == F.col("p_partkey"))
        .join(store, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(*keys)
        .agg(F.sum("quantity").alias("sales_quantity"), (F.sum("prices") / F.sum("n")).alias("sell_price"))
    )
    return daily.select(F.concat_ws("_", "item_id", "store_id").alias("id"), "date", "sales_quantity", "sell_price", *keys[:-1], *[c.alias(n) for n, c in calendar_columns(F.col("date")).items()])


def event_panel(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """id, date and target of an event log: events a day for each value of a column."""
    return table(spark, sf_dir, "events").groupBy(F.col(by).cast("string").alias("id"), F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("sales_quantity"))
