"""A panel kept from a stream of sales events: daily sums by series, final once the watermark passes the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.spec import DEFAULT, PanelSpec


def daily_panel(events: DataFrame, id_: str, ts: str = "ts", value: str | None = None, delay: str = "1 day", spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date and target of a stream (or a batch) of events: counts, or sums of a value, by series and day. Events later than the delay are dropped."""
    amount = F.count("*").cast("double") if value is None else F.sum(value)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, "1 day"), F.col(id_).cast("string").alias(spec.id)).agg(amount.alias(spec.target)).select(spec.id, F.to_date("window.start").alias(spec.date), spec.target)
