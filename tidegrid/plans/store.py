"""Where prepared data, forecasts and metrics are kept, and when they are still good."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import panel as P
from tidegrid.operators.weights import weights_scales
from tidegrid.sources.panels import read_panel, star_panel
from tidegrid.spec import DEFAULT, PanelSpec

STAR_TABLES = ("lineitem", "part", "supplier", "nation", "region")
PREPARED = ("hist", "future", "static", "hist_trimmed", "weights_scales")


def folder(base: str, tag: str, level: int, cutoff: str) -> str:
    return f"{base.rstrip('/')}/{tag}/level_{level}/{cutoff.replace('-', '')}"


def model_paths(base: str, tag: str, level: int, cutoff: str, model: str) -> dict[str, str]:
    at = f"{folder(base, tag, level, cutoff)}/models/{model}"
    return {"folder": at, "forecast": f"{at}/forecasts.parquet", "metrics": f"{at}/metrics.json"}


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, at = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark, "_tidegrid_store"):
        holder = tempfile.TemporaryDirectory(prefix="tidegrid-")
        atexit.register(holder.cleanup)
        spark._tidegrid_store = holder
    return spark._tidegrid_store.name


def stamp(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and times of all files at the paths: it changes with the data."""
    seen = []
    for path in paths:
        fs, at = _fs(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel of a star schema, joined and summed once for as long as its tables do not change, then read from the shared folder: queries that use it many times scan no facts."""
    at = f"{shared_folder(spark)}/star-{stamp(spark, [f'{sf_dir}/{t}.parquet' for t in STAR_TABLES])[:32]}"
    if not complete(spark, at):
        star_panel(spark, sf_dir).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def prepared(spark: SparkSession, path: str, base: str, tag: str, cutoff: str, level: int = 12, force: bool = False, spec: PanelSpec = DEFAULT) -> dict[str, DataFrame]:
    """The five frames of a level and cutoff, from the cache if all of them are complete there, else made and written.

    Scales and weights come from the lowest level whatever the level asked for.
    """
    at = folder(base, tag, level, cutoff)
    paths = {name: f"{at}/{name}.parquet" for name in PREPARED}
    if force or not all(complete(spark, p) for p in paths.values()):
        lowest = P.clean(read_panel(spark, path, 12, spec), spec)
        rows = P.aggregate_level(lowest, level, spec)
        hist, future = P.split(rows, cutoff, spec)
        frames = {"hist": hist, "future": future, "static": P.static_columns(rows, spec), "hist_trimmed": P.trim(hist, "positive", spec), "weights_scales": weights_scales(P.split(lowest, cutoff, spec)[0], spec=spec)}
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(paths[name])
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def forecast(spark: SparkSession, make: Callable[[], DataFrame], base: str, tag: str, cutoff: str, model: str, level: int = 12, force: bool = False) -> DataFrame:
    """A model's forecasts, from its own cache folder or made and written there."""
    at = model_paths(base, tag, level, cutoff, model)["forecast"]
    if force or not complete(spark, at):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def save_metrics(spark: SparkSession, metrics: dict, base: str, tag: str, cutoff: str, model: str, level: int = 12) -> str:
    """Writes one JSON object of numbers and nested objects of numbers."""
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else (v if isinstance(v, (str, bool, int)) or v is None else float(v))
    at = model_paths(base, tag, level, cutoff, model)["metrics"]
    fs, path = _fs(spark, at)
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(plain(metrics), indent=2).encode()))
    out.close()
    return at


def leaderboard(spark: SparkSession, base: str, tag: str, cutoff: str, level: int = 12) -> DataFrame:
    """One row for each metrics file of a level and cutoff, with exp_tag, best WRMSSE first; no rows if there are none."""
    at = f"{folder(base, tag, level, cutoff)}/models"
    fs, path = _fs(spark, f"{at}/*/metrics.json")
    found = fs.globStatus(path)
    if not found:
        return spark.createDataFrame([], "exp_tag string, WRMSSE double")
    rows = spark.read.option("multiLine", True).json(f"{at}/*/metrics.json").withColumn("exp_tag", F.regexp_extract(F.col("_metadata.file_path"), r"/models/([^/]+)/metrics\.json$", 1))
    return rows.orderBy(F.col("WRMSSE").asc_nulls_last(), "exp_tag") if "WRMSSE" in rows.columns else rows
