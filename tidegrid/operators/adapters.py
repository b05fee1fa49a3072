"""Model adapters: a registry of forecasters behind one signature, with the configuration of the heavier ones."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tidegrid.operators import forecast
from tidegrid.functions import kernels
from tidegrid.spec import DEFAULT, PanelSpec

# Option names and defaults of the two neural models' configurations.
NEURAL_DEFAULTS: dict[str, dict] = {
    "chronos2": {"model_path": "autogluon/chronos-2", "context_length": 2, "fine_tune_steps": 0, "fine_tune_mode": "lora", "device": "cpu", "batch_size": 32, "num_samples": 20, "known_cov_cols": [], "past_cov_cols": [], "use_static": False},
    "tft": {"context_length": 56, "hidden_size": 64, "num_heads": 4, "dropout_rate": 0.1, "lr": 1e-3, "max_epochs": 100, "patience": 10, "known_cov_cols": ["wday", "month", "snap_CA", "snap_TX", "snap_WI", "event_type_1"], "past_cov_cols": [], "use_static": True},
}
FITTED = {"chronos2": ("model_path", "context_length", "device", "batch_size"), "tft": ("context_length", "hidden_size", "num_heads", "dropout_rate", "lr", "max_epochs", "patience")}
FINE_TUNING = {"fine_tune_mode": "lora", "fine_tune_lr": 1e-4}


class MissingBackend(RuntimeError):
    """A model is known, but what it needs is not installed."""


@dataclass(frozen=True)
class FitOptions:
    eval_metric: str = "RMSSE"
    quantile_levels: tuple[float, ...] = ()
    enable_ensemble: bool = False
    skip_model_selection: bool = True
    verbosity: int = 2


@dataclass(frozen=True)
class Adapter:
    """fit_predict(hist, future, static, horizon, config, options) returns id, date and target; None where no backend is installed."""

    name: str
    fit_predict: Callable[..., DataFrame] | None
    defaults: dict = field(default_factory=dict)


_registry: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    _registry[adapter.name] = adapter


def known() -> tuple[str, ...]:
    return tuple(sorted(_registry))


def device_name(device: object, has_gpu: bool = False) -> str:
    """A device string that model loaders accept: "gpu" and unknown values become "cuda" or "cpu", others stay."""
    text = str(device)
    if text != "gpu" and re.fullmatch(r"cpu|auto|balanced|balanced_low_0|sequential|cuda(:\d+)?", text):
        return text
    return "cuda" if has_gpu else "cpu"


def hyperparameters(model: str, config: dict | None = None, has_gpu: bool = False) -> dict:
    """The fitted options of a neural model from a user's configuration; fine-tuning options only if there are steps."""
    if model not in NEURAL_DEFAULTS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(NEURAL_DEFAULTS)}")
    merged = NEURAL_DEFAULTS[model] | (config or {})
    out = {k: merged[k] for k in FITTED[model]}
    if "device" in out:
        out["device"] = device_name(out["device"], has_gpu)
    if model == "chronos2" and merged["fine_tune_steps"] > 0:
        out |= {"fine_tune_steps": merged["fine_tune_steps"]} | {k: (config or {}).get(k, v) for k, v in FINE_TUNING.items()}
    return out


def run(methods: tuple[str, ...], hist: DataFrame, future: DataFrame | None = None, static: DataFrame | None = None, horizon: int = 28, config: dict | None = None, options: FitOptions | None = None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """id, date, method and target of any local methods and registered models."""
    forecast.check_methods(methods, known())
    local = tuple(m for m in methods if m in kernels.METHODS)
    out = forecast.local(hist, local, horizon, spec) if local else None
    from pyspark.sql import functions as F

    for name in (m for m in methods if m not in local):
        adapter = _registry[name]
        if adapter.fit_predict is None:
            raise MissingBackend(f"{name} needs a backend that is not installed; register() an Adapter that has one")
        rows = adapter.fit_predict(hist, future, static, horizon, adapter.defaults | (config or {}), options or FitOptions(), replace(spec))
        rows = rows.select(spec.id, spec.date, F.lit(name).alias("method"), F.greatest(spec.target, F.lit(0.0)).alias(spec.target))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no methods given")
    return out


register(Adapter("es_bu", lambda hist, future, static, horizon, config, options, spec: forecast.smoothing_model(hist, horizon, spec)))
register(Adapter("arima_bu", lambda hist, future, static, horizon, config, options, spec: forecast.autoregression(hist, horizon, spec)))
for _name, _defaults in NEURAL_DEFAULTS.items():
    register(Adapter(_name, None, _defaults))
