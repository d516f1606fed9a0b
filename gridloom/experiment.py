"""Timed runs of loader x preprocess x kernel."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridloom.errors import FunctionNotFoundError
from gridloom.model import Sparse2D
from gridloom.operators.permute import permute_2d
from gridloom.operators.reorder import reorder

log = logging.getLogger("gridloom")
#: Levels by name, from all messages to none.
LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "off": logging.CRITICAL + 1}


def set_log(level: str = "warning", to_console: bool = True, file: str | None = None) -> None:
    """Messages of ``level`` and above go to the console, a file or both; what an earlier call set up is replaced."""
    if level not in LEVELS:
        raise FunctionNotFoundError(f"no level is named {level}")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler()] * to_console + ([logging.FileHandler(file)] if file else []):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(LEVELS[level])
    log.propagate = False


@dataclass
class Experiment:
    """Runs each kernel ``times`` times on what each preprocess makes of what each loader loads from each target.

    A loader takes a target and gives a dict; a preprocess takes (dict, params) and adds to it, by default under keys
    that are not there yet; a kernel takes (dict, preprocess params, kernel params) and gives a result. Results that are
    DataFrames are computed in full within the measured time. Keys of times and results are
    (target, preprocess, kernel, iteration).
    """

    spark: SparkSession
    loaders: list[tuple[Callable[[Any], dict], list]] = field(default_factory=list)
    preprocesses: list[tuple[str, Callable, Any]] = field(default_factory=list)
    kernels: list[tuple[str, Callable, Any]] = field(default_factory=list)
    times: dict[tuple, float] = field(default_factory=dict)
    results: dict[tuple, Any] = field(default_factory=dict)
    auxiliary: dict[tuple, Any] = field(default_factory=dict)

    def add_loader(self, loader: Callable[[Any], dict], targets: Iterable) -> Experiment:
        self.loaders.append((loader, list(targets)))
        return self

    def add_preprocess(self, name: str, step: Callable, params: Any = None) -> Experiment:
        self.preprocesses.append((name, step, params))
        return self

    def add_kernel(self, name: str, kernel: Callable, params: Any = None) -> Experiment:
        self.kernels.append((name, kernel, params))
        return self

    def run(self, times: int = 1, store_auxiliary: bool = False) -> Experiment:
        for loader, targets in self.loaders:
            for target in targets:
                loaded = loader(target)
                if store_auxiliary:
                    self.auxiliary |= {(k, target): v for k, v in loaded.items()}
                for p, step, params in self.preprocesses or [("pass", pass_through, None)]:
                    data = dict(loaded)
                    step(data, params)
                    if store_auxiliary:
                        self.auxiliary |= {(k, target, p): v for k, v in data.items() if k not in loaded}
                    for name, kernel, kernel_params in self.kernels:
                        for n in range(times):
                            began = time.perf_counter()
                            result = kernel(data, params, kernel_params)
                            if isinstance(result, DataFrame):
                                result.write.format("noop").mode("overwrite").save()
                            key = (str(target), p, name, n)
                            self.times[key], self.results[key] = time.perf_counter() - began, result
                            log.info("%s: %.3f s", key, self.times[key])
        return self

    def table(self) -> DataFrame:
        """(target, preprocess, kernel, iteration, seconds)."""
        rows = [(*k, s) for k, s in self.times.items()]
        return self.spark.createDataFrame(rows, "target string, preprocess string, kernel string, iteration int, seconds double")


def load_matrix(read: Callable[[Any], Sparse2D]) -> Callable[[Any], dict]:
    """A loader that puts what ``read`` gives under 'format'."""
    return lambda target: {"format": read(target)}


def pass_through(data: dict, params: Any = None) -> None:
    """The matrix as it is, under 'processed_format'."""
    data.setdefault("processed_format", data["format"])


def reordered(name: str, **order_params: Any) -> Callable[[dict, Any], None]:
    """A preprocess that reorders both axes by the order ``name``."""

    def step(data: dict, params: Any = None) -> None:
        order = reorder(name, data["format"], **order_params)
        data.setdefault("order", order)
        data.setdefault("processed_format", permute_2d(data["format"], order, order))

    return step
