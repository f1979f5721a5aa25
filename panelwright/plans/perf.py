"""Timing, a small cache, batches and benchmarks."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def timed(name: str | None = None) -> Callable:
    """Log how long a call takes, also one that raises. On a lazy plan wrap the action."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args: Any, **kwargs: Any) -> Any:
            start = time.perf_counter()
            try:
                return fn(*args, **kwargs)
            finally:
                log.info("%s: %.2f ms", name or fn.__name__, 1000 * (time.perf_counter() - start))

        return run

    return wrap


class SimpleCache:
    """Keeps the entries that are read most; a new one replaces the least read. For driver values, not for data."""

    def __init__(self, max_size: int = 100):
        self.max_size, self._kept, self._reads = max_size, {}, {}

    def get(self, key: Any) -> Any:
        if key in self._kept:
            self._reads[key] += 1
        return self._kept.get(key)

    def set(self, key: Any, value: Any) -> None:
        if key not in self._kept and len(self._kept) >= self.max_size:
            least = min(self._reads, key=self._reads.get)
            del self._kept[least], self._reads[least]
        self._kept[key] = value
        self._reads.setdefault(key, 0)

    def clear(self) -> None:
        self._kept.clear()
        self._reads.clear()

    def __len__(self) -> int:
        return len(self._kept)


def cached(cache: SimpleCache, key_func: Callable | None = None) -> Callable:
    """Look results up by key, by default the arguments' text; None is never kept."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args: Any, **kwargs: Any) -> Any:
            key = key_func(*args, **kwargs) if key_func else (fn.__qualname__, str(args), str(sorted(kwargs.items())))
            found = cache.get(key)
            if found is None:
                found = fn(*args, **kwargs)
                if found is not None:
                    cache.set(key, found)
            return found

        return run

    return wrap


def batch_process(data: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Apply a pandas function to batches: Arrow batches of rows, or the groups of ``by`` (each factor or asset whole)."""
    out = schema or data.schema
    if by:
        return data.groupBy(*by).applyInPandas(lambda pdf: fn(pdf), out)

    def each(batches):
        for pdf in batches:
            yield fn(pdf)

    return data.mapInPandas(each, out)


def benchmark(fn: Callable[[], Any], n_runs: int = 5, warmup: int = 1) -> dict[str, float]:
    """Milliseconds of runs after warm-up; a DataFrame that comes back is run into the noop sink."""

    def once() -> float:
        start = time.perf_counter()
        got = fn()
        if isinstance(got, DataFrame):
            got.write.format("noop").mode("overwrite").save()
        return 1000 * (time.perf_counter() - start)

    for _ in range(warmup):
        once()
    ms = np.array([once() for _ in range(n_runs)])
    return {"mean_ms": ms.mean(), "std_ms": ms.std(), "min_ms": ms.min(), "max_ms": ms.max(), "median_ms": float(np.median(ms)), "n_runs": n_runs}
