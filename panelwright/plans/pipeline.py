"""An ordered pipeline: one lazy plan of checked steps, with a record of each."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import PipelineConfig
from .errors import ConfigurationError, OrderValidationError, StepExecutionError
from .order import StepType, check_order, suggest_order
from .steps import PipelineStep, make_step


def profile(panel: DataFrame) -> DataFrame:
    """One row: cells, missing cells, dates, assets (over all factors)."""
    return panel.agg(
        F.count("*").alias("cells"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_distinct("date").alias("dates"), F.count_distinct("factor", "asset").alias("assets")
    )


@dataclass
class StepResult:
    step_name: str
    step_type: str | None
    success: bool = True
    execution_time_ms: float = 0.0
    input_shape: tuple[int, int] | None = None
    output_shape: tuple[int, int] | None = None
    input_missing_rate: float | None = None
    output_missing_rate: float | None = None
    stats: dict[str, Any] = field(default_factory=dict)
    error: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "stats" and not (k == "error" and v is None)}


@dataclass
class PipelineResult:
    success: bool
    data: DataFrame
    steps: list[StepResult]
    total_time_ms: float

    def to_dict(self) -> dict[str, Any]:
        """Everything but the data, the stats and each step's error."""
        return {"success": self.success, "total_time_ms": self.total_time_ms, "steps": [{k: v for k, v in s.to_dict().items() if k != "error"} for s in self.steps]}


class OrderedPipeline:
    """Steps by name (a later one replaces its namesake), in a validated order."""

    def __init__(self, steps: Sequence[PipelineStep] = (), config: PipelineConfig | None = None, strict_order: bool | None = None):
        self.strict = strict_order if strict_order is not None else config.strict_order if config else True
        made = list(steps)
        if not made and config is not None:
            made = [make_step(s.step_type, s.class_name, **s.params) for s in config.steps if s.enabled]
        self.name = config.name if config else "pipeline"
        self.steps = list({s.name: s for s in made}.values())
        self.results: list[StepResult] = []
        untyped = [s.name for s in made if not isinstance(s.step_type, StepType)]
        if untyped:
            raise ConfigurationError("these steps belong in a routed pipeline", context={"steps": untyped})
        order = [s.step_type for s in made]
        wrong = check_order(order, self.strict)
        if wrong and self.strict:
            raise OrderValidationError("; ".join(wrong), context={"errors": wrong, "suggested_order": [t.value for t in suggest_order(order)]})
        self.warnings = wrong

    @classmethod
    def default_pipeline(cls) -> OrderedPipeline:
        return cls(config=PipelineConfig.default_config())

    def fit(self, panel: DataFrame, **kwargs: Any) -> OrderedPipeline:
        """Fit each step on what those before it make of the panel; the plan stays lazy."""
        for s in self.steps:
            s.fit(panel, **kwargs)
            if s.step_type is not StepType.NEUTRALIZATION:
                panel = s.transform(panel, **kwargs)
        return self

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        """The steps as one plan."""
        self._fitted()
        for s in self.steps:
            panel = s.transform(panel, **kwargs)
        return panel

    def fit_transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return self.fit(panel, **kwargs).transform(panel, **kwargs)

    def _fitted(self) -> None:
        missing = [s.name for s in self.steps if not getattr(s, "fitted", True)]
        if missing:
            raise StepExecutionError("fit comes before transform", context={"steps": missing})

    def execute(self, panel: DataFrame, measure: bool = True, raise_on_error: bool = False, **kwargs: Any) -> PipelineResult:
        """Run step by step and record each.

        A failed step leaves the data as they were; strict pipelines stop there, others go on, and ``raise_on_error``
        raises.  ``measure`` runs one aggregate at each boundary, which is also where lazy errors of a step come up;
        each step's output is persisted until its successor is done, so no step is computed twice.
        """
        self._fitted()
        self.results, began, held = [], time.perf_counter(), []
        before = profile(panel).first() if measure else None
        for s in self.steps:
            r, start = StepResult(s.name, s.step_type.value if s.step_type else None), time.perf_counter()
            try:
                out = s.transform(panel, **kwargs)
                after = None
                if measure:
                    held.append(out := out.persist())
                    after = profile(out).first()
            except (PySparkException, ValueError, TypeError, RuntimeError, KeyError, IndexError, StepExecutionError) as e:
                r.success, r.error = False, str(StepExecutionError(f"{type(e).__name__}: {e}", s.name, original_error=e))
                if raise_on_error:
                    raise StepExecutionError(str(e), s.name, original_error=e) from e
            else:
                panel = out
                if measure:
                    r.input_shape, r.output_shape = (before.dates, before.assets), (after.dates, after.assets)
                    r.input_missing_rate, r.output_missing_rate = (x.missing / x.cells if x.cells else 0.0 for x in (before, after))
                    before = after
                r.stats = s.get_stats() if hasattr(s, "get_stats") else {}
            r.execution_time_ms = 1000 * (time.perf_counter() - start)
            self.results.append(r)
            if len(held) > 1:
                held.pop(0).unpersist()
            if not r.success and self.strict:
                break
        return PipelineResult(all(r.success for r in self.results), panel, self.results, 1000 * (time.perf_counter() - began))

    def summary(self) -> str:
        if not self.results:
            return "The pipeline has not run yet."
        lines = [f"Pipeline {self.name}: {len(self.results)} steps"]
        for r in self.results:
            lines.append(f"  {r.step_name} ({r.step_type}): {'ok' if r.success else 'FAILED'}, {r.execution_time_ms:.1f} ms, missing {r.input_missing_rate} > {r.output_missing_rate}")
            lines += [f"    {r.error}"] * (r.error is not None)
        return "\n".join(lines)
