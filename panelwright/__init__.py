"""A PySpark-native engine for factor panels, and operators for training data in ``panelwright.llm``.

Names are loaded on first use, so that Python workers import only what they run.
"""

from __future__ import annotations

import importlib

__version__ = "1.0.0"

_HOMES = {
    "plans.pipeline": ("OrderedPipeline", "PipelineResult", "StepResult"),
    "plans.router": ("FactorRouter", "RouterConfig", "static_pipeline", "dynamic_pipeline", "mixed_pipeline"),
    "plans.config": ("PipelineConfig", "StepConfig"),
    "plans.order": ("StepType", "check_order", "suggest_order"),
    "plans.steps": ("PipelineStep", "PipelineStepProtocol", "Impute", "Tame", "Reshape", "Standardize", "Neutralize", "Garch", "Decouple", "make_step"),
    "plans.report": ("ExecutionReport", "Profiler"),
    "plans.errors": ("PipelineError", "OrderValidationError", "StepExecutionError", "ConfigurationError", "FactorTypeError", "NeutralizationError", "GarchFittingError", "MigrationAlertError"),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = ["check_v2_availability", *_HOME_OF]


def check_v2_availability() -> bool:
    """Whether the routed pipelines can be used: they have no optional parts, so always."""
    return True


def __getattr__(name: str):
    if name in _HOME_OF:
        return getattr(importlib.import_module(f".{_HOME_OF[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
