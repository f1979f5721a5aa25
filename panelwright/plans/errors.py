"""What can go wrong, with the context that a log needs."""

from __future__ import annotations

from typing import Any


class PipelineError(Exception):
    """Base of all errors; ``extra`` names the attributes that a subclass adds to its dictionary."""

    extra: tuple[str, ...] = ()

    def __init__(self, message: str, step_name: str | None = None, factor_name: str | None = None, context: dict[str, Any] | None = None, **more: Any):
        super().__init__(message)
        unknown = set(more) - set(self.extra)
        if unknown:
            raise TypeError(f"unexpected arguments {sorted(unknown)}")
        self.message, self.step_name, self.factor_name, self.context = message, step_name, factor_name, dict(context or {})
        for name in self.extra:
            setattr(self, name, more.get(name))

    def to_dict(self) -> dict[str, Any]:
        base = {"error_type": type(self).__name__, "message": self.message, "step_name": self.step_name, "factor_name": self.factor_name, "context": self.context}
        return base | {name: getattr(self, name) for name in self.extra}

    def __str__(self) -> str:
        said = {"Step": self.step_name, "Factor": self.factor_name, "Context": self.context}
        return " | ".join([f"[{type(self).__name__}] {self.message}", *(f"{k}: {v}" for k, v in said.items() if v)])


class OrderValidationError(PipelineError, ValueError):
    """Steps in an order that statistics forbid."""


class StepExecutionError(PipelineError):
    """A step failed; ``original_error`` is what it raised."""

    extra = ("original_error",)

    def to_dict(self) -> dict[str, Any]:
        out = super().to_dict()
        cause = out.pop("original_error")
        return out | ({"original_error": f"{type(cause).__name__}: {cause}"} if cause else {})


class AdapterImportError(PipelineError):
    """A step's class is not registered."""

    extra = ("module_path", "class_name")


class ConfigurationError(PipelineError, ValueError):
    """A parameter out of its range or set."""


class FactorTypeError(PipelineError, TypeError):
    """Data that can't be a panel."""


class NeutralizationError(PipelineError):
    """Neutralization lacks what it regresses on."""


class GarchFittingError(PipelineError):
    """A volatility model that can't be fitted."""


class MigrationAlertError(PipelineError):
    """A factor changed its type; raised only where a caller asks for it."""

    extra = ("old_type", "new_type", "confidence")
