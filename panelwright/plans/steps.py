"""Steps with fit and transform over long panels, and the registry that names them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decouple import decouple, decouple_summary
from ..operators.impute import apply_fills, fit_medians, impute
from ..operators.impute import METHODS as IMPUTE_METHODS
from ..operators.neutralize import neutralize
from ..operators.neutralize import METHODS as NEUTRAL_METHODS
from ..operators.outlier import METHODS as OUTLIER_METHODS
from ..operators.outlier import apply_bounds, fit_sigma_bounds, tame
from ..operators.standardize import METHODS as SCALE_METHODS
from ..operators.standardize import standardize
from ..operators.transform import METHODS as SHAPE_METHODS
from ..operators.transform import needs_transform, reshape
from ..operators.whiten import garch_whiten, rolling_whiten
from ..sources.panels import attach_industry
from .errors import AdapterImportError, ConfigurationError
from .order import StepType


@runtime_checkable
class PipelineStepProtocol(Protocol):
    name: str

    def fit(self, panel: DataFrame, **kwargs: Any) -> Any: ...

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame: ...


class PipelineStep(ABC):
    """A step; anything with its methods can stand in a pipeline."""

    step_type: StepType | None = None

    def __init__(self, name: str, **params: Any):
        self.name, self.params, self.fitted = name, params, False

    @abstractmethod
    def fit(self, panel: DataFrame, **kwargs: Any) -> PipelineStep: ...

    @abstractmethod
    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame: ...

    def fit_transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return self.fit(panel, **kwargs).transform(panel, **kwargs)

    def get_stats(self) -> dict[str, Any]:
        return {"name": self.name, "step_type": self.step_type.value if self.step_type else None, "fitted": self.fitted, **self.params}


class Stateless(PipelineStep):
    """A step whose statistics are those of the frame it transforms."""

    known: tuple[str, ...] = ()

    def __init__(self, name: str, method: str = "auto", **params: Any):
        if self.known and method not in self.known:
            raise ConfigurationError(f"unknown method {method!r}", step_name=name, context={"known": self.known})
        super().__init__(name, method=method, **params)

    def fit(self, panel: DataFrame, **kwargs: Any) -> Stateless:
        self.fitted = True
        return self


class Impute(Stateless):
    """``fit_stats`` keeps the medians of fit for transform."""

    step_type, known = StepType.IMPUTATION, IMPUTE_METHODS

    def __init__(self, name: str = "imputation", strategy: str = "auto", fill_value: float | None = None, fit_stats: bool = False):
        super().__init__(name, strategy, fill_value=fill_value, fit_stats=fit_stats)
        self.fills: DataFrame | None = None

    def fit(self, panel: DataFrame, **kwargs: Any) -> Impute:
        self.fills = fit_medians(panel) if self.params["fit_stats"] else None
        return super().fit(panel)

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return apply_fills(panel, self.fills) if self.fills is not None else impute(panel, self.params["method"], self.params["fill_value"])


class Tame(Stateless):
    step_type, known = StepType.OUTLIER_DETECTION, OUTLIER_METHODS

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return tame(panel, **self.params)


class SigmaClip(PipelineStep):
    """Bounds of the fitted panel, applied to any."""

    step_type = StepType.OUTLIER_DETECTION

    def fit(self, panel: DataFrame, **kwargs: Any) -> SigmaClip:
        self.bounds, self.fitted = fit_sigma_bounds(panel, self.params.get("sigmas", 3.0)), True
        return self

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return apply_bounds(panel, self.bounds)


class Reshape(Stateless):
    step_type, known = StepType.TRANSFORMATION, SHAPE_METHODS

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return reshape(panel, **self.params)


class GatedReshape(PipelineStep):
    """Reshapes only the factors that the fitted panel's skewness and kurtosis call for."""

    step_type = StepType.TRANSFORMATION

    def fit(self, panel: DataFrame, **kwargs: Any) -> GatedReshape:
        self.gate, self.fitted = needs_transform(panel, self.params.get("skew", 2.0), self.params.get("kurtosis", 5.0)).where("needed").select("factor"), True
        return self

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        shaped = reshape(panel.join(self.gate, "factor", "left_semi"), self.params.get("method", "yeo_johnson"))
        return shaped.unionByName(panel.join(self.gate, "factor", "left_anti"))


class Standardize(Stateless):
    step_type, known = StepType.STANDARDIZATION, SCALE_METHODS

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return standardize(panel, **self.params)


class Neutralize(Stateless):
    """Industry comes from the panel, from ``industry`` (also as a keyword of fit and transform), or from an
    external callable; without any of them the panel passes unchanged and ``skipped`` says so.
    """

    step_type, known = StepType.NEUTRALIZATION, NEUTRAL_METHODS

    def __init__(self, name: str = "neutralization", method: str = "ols", industry: DataFrame | None = None, **params: Any):
        super().__init__(name, method, **params)
        self.industry, self.skipped = industry, False

    def transform(self, panel: DataFrame, industry: DataFrame | None = None, external_neutralizer: Callable | None = None, **kwargs: Any) -> DataFrame:
        table = self.industry if self.industry is not None else industry
        if table is not None:
            panel = attach_industry(panel.drop("industry", "known"), table)
        self.skipped = False
        if "industry" in panel.columns:
            return neutralize(panel, **self.params)
        if external_neutralizer is not None:
            call = getattr(external_neutralizer, "industry_neutralization", external_neutralizer)
            return call(panel, self.params["method"])
        self.skipped = True
        return panel

    def get_stats(self) -> dict[str, Any]:
        return super().get_stats() | {"skipped": self.skipped}


class Refitted(PipelineStep):
    """A step that is refitted on what it transforms."""

    def fit(self, panel: DataFrame, **kwargs: Any) -> Refitted:
        self.fitted = True
        return self


class Garch(Refitted):
    """Volatility whitening."""

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return garch_whiten(panel, **self.params)

    def _fits(self, panel: DataFrame) -> DataFrame:
        return garch_whiten(panel, **self.params, with_aic=True).groupBy("factor", "asset").agg(F.max("aic").alias("aic"))

    def mean_aic(self, panel: DataFrame) -> DataFrame:
        return self._fits(panel).groupBy("factor").agg(F.avg("aic").alias("mean_aic"))

    def get_stats(self, panel: DataFrame | None = None) -> dict[str, Any]:
        """With a panel also the figures of its fits, which takes a job; assets left out are counted, not listed."""
        if panel is None:
            return super().get_stats()
        row = self._fits(panel).agg(F.count("aic").alias("fitted_models"), F.count_if(F.col("aic").isNull()).alias("skipped_columns"), F.avg("aic").alias("average_aic")).first()
        return super().get_stats() | row.asDict()


class RollingWhiten(Refitted):
    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return rolling_whiten(panel, **self.params)


class Decouple(Refitted):
    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return decouple(panel, **self.params)

    def get_summary(self, panel: DataFrame) -> DataFrame:
        return decouple_summary(panel, self.params.get("max_order", 5), self.params.get("criterion", "aic"))


#: The class of each type of step, and of each name that a configuration may give.
REGISTRY: dict[str, type] = {t.step_type.value: t for t in (Impute, Tame, Reshape, Standardize, Neutralize)} | {
    "SigmaClip": SigmaClip, "GatedReshape": GatedReshape, "Garch": Garch, "RollingWhiten": RollingWhiten, "Decouple": Decouple,
}


def make_step(kind: StepType, class_name: str = "", name: str | None = None, **params: Any) -> PipelineStep:
    """A registered step; nothing is imported by path."""
    key = class_name or kind.value
    if key not in REGISTRY:
        raise AdapterImportError(f"no step named {key!r}", class_name=class_name, context={"known": sorted(REGISTRY)})
    return REGISTRY[key](name or kind.value, **params)
