"""Validated configurations of the routed pipelines.

Names, bounds and defaults of the fields are fixed values: they are the format of
configuration files. A key that no field has is an error.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, model_validator

from . import config as ordered
from .order import StepType

Share = Field(ge=0, le=1)


class Checked(BaseModel):
    model_config = ConfigDict(validate_assignment=True, extra="forbid")


class StepConfigV2(Checked):
    step_type: str
    enabled: bool = True
    params: dict[str, Any] = Field(default_factory=dict)


class ImputationConfig(Checked):
    strategy: Literal["auto", "mean", "median", "most_frequent", "constant"] = "auto"
    fill_value: float | None = None
    max_missing_ratio: float = Field(0.5, ge=0, le=1)


class OutlierConfig(Checked):
    method: Literal["auto", "mad", "z_score", "iqr", "percentile", "adaptive"] = "auto"
    threshold: float = Field(3.0, ge=1, le=10)
    lower_percentile: float = Field(0.01, ge=0, le=0.5)
    upper_percentile: float = Field(0.99, ge=0.5, le=1)

    @model_validator(mode="after")
    def _ordered(self):
        if self.upper_percentile <= self.lower_percentile:
            raise ValueError("upper_percentile must exceed lower_percentile")
        return self


class TransformationConfig(Checked):
    method: Literal["auto", "box_cox", "yeo_johnson", "quantile", "log", "none"] = "auto"
    skew_threshold: float = Field(2.0, ge=0)
    kurt_threshold: float = Field(5.0, ge=0)


class StandardizationConfig(Checked):
    method: Literal["auto", "z_score", "rank", "min_max", "robust"] = "auto"
    target_mean: float = 0.0
    target_std: float = Field(1.0, gt=0)


class NeutralizationConfig(Checked):
    method: Literal["ols", "wls", "ridge"] = "ols"
    alpha: float = Field(1.0, ge=0)
    neutralize_industry: bool = True
    neutralize_market_cap: bool = True


class GarchConfig(Checked):
    enabled: bool = False
    p: int = Field(1, ge=0, le=5)
    q: int = Field(1, ge=0, le=5)
    vol: Literal["Garch", "EGarch", "GJR-Garch"] = "Garch"
    min_obs: int = Field(50, ge=20)

    @model_validator(mode="after")
    def _some_order(self):
        if self.p == 0 and self.q == 0:
            raise ValueError("p and q can't both be 0")
        return self


class StaticPipelineConfig(Checked):
    name: str = "static_pipeline"
    imputation: ImputationConfig = Field(default_factory=ImputationConfig)
    outlier: OutlierConfig = Field(default_factory=OutlierConfig)
    transformation: TransformationConfig = Field(default_factory=TransformationConfig)
    neutralization: NeutralizationConfig = Field(default_factory=NeutralizationConfig)
    standardization: StandardizationConfig = Field(default_factory=StandardizationConfig)
    garch: GarchConfig = Field(default_factory=GarchConfig)
    neutralize_before_standardize: bool = True


class DynamicPipelineConfig(Checked):
    name: str = "dynamic_pipeline"
    imputation: ImputationConfig = Field(default_factory=ImputationConfig)
    neutralization: NeutralizationConfig = Field(default_factory=NeutralizationConfig)
    standardization: StandardizationConfig = Field(default_factory=StandardizationConfig)
    decorrelation_strength: float = Field(1.0, ge=0, le=1)
    max_ar_order: int = Field(5, ge=1, le=20)
    ar_criterion: Literal["aic", "bic", "hqic"] = "aic"
    enable_transformation: bool = False
    enable_garch: bool = False


class MixedPipelineConfig(Checked):
    name: str = "mixed_pipeline"
    imputation: ImputationConfig = Field(default_factory=ImputationConfig)
    outlier: OutlierConfig = Field(default_factory=OutlierConfig)
    transformation: TransformationConfig = Field(default_factory=TransformationConfig)
    neutralization: NeutralizationConfig = Field(default_factory=NeutralizationConfig)
    standardization: StandardizationConfig = Field(default_factory=StandardizationConfig)
    conditional_transform: bool = True
    mild_winsorization: bool = True


class PipelineV2ConfigUnified(Checked):
    name: str = "factor_pipeline_v2"
    version: str = "2.0.0"
    description: str = ""
    strict_order: bool = True
    track_intermediate: bool = True
    parallel: bool = False
    max_workers: int = Field(4, ge=1, le=16)
    fingerprint_window: int = Field(24, ge=12)
    classification_threshold_static: float = Field(0.80, ge=0.5, le=1)
    classification_threshold_dynamic: float = Field(0.40, ge=0, le=0.5)
    enable_monitoring: bool = True
    migration_window: int = Field(12, ge=6)
    migration_threshold: float = Field(0.10, ge=0, le=1)
    static: StaticPipelineConfig = Field(default_factory=StaticPipelineConfig)
    dynamic: DynamicPipelineConfig = Field(default_factory=DynamicPipelineConfig)
    mixed: MixedPipelineConfig = Field(default_factory=MixedPipelineConfig)

    def to_ordered(self) -> ordered.PipelineConfig:
        """The static branch's five steps as an ordered pipeline's configuration."""
        s = self.static
        parts = (
            (StepType.IMPUTATION, {"strategy": s.imputation.strategy, "fill_value": s.imputation.fill_value}),
            (StepType.OUTLIER_DETECTION, {"method": s.outlier.method, "threshold": s.outlier.threshold}),
            (StepType.TRANSFORMATION, {"method": s.transformation.method}),
            (StepType.STANDARDIZATION, {"method": s.standardization.method}),
            (StepType.NEUTRALIZATION, {"method": s.neutralization.method, "alpha": s.neutralization.alpha}),
        )
        return ordered.PipelineConfig(self.name, self.version, [ordered.StepConfig(t, params=p) for t, p in parts], self.strict_order)


def save_json(config: PipelineV2ConfigUnified, path: str) -> None:
    Path(path).write_text(json.dumps(config.model_dump(), indent=2, ensure_ascii=False), encoding="utf-8")


def load_json(path: str) -> PipelineV2ConfigUnified:
    return PipelineV2ConfigUnified.model_validate_json(Path(path).read_text(encoding="utf-8"))


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML configurations need PyYAML") from e
    return yaml


def save_yaml(config: PipelineV2ConfigUnified, path: str) -> None:
    Path(path).write_text(_yaml().safe_dump(config.model_dump(), allow_unicode=True, sort_keys=False), encoding="utf-8")


def load_yaml(path: str) -> PipelineV2ConfigUnified:
    return PipelineV2ConfigUnified.model_validate(_yaml().safe_load(Path(path).read_text(encoding="utf-8")))
