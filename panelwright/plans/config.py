"""Configurations of ordered pipelines, from and to dictionaries and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from .order import StepType


@dataclass
class StepConfig:
    step_type: StepType
    module_path: str = ""
    class_name: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True

    def to_dict(self) -> dict[str, Any]:
        return asdict(self) | {"step_type": self.step_type.value}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> StepConfig:
        known = {k: data[k] for k in ("module_path", "class_name", "params", "enabled") if k in data}
        return cls(StepType.parse(data.get("step_type", "")), **known)


@dataclass
class PipelineConfig:
    name: str = "default_pipeline"
    version: str = "1.0"
    steps: list[StepConfig] = field(default_factory=list)
    strict_order: bool = True
    allow_skip: bool = False
    track_intermediate: bool = True

    def to_dict(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("name", "version", "strict_order", "allow_skip", "track_intermediate")} | {"steps": [s.to_dict() for s in self.steps]}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> PipelineConfig:
        plain = {k: data[k] for k in ("name", "version", "strict_order", "allow_skip", "track_intermediate") if k in data}
        return cls(steps=[StepConfig.from_dict(s) for s in data.get("steps", [])], **plain)

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), indent=2, ensure_ascii=False)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text

    @classmethod
    def from_json(cls, path: str) -> PipelineConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def default_config(cls) -> PipelineConfig:
        """Five steps with automatic methods."""
        chosen = {
            StepType.IMPUTATION: {"strategy": "auto"},
            StepType.OUTLIER_DETECTION: {"method": "auto"},
            StepType.TRANSFORMATION: {"method": "auto"},
            StepType.STANDARDIZATION: {"method": "auto"},
            StepType.NEUTRALIZATION: {"method": "ols"},
        }
        return cls(name="factor_preprocessing", steps=[StepConfig(t, params=p) for t, p in chosen.items()])
