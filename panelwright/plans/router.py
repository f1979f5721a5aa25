"""Routing: fingerprint the factors, classify them, and send each through the pipeline of its type."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.classify import classify, fuse
from ..operators.fingerprint import fingerprint
from ..operators.monitor import migrations, stability, transition_weights
from ..sources.panels import attach_industry
from .errors import ConfigurationError, PipelineError
from .steps import Decouple, Garch, GatedReshape, Impute, Neutralize, Reshape, SigmaClip, Standardize, Tame

TYPES = ("STATIC", "DYNAMIC", "MIXED")


@dataclass
class RouterConfig:
    strict_mode: bool = False
    min_window: int = 24
    enable_monitoring: bool = True
    migration_threshold: float = 0.10
    outlier_method: str = "auto"
    transform_method: str = "auto"
    skew_threshold: float = 2.0
    kurt_threshold: float = 5.0
    enable_garch: bool = False
    garch_min_obs: int = 50
    garch_vol: str = "Garch"
    garch_p: int = 1
    garch_q: int = 1
    decorrelation_strength: float = 1.0
    max_ar_order: int = 5
    ar_criterion: str = "aic"


class Chain:
    """Steps in a fixed order, fitted on running data."""

    def __init__(self, steps: list):
        self.steps = steps

    def fit(self, panel: DataFrame, **kwargs: Any) -> Chain:
        for s in self.steps:
            panel = s.fit(panel, **kwargs).transform(panel, **kwargs)
        return self

    def transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        for s in self.steps:
            panel = s.transform(panel, **kwargs)
        return panel

    def fit_transform(self, panel: DataFrame, **kwargs: Any) -> DataFrame:
        return self.fit(panel, **kwargs).transform(panel, **kwargs)


class MixedChain(Chain):
    """Bounds and the gate come from the imputed panel before it is clipped."""

    def fit(self, panel: DataFrame, **kwargs: Any) -> MixedChain:
        imputed = self.steps[0].fit(panel, **kwargs).transform(panel, **kwargs)
        for s in self.steps[1:]:
            s.fit(imputed, **kwargs)
        return self


def static_pipeline(c: RouterConfig | None = None) -> Chain:
    c = c or RouterConfig()
    garch = [Garch("garch", vol=c.garch_vol, p=c.garch_p, q=c.garch_q, min_obs=c.garch_min_obs)] if c.enable_garch else []
    return Chain([Impute(), Tame("outlier", c.outlier_method), Reshape("transformation", c.transform_method), *garch, Neutralize(), Standardize("standardization")])


def dynamic_pipeline(c: RouterConfig | None = None) -> Chain:
    c = c or RouterConfig()
    return Chain([Impute(), Decouple("decouple", max_order=c.max_ar_order, criterion=c.ar_criterion, strength=c.decorrelation_strength), Standardize("standardization", "z_score")])


def mixed_pipeline(c: RouterConfig | None = None) -> Chain:
    c = c or RouterConfig()
    gate = GatedReshape("transformation", method="yeo_johnson", skew=c.skew_threshold, kurtosis=c.kurt_threshold)
    return MixedChain([Impute(), SigmaClip("outlier"), gate, Neutralize(), Standardize("standardization", "z_score")])


class FactorRouter:
    """fit fingerprints and classifies all factors in one plan and keeps a row per factor; transform routes by a join on it."""

    def __init__(self, config: RouterConfig | None = None):
        self.config = config or RouterConfig()
        self.classes: DataFrame | None = None
        self.prints: DataFrame | None = None
        self.history: DataFrame | None = None
        self.chains: dict[str, Chain] = {}
        self.industry: DataFrame | None = None

    def fit(self, panel: DataFrame, descriptions: DataFrame | None = None, months: DataFrame | None = None, as_of=None, industry: DataFrame | None = None, **kwargs: Any) -> FactorRouter:
        """``industry`` (asset, industry) is attached to the panel here and, unless it brings its own, in transform."""
        self.industry = industry
        panel = self._attached(panel)
        if panel.isEmpty():
            raise ConfigurationError("there are no factors")
        spark, c = panel.sparkSession, self.config
        own = panel.storageLevel == StorageLevel(False, False, False, False, 1)
        kept = panel.persist() if own else panel  # fingerprints read it four times; what the caller keeps stays kept
        try:
            # a row per factor: the driver holds as many rows as there are factors, and plans built on them don't repeat the fingerprinting
            found = fingerprint(kept, c.min_window)
            self.prints = spark.createDataFrame(found.collect(), found.schema)
        except Exception as e:
            raise PipelineError(f"fingerprinting failed: {e}") from e
        finally:
            if own:
                kept.unpersist()
        classes = classify(self.prints)
        if descriptions is not None:
            classes = fuse(classes, self.prints, descriptions, months)
        self.classes = spark.createDataFrame(classes.collect(), classes.schema)
        self.chains = {"STATIC": static_pipeline(c), "DYNAMIC": dynamic_pipeline(c), "MIXED": mixed_pipeline(c)}
        for kind, chain in self.chains.items():
            chain.fit(self._of(panel, kind), **kwargs)
        if c.enable_monitoring:
            now = self.classes.join(self.prints.select("factor", "ar1_median"), "factor").select("factor", F.lit(as_of).cast("date").alias("as_of"), "primary_type", "ar1_median")
            self.history = now if self.history is None else self.history.unionByName(now)
        return self

    def _of(self, panel: DataFrame, kind: str) -> DataFrame:
        wanted = F.col("primary_type") == kind if kind != "MIXED" else ~F.col("primary_type").isin("STATIC", "DYNAMIC")
        return panel.join(self.classes.where(wanted).select("factor"), "factor", "left_semi")

    def _attached(self, panel: DataFrame, industry: DataFrame | None = None) -> DataFrame:
        table = industry if industry is not None else None if "industry" in panel.columns else self.industry
        return panel if table is None else attach_industry(panel.drop("industry", "known"), table)

    def transform(self, panel: DataFrame, industry: DataFrame | None = None, **kwargs: Any) -> DataFrame:
        """All factors, each through its type's pipeline; unclassified ones are left out, or an error in strict mode."""
        if self.classes is None:
            raise PipelineError("fit comes before transform")
        panel = self._attached(panel, industry)
        if self.config.strict_mode:
            unknown = [r.factor for r in panel.select("factor").distinct().join(self.classes, "factor", "left_anti").collect()]
            if unknown:
                raise ConfigurationError("unclassified factors", context={"factors": unknown})
        present = {r.primary_type if r.primary_type in TYPES else "MIXED" for r in self.classes.collect()}
        out = None
        for kind in TYPES:
            if kind in present:
                part = self.chains[kind].transform(self._of(panel, kind), **kwargs)
                out = part if out is None else out.unionByName(part)
        return out

    def fit_transform(self, panel: DataFrame, descriptions: DataFrame | None = None, months: DataFrame | None = None, as_of=None, industry: DataFrame | None = None, **kwargs: Any) -> DataFrame:
        return self.fit(panel, descriptions, months, as_of, industry, **kwargs).transform(panel, industry, **kwargs)

    def classification_summary(self) -> DataFrame:
        return self.classes.select(F.col("factor").alias("factor_name"), "primary_type", *[c for c in ("primary_prob", "confidence") if c in self.classes.columns])

    def fingerprint_summary(self) -> DataFrame:
        return self.prints.select(F.col("factor").alias("factor_name"), "ar1_median", "rank_autocorr", "half_life", "sd_score", "complexity_need")

    def check_migrations(self, panel: DataFrame) -> dict[str, dict]:
        """Alerts of new data against the history, which is not changed; only factors that have one."""
        if self.history is None:
            return {}
        prints = fingerprint(panel, self.config.min_window)
        now = classify(prints).join(prints.select("factor", "ar1_median"), "factor")
        return {r.factor: r.asDict() for r in migrations(self.history, now, self.config.migration_threshold).collect()}

    def stability(self) -> DataFrame:
        return stability(self.history)

    def transition_weights(self) -> DataFrame:
        return transition_weights(self.prints)

    def summary(self) -> str:
        if self.classes is None:
            return "The router has not been fitted yet."
        rows = [f"  {r.factor_name}: {r.primary_type} (confidence {r.confidence})" for r in self.classification_summary().collect()]
        prints = [f"  {r.factor_name}: ar1 {r.ar1_median}, rank {r.rank_autocorr}" for r in self.fingerprint_summary().collect()]
        return "\n".join(["Classification", *rows, "Fingerprints", *prints])
