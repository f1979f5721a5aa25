"""Orders, configurations, errors, pipelines, routing, reports and helpers."""

import itertools
import json

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from panelwright.plans import config, perf, report, schema_config
from panelwright.plans.errors import AdapterImportError, ConfigurationError, MigrationAlertError, NeutralizationError, OrderValidationError, PipelineError, StepExecutionError
from panelwright.plans.order import StepType, check_order, is_subsequence, suggest_order
from panelwright.plans.pipeline import OrderedPipeline
from panelwright.plans.router import FactorRouter, RouterConfig, dynamic_pipeline, mixed_pipeline, static_pipeline
from panelwright.plans.steps import Impute, Neutralize, PipelineStep, PipelineStepProtocol, Standardize, Tame, make_step
from panelwright.sources import panels, synthetic
from panelwright.sources.panels import supplier_month

I, O, T, S, N = StepType


@pytest.mark.parametrize("steps", [[I, O, T, S, N], [I], [O], [T], [S], [N], [I, O], [I, S], [I, O, S, N], [I, O, N], [I, S, N]])
def test_valid_orders(steps):
    assert check_order(steps) == []


@pytest.mark.parametrize("steps", [[], [O, I], [T, I], [I, S, O], [I, T, O], [N, I], [I, N, S], [S, N, I]])
def test_invalid_orders(steps):
    assert check_order(steps)


def test_orders_in_general():
    for k in range(1, 6):
        for p in itertools.permutations(StepType, k):
            assert check_order(suggest_order(p)) == []
    assert suggest_order([N, S, O, I]) == [I, O, S, N]
    assert check_order([I, N, S], strict=False) == []
    assert check_order([I, O], exclusions=[(I, O)])
    assert is_subsequence([I, S], [I, O, S]) and not is_subsequence([S, I], [I, O, S])


def test_config_round_trips(tmp_path):
    c = config.PipelineConfig.default_config()
    assert [s.step_type for s in c.steps] == list(StepType)
    assert config.PipelineConfig.from_dict(c.to_dict()) == c
    c.to_json(str(tmp_path / "c.json"))
    assert config.PipelineConfig.from_json(str(tmp_path / "c.json")) == c
    with pytest.raises(ValueError, match="imputation"):
        config.StepConfig.from_dict({"step_type": "nothing"})


@pytest.mark.parametrize(
    ("cls", "bad"),
    [
        ("OutlierConfig", {"threshold": 0.5}), ("OutlierConfig", {"lower_percentile": 0.5, "upper_percentile": 0.5}), ("ImputationConfig", {"max_missing_ratio": 1.5}),
        ("ImputationConfig", {"strategy": "odd"}), ("TransformationConfig", {"skew_threshold": -1}), ("StandardizationConfig", {"target_std": 0}), ("NeutralizationConfig", {"alpha": -1}),
        ("GarchConfig", {"p": 0, "q": 0}), ("GarchConfig", {"min_obs": 10}), ("GarchConfig", {"p": 6}), ("DynamicPipelineConfig", {"max_ar_order": 0}), ("DynamicPipelineConfig", {"decorrelation_strength": 2}),
        ("PipelineV2ConfigUnified", {"max_workers": 0}), ("PipelineV2ConfigUnified", {"fingerprint_window": 11}), ("PipelineV2ConfigUnified", {"classification_threshold_static": 0.4}), ("PipelineV2ConfigUnified", {"migration_window": 5}),
    ],
)
def test_bounds(cls, bad):
    with pytest.raises(ValidationError):
        getattr(schema_config, cls)(**bad)


def test_checked_config_files(tmp_path):
    c = schema_config.PipelineV2ConfigUnified(name="x")
    with pytest.raises(ValidationError):
        c.classification_threshold_static = 2
    schema_config.save_json(c, str(tmp_path / "c.json"))
    schema_config.save_yaml(c, str(tmp_path / "c.yaml"))
    assert schema_config.load_json(str(tmp_path / "c.json")) == c == schema_config.load_yaml(str(tmp_path / "c.yaml"))
    o = c.to_ordered()
    assert [s.step_type for s in o.steps] == list(StepType) and OrderedPipeline(config=o)


def test_errors():
    e = StepExecutionError("bad", "s", "f", {"a": 1}, original_error=KeyError("k"))
    assert e.to_dict()["original_error"].startswith("KeyError") and str(e) == "[StepExecutionError] bad | Step: s | Factor: f | Context: {'a': 1}"
    m = MigrationAlertError("moved", factor_name="f", old_type="STATIC", new_type="MIXED", confidence=0.5)
    assert m.to_dict()["new_type"] == "MIXED" and isinstance(m, PipelineError)
    assert "original_error" not in StepExecutionError("x").to_dict()
    assert issubclass(OrderValidationError, ValueError)


def test_steps():
    with pytest.raises(TypeError):
        PipelineStep("abstract")
    assert isinstance(Impute(), PipelineStepProtocol)
    assert isinstance(make_step(I), Impute) and make_step(O, method="mad").get_stats()["method"] == "mad"
    with pytest.raises(AdapterImportError):
        make_step(I, "Unheard")
    with pytest.raises(ConfigurationError):
        Tame("t", "odd")


class Broken(PipelineStep):
    step_type = T

    def fit(self, panel, **kwargs):
        self.fitted = True
        return self

    def transform(self, panel, **kwargs):
        raise KeyError("broken")


class Late(Broken):
    """Fails when it runs, not when it is planned."""

    def transform(self, panel, **kwargs):
        return panel.withColumn("value", F.raise_error(F.lit("late")).cast("double"))


def test_ordered_pipeline(spark, sf):
    x = supplier_month(spark, sf)
    with pytest.raises(OrderValidationError) as e:
        OrderedPipeline([Tame("o"), Impute()])
    assert e.value.context["suggested_order"] == ["imputation", "outlier"]
    p = OrderedPipeline.default_pipeline()
    with pytest.raises(StepExecutionError):
        p.transform(x)
    assert "not run" in p.summary()
    r = p.fit(x).execute(x)
    assert r.success and [s.step_name for s in r.steps] == [t.value for t in StepType]
    assert r.steps[0].input_missing_rate > 0 == r.steps[0].output_missing_rate and r.steps[0].input_shape == (83, 10)
    assert "error" not in json.dumps(r.to_dict(), default=str) and "imputation" in p.summary()
    assert r.data.exceptAll(p.transform(x)).isEmpty()


@pytest.mark.parametrize("step", [Broken, Late])
def test_failures(spark, sf, step):
    x = supplier_month(spark, sf)
    lenient = OrderedPipeline([Impute(), step("t"), Standardize("s")], strict_order=False)
    for s in lenient.steps:
        s.fit(x)
    r = lenient.execute(x)
    assert not r.success and [s.success for s in r.steps] == [True, False, True] and r.data.count() == 830
    strict = OrderedPipeline([Impute(), Tame("o"), step("t"), Standardize("s")])
    for s in strict.steps:
        s.fit(x)
    assert [s.success for s in strict.execute(x).steps] == [True, True, False]
    with pytest.raises(StepExecutionError):
        strict.execute(x, raise_on_error=True)


def test_neutralizer_sources(spark, sf):
    x = supplier_month(spark, sf)
    bare, industry = x.drop("industry", "known"), x.select("asset", "industry").distinct()
    n = Neutralize().fit(bare)
    assert n.transform(bare) is bare and n.skipped
    assert n.transform(bare, external_neutralizer=lambda p, method: p.limit(0)).isEmpty()
    want = n.transform(x).select("asset", "date", F.round("value", 9).alias("v"))
    for got in (n.transform(bare, industry=industry), Neutralize(industry=industry).fit(bare).transform(bare)):
        assert got.select("asset", "date", F.round("value", 9).alias("v")).exceptAll(want).isEmpty()


@pytest.fixture(scope="module")
def three(spark):
    x = panels.combine(*(synthetic.autoregressive(spark, k, 60, 20) for k in ("static", "dynamic", "mixed")))
    return panels.attach_industry(x, x.select("asset", F.concat(F.lit("I"), F.substring("asset", -1, 1).cast("int") % 3).alias("industry")).distinct()).cache()


def test_routing(spark, three):
    r = FactorRouter()
    assert "not been fitted" in r.summary()
    out = r.fit_transform(three)
    assert out.count() == three.count() and out.where("value IS NULL").isEmpty()
    assert {x.factor_name: x.primary_type for x in r.classification_summary().collect()}["dynamic"] == "DYNAMIC"
    assert r.check_migrations(three) == {} and "dynamic" in r.summary()
    assert {x.stability for x in r.stability().collect()} == {1.0} and r.transition_weights().count() == 3
    swapped = three.withColumn("factor", F.when(F.col("factor") == "static", "dynamic").when(F.col("factor") == "dynamic", "static").otherwise(F.col("factor")))
    assert set(r.check_migrations(swapped)) == {"static", "dynamic"}
    more = three.unionByName(three.where("factor = 'mixed'").withColumn("factor", F.lit("new")))
    assert r.transform(more).where("factor = 'new'").isEmpty()
    r.config.strict_mode = True
    with pytest.raises(ConfigurationError):
        r.transform(more)
    with pytest.raises(ValueError):
        FactorRouter().fit(three.limit(0))


def test_two_mixed_factors_share_assets(spark, three):
    x = three.where("factor = 'mixed'")
    both = x.unionByName(x.withColumn("factor", F.lit("again")).withColumn("value", F.col("value") * 3 + 1))
    out = mixed_pipeline().fit_transform(both)
    a, b = (out.where(F.col("factor") == f).select("date", "asset", F.round("value", 6)) for f in ("mixed", "again"))
    assert out.count() == 2 * x.count() and a.exceptAll(b).isEmpty()


def test_single_pipelines(three):
    means = static_pipeline().fit_transform(three).groupBy("factor", "asset").agg(F.avg("value").alias("m"))
    assert means.where("abs(m) > 1e-9").isEmpty()
    full, half = (dynamic_pipeline(RouterConfig(decorrelation_strength=s)).fit_transform(three) for s in (1.0, 0.5))
    assert full.exceptAll(half).count() > 0


def test_reports(spark):
    r = report.ExecutionReport("p")
    r.add_step(step_name="a", step_type="imputation", execution_time_ms=100.0, input_shape=(10, 5), output_shape=(10, 5), input_missing_rate=0.1, output_missing_rate=0.0)
    assert r.finish().success and "| a | imputation | 100.00 |" in r.to_markdown() and "-0.1000" in r.to_markdown()
    r.add_step(step_name="b", error="went wrong")
    r.classification_results = {"f": "STATIC"}
    assert not r.success and "1/2" in r.to_markdown() and "FAIL went wrong" in r.to_text() and json.loads(r.to_json())["step_count"] == 2
    p = report.Profiler()
    for name, ms in (("one", 100), ("two", 50), ("three", 100)):
        p.record(name, ms)
    s = p.summary(spark)
    assert (s["total_ms"], s["slowest"], s["fastest"], s["success"]) == (250.0, "one", "two", True)
    assert [b["step"] for b in p.bottlenecks(spark, 20.0)] == ["one", "two", "three"]
    with pytest.raises(KeyError), p.measure("bad"):
        raise KeyError
    assert not p.summary(spark)["success"]


def test_cache_and_helpers(spark, caplog):
    c = perf.SimpleCache(2)
    c.set("a", 1)
    c.set("b", 2)
    c.get("a")
    c.set("b", 3)  # no eviction on overwriting
    assert len(c) == 2
    c.set("c", 4)
    assert c.get("b") is None and c.get("a") == 1
    calls = []

    @perf.cached(perf.SimpleCache())
    def twice(x):
        calls.append(x)
        return 2 * x

    assert twice(2) == twice(2) == 4 and calls == [2]

    @perf.timed("t")
    def fails():
        raise RuntimeError

    with caplog.at_level("INFO"), pytest.raises(RuntimeError):
        fails()
    assert "t: " in caplog.text
    df = spark.range(10).selectExpr("id", "id % 2 AS k")
    assert sorted(r.id for r in perf.batch_process(df, lambda x: x.assign(id=x.id * 2)).collect()) == list(range(0, 20, 2))
    assert sorted(r.n for r in perf.batch_process(df, lambda x: x.groupby("k", as_index=False).agg(n=("id", "size")), "k long, n long", ["k"]).collect()) == [5, 5]
    b = perf.benchmark(lambda: df, 2, 1)
    assert b["n_runs"] == 2 and b["min_ms"] <= b["median_ms"] <= b["max_ms"]


def test_neutralization_needs_industry():
    assert issubclass(NeutralizationError, PipelineError)


def test_public_names():
    import panelwright

    assert panelwright.check_v2_availability()
    assert all(getattr(panelwright, n) is not None for n in panelwright.__all__)
    with pytest.raises(AttributeError):
        panelwright.nothing


def test_reference_configuration_round_trips(tmp_path):
    from panelwright.plans import schema_config as c

    given = {"name": "mine", "version": "2.0.0", "classification_threshold_static": 0.9, "classification_threshold_dynamic": 0.3, "static": {"name": "s", "transformation": {"skew_threshold": 9.0, "kurt_threshold": 7.0}}}
    made = c.PipelineV2ConfigUnified.model_validate(given)
    assert (made.classification_threshold_static, made.static.transformation.skew_threshold, made.static.name, made.mixed.name) == (0.9, 9.0, "s", "mixed_pipeline")
    c.save_json(made, str(tmp_path / "c.json"))
    assert c.load_json(str(tmp_path / "c.json")) == made
    with pytest.raises(ValueError):
        c.PipelineV2ConfigUnified.model_validate({"threshold_static": 0.9})


def test_router_takes_industry_by_keyword(spark, sf):
    """A bare panel with the industry as an argument gives what the attached panel gives, and a cached panel stays cached."""
    from panelwright.plans.router import FactorRouter, RouterConfig
    from panelwright.sources.panels import supplier_industry, supplier_month

    panel = supplier_month(spark, sf).persist()
    bare, industry = panel.drop("industry", "known").persist(), supplier_industry(spark, sf)
    want = {(r.factor, r.date, r.asset): r.value for r in FactorRouter(RouterConfig(max_ar_order=2)).fit_transform(panel).collect()}
    router = FactorRouter(RouterConfig(max_ar_order=2))
    for got in (router.fit_transform(bare, industry=industry), router.transform(bare)):
        rows = {(r.factor, r.date, r.asset): r.value for r in got.collect()}
        assert rows.keys() == want.keys() and all(abs((rows[k] or 0) - (want[k] or 0)) < 1e-9 for k in want)
    assert bare.storageLevel.useMemory
    panel.unpersist()
    bare.unpersist()


def test_history_of_odd_names(spark, sf):
    from panelwright.operators import impute, monitor
    from panelwright.sources.panels import supplier_month

    panel = impute.impute(supplier_month(spark, sf))
    told = lambda rows: sorted((r.as_of, r.primary_type, *(round(x, 6) for x in (r.confidence, r.ar1_median, r.rank_autocorr))) for r in rows)
    odd = monitor.history_by_year(panel.withColumn("factor", F.lit("a@2019@b"))).collect()
    assert {r.factor for r in odd} == {"a@2019@b"} and told(odd) == told(monitor.history_by_year(panel).collect())
