import pytest

from pairwell.config import ColumnSpec, MissingRule, ScalingRule, TableConfig
from pairwell.errors import ConfigError, StoreError, UnsupportedCapability
from pairwell.plans.run import run_matching
from pairwell.plans.spec import MatchSpec
from pairwell.sources.demo import biased_cohort
from pairwell.sources.results import compare_runs, load_result, promote, save_result


def spec(**sections):
    base = {
        "population": {"treatment_col": "treatment", "id_col": "patient_id"},
        "covariates": {"matching_covariates": ["age", "clinical_score"], "evaluation_covariates": ["followup_months"]},
    }
    return MatchSpec.from_dict({**base, **sections})


def smds(result):
    return {r.variable: r for r in result.tables["balance_table"].collect()}


def test_balance_improves_and_result_survives_saving(spark, tmp_path):
    cohort = biased_cohort(spark, 300)
    plain = run_matching(cohort, spec(strategy={"allow_replacement": True}, diagnostics={"balance_metrics": ["smd", "ks_test", "jensen_shannon"]}))
    assert plain.success, plain.error
    row = smds(plain)["age"]
    assert row.abs_smd_after < row.abs_smd_before
    scored = run_matching(
        cohort,
        spec(
            representation={"use_propensity_score": True, "matching_space": "logit_ps_only", "ps_config": {"degree": 1}},
            preprocessing={"apply_trimming": True, "trimming_strategy": "symmetric_quantile"},
            strategy={"allow_replacement": True, "caliper_value": 0.2},
        ),
    )
    assert scored.success, scored.error
    assert {"overlap", "trimming"} <= set(scored.tables)
    for i, r in enumerate((plain, scored)):
        save_result(spark, r, f"{tmp_path}/run{i}")
    back = load_result(spark, f"{tmp_path}/run1")
    assert back.metrics == scored.metrics
    assert back.datasets["matched_dataset"].count() == scored.datasets["matched_dataset"].count()
    table = compare_runs(spark, [f"{tmp_path}/run0", f"{tmp_path}/run1"]).collect()
    assert [r.run_id for r in table] == [scored.run_id, plain.run_id]
    treated = promote(back, "matched_dataset", [("treatment", "eq", 1)])
    assert treated.count() * 2 == back.datasets["matched_dataset"].count()
    with pytest.raises(StoreError):
        promote(back, "matched_dataset", [("age", "gt", 1000)])


def test_preparation_and_provenance(spark):
    rows = [(i, 40 + i % 20, None if i % 5 == 0 else (40 + i % 20) * 0.5 + i % 5, int(40 + i % 20 > 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "patient_id long, age long, clinical_score double, treatment int")
    config = TableConfig(
        {
            "patient_id": ColumnSpec("patient_id", id=True),
            "age": ColumnSpec("age", numerical=True, scaling=ScalingRule(True, "standard")),
            "clinical_score": ColumnSpec("clinical_score", numerical=True, missing_data_management=MissingRule("impute", imputer="mean")),
            "treatment": ColumnSpec("treatment", categorical=True),
        }
    )
    cov = {"matching_covariates": ["age", "clinical_score"]}
    result = run_matching(df, spec(covariates=cov), config)
    assert result.success, result.error
    matched = result.datasets["matched_dataset"]
    assert matched.where("clinical_score IS NULL").count() == 0
    assert result.config["imputation_applied"] and {"imputation", "scaling"} <= set(result.artifacts)
    pairs = matched.groupBy("pair_id").count().collect()
    assert {r["count"] for r in pairs} == {2}


def test_failures(spark):
    with pytest.raises(UnsupportedCapability):
        run_matching(biased_cohort(spark, 20), spec(distance={"distance_metric": "ps_logit"}))
    with pytest.raises(ConfigError):
        spec(representation={"matching_space": "ps_only"})
    with pytest.raises(ConfigError):
        spec(strategy={"matching_algorithm": "optimal_hungarian", "allow_replacement": True})
    result = run_matching(biased_cohort(spark, 20).drop("age"), spec())
    assert not result.success and "age" in result.error


def test_transport_and_optimal_runs(spark):
    cohort = biased_cohort(spark, 120)
    chosen = run_matching(
        cohort,
        spec(strategy={"matching_algorithm": "optimal_transport_sinkhorn", "optimal_transport_target_size": 9, "apply_candidate_prefilter": True, "prefilter_k_neighbors": 3}),
    )
    assert chosen.success, chosen.error
    assert chosen.metrics["n_pool_units_selected"] == 9 and chosen.metrics["match_rate"] == 0
    assert {r["__role__"] for r in chosen.datasets["matched_dataset"].collect()} == {"selected"}
    assert smds(chosen)["age"].smd_after is None and chosen.metrics["max_abs_smd_after"] == 0

    wards = cohort.selectExpr("*", "concat('w', patient_id % 3) AS ward")
    best = run_matching(
        wards,
        spec(
            population={"treatment_col": "treatment", "id_col": "patient_id", "matching_direction": "control_to_treated"},
            covariates={"matching_covariates": ["age", "ward"]},
            distance={"distance_metric": "gower"},
            constraints={"caliper_windows": [{"covariate": "age", "caliper_value": 0.5, "scale": "standard_deviation"}]},
            strategy={"matching_algorithm": "optimal_hungarian"},
        ),
    )
    assert best.success, best.error
    rows = best.datasets["matched_dataset"].collect()
    assert len(rows) == 2 * best.metrics["pair_n_pairs"] and best.metrics["optimality_gap_bound"] == 0
    assert {r["__role__"] for r in rows if r.treatment == 0} == {"control"}
    assert sorted({r.pair_id for r in rows}) == list(range(int(best.metrics["pair_n_pairs"])))
