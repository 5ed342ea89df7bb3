"""The match run: from a prepared table to a result with tables, metrics and the matched rows."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TableConfig, config_to_dict
from ..errors import MatchError
from ..functions.tools import materialise, named
from ..operators import assign, cohort as prep, greedy, matched
from ..operators.balance import balance_table, max_abs_smd
from ..operators.clean import preprocess
from ..operators.distance import PairRule, prefilter_pool
from ..operators.encode import encode, expand_covariates, fit_encoding
from ..operators.impute import fit_impute, impute
from ..operators.propensity import fit_score
from ..operators.scale import fit_scaling, scale
from .spec import MatchSpec, check_capabilities, spec_to_dict


@dataclass
class RunResult:
    """What a run leaves behind. DataFrames stay lazy until saved or read."""

    module: str = "matching"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    metrics: dict[str, float] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    datasets: dict[str, DataFrame] = field(default_factory=dict)
    artifacts: dict[str, DataFrame] = field(default_factory=dict)
    logs: list[str] = field(default_factory=list)
    runtime: dict[str, float] = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    success: bool = True
    error: str | None = None

    def fail(self, message: str) -> None:
        self.success, self.error = False, message
        self.logs.append(f"failed: {message}")


@dataclass
class Prepared:
    table: DataFrame
    fitted: dict[str, object]
    runtime: dict[str, float]
    imputation_applied: bool


def prepare(df: DataFrame, config: TableConfig, id_col: str | None = None, apply_imputation: bool = True) -> Prepared:
    """Clean, impute, encode and scale, keeping what was fitted."""
    fitted, runtime = {}, {}

    def timed(name, action):
        start = time.monotonic()
        out = action()
        runtime[name] = time.monotonic() - start
        return out

    table = timed("preprocessing", lambda: preprocess(df, config))
    wanted = apply_imputation and bool(config.imputed_columns())
    if wanted:

        def fill():
            fitted["imputation"] = fit_impute(table, config, id_col)
            return impute(table, config, fitted["imputation"], id_col)

        table = timed("imputation", fill)
    if config.encoded_columns():

        def code():
            fitted["encoding"] = fit_encoding(table, config)
            return encode(table, config, fitted["encoding"])

        table = timed("encoding", code)
    if config.scaled_columns():

        def rescale():
            fitted["scaling"] = fit_scaling(table, config)
            return scale(table, config, fitted["scaling"])

        table = timed("scaling", rescale)
    return Prepared(table, fitted, runtime, wanted)


def run_matching(
    df: DataFrame, spec: MatchSpec, config: TableConfig | None = None, apply_imputation: bool = True
) -> RunResult:
    """Run a spec on a table. With a column config the table is prepared first.

    Options that are not available raise; anything that goes wrong later is a failed result.
    """
    check_capabilities(spec)
    result = RunResult(config={"match_spec": spec_to_dict(spec)})
    start = time.monotonic()
    try:
        covariates = list(spec.covariates.matching_covariates)
        evaluation = list(spec.covariates.evaluation_covariates)
        categorical = set()
        if config is not None:
            result.config["table_config"] = config_to_dict(config)
            ready = prepare(df, config, spec.population.id_col, apply_imputation)
            df = ready.table
            result.runtime.update(ready.runtime)
            result.config["imputation_applied"] = ready.imputation_applied
            if "encoding" in ready.fitted:
                covariates = expand_covariates(config, ready.fitted["encoding"], covariates)
                evaluation = expand_covariates(config, ready.fitted["encoding"], evaluation)
                result.artifacts["encoding"] = ready.fitted["encoding"].table(df)
            for name in ("imputation", "scaling"):
                if name in ready.fitted:
                    result.artifacts[name] = ready.fitted[name].table(df.sparkSession)
            categorical = set(config.categorical_columns())
        _match(df, spec, covariates, evaluation, categorical, result)
        result.logs.append("matching finished")
    except Exception as exc:
        result.fail(str(exc))
    result.runtime["total"] = time.monotonic() - start
    return result


def _widened(slim: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """The rows with all columns of ``df``, in its order, before the ones that were added."""
    rest = [c for c in df.columns if c not in slim.columns]
    if not rest:
        return slim
    wide = slim.join(df.select(named(id_col), *map(named, rest)), id_col)
    return wide.select(*map(named, [*df.columns, *[c for c in slim.columns if c not in df.columns]]))


def _match(df, spec: MatchSpec, covariates, evaluation, categorical, result: RunResult) -> None:
    treat, id_col = spec.population.treatment_col, spec.population.id_col
    direction = spec.population.matching_direction
    prep.check_treatment(df, treat)
    report = materialise(prep.covariate_availability(df, treat, covariates, spec.covariates.covariate_missing_threshold))
    result.tables["covariate_availability_report"] = report
    usable = prep.usable_covariates(report)
    usable = [c for c in covariates if c in usable]

    # Only what the stages read goes through them; the other columns join the matched rows at the end.
    read = {id_col, treat, *spec.constraints.exact_match_covariates, *covariates, *evaluation, *(w.covariate for w in spec.constraints.caliper_windows)}
    table = prep.with_stratum(df.select(*[named(c) for c in df.columns if c in read]), list(spec.constraints.exact_match_covariates))
    table = materialise(prep.resolve_direction(table, treat, direction))
    work = table
    if spec.representation.use_propensity_score:
        work, model = fit_score(table, treat, usable, spec.representation.ps_config)
        work = materialise(work)
        result.artifacts["propensity_score_model"] = model.state
        if spec.diagnostics.run_overlap_diagnostics:
            support = materialise(prep.overlap(work, treat))
            result.tables["overlap"] = support
        if spec.preprocessing.apply_trimming and spec.preprocessing.trimming_strategy == "symmetric_quantile":
            work, record = prep.trim(work, treat, q=spec.preprocessing.trim_quantile)
            work = materialise(work)
            result.tables["trimming"] = record
    features = prep.matching_space(spec.representation.matching_space, usable)
    rule = PairRule(
        tuple(features),
        spec.distance.distance_metric,
        frozenset(categorical),
        tuple(w.window() for w in spec.constraints.caliper_windows),
        spec.strategy.caliper_value,
        spec.distance.weight_numerical,
        spec.distance.weight_categorical,
    )
    candidates = work
    if spec.strategy.apply_candidate_prefilter:
        # The matching caliper does not narrow the prefilter.
        open_rule = PairRule(rule.features, rule.metric, rule.categorical, rule.windows, None, rule.weight_num, rule.weight_cat)
        least = spec.strategy.prefilter_min_candidates or spec.strategy.optimal_transport_target_size
        kept = prefilter_pool(work, id_col, open_rule, spec.strategy.prefilter_k_neighbors, least)
        kept = kept.select(F.col("pool_id").alias(id_col)).distinct()
        candidates = materialise(
            work.where("role = 'query'").unionByName(work.where("role = 'pool'").join(kept, id_col, "left_semi"))
        )

    algorithm = spec.strategy.matching_algorithm
    if algorithm == "optimal_transport_sinkhorn":
        selection = materialise(assign.transport_selection(candidates, id_col, rule, spec.strategy.optimal_transport_target_size))
        result.datasets["matched_dataset"] = materialise(_widened(matched.selected_dataset(work, selection, id_col), df, id_col))
        result.metrics["n_pool_units_selected"] = float(selection.count())
        pairs = work.select(F.lit(None).cast("long").alias("query_id"), named(id_col).alias("pool_id"), F.lit(0.0).alias("dist")).limit(0)
        if not result.metrics["n_pool_units_selected"]:
            raise MatchError("nothing was matched in any stratum")
    else:
        if algorithm == "greedy_nn":
            pairs = greedy.greedy_pairs(
                candidates, id_col, rule, spec.strategy.matching_ratio_k, spec.strategy.allow_replacement
            )
        else:
            pairs = assign.optimal_pairs(candidates, id_col, rule)
        pairs = materialise(pairs)
        if not pairs.limit(1).count():
            raise MatchError("nothing was matched in any stratum")
        result.datasets["pairs"] = pairs
        slim = matched.matched_dataset(work, pairs, id_col, direction, algorithm == "greedy_nn")
        result.datasets["matched_dataset"] = materialise(_widened(slim, df, id_col))
        if algorithm == "optimal_hungarian":
            result.metrics["optimality_gap_bound"] = pairs.agg(F.sum("step")).first()[0]

    people = matched.population_diagnostics(table, pairs).first().asDict()
    for name in ("match_rate", "n_query_matched", "n_query_unmatched"):
        result.metrics[name] = float(people[name])
    if spec.diagnostics.run_pair_diagnostics:
        for name, value in matched.pair_diagnostics(pairs).first().asDict().items():
            result.metrics[f"pair_{name}"] = float(value)
    if spec.diagnostics.run_balance_diagnostics:
        after = result.datasets["matched_dataset"]
        balance = balance_table(table, after, treat, usable, evaluation, spec.diagnostics.balance_metrics)
        result.tables["balance_table"] = materialise(balance)
        result.metrics["max_abs_smd_after"] = max_abs_smd(result.tables["balance_table"]).first()[0]
