"""The match spec: nine sections of plain options, checked on construction."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass

from ..errors import ConfigError, UnsupportedCapability
from ..operators.balance import METRICS
from ..operators.distance import Window
from ..operators.propensity import PropensitySpec

# Options that are known, and those that are ready to use.
KNOWN = {
    "matching_direction": ("treated_to_control", "control_to_treated", "bidirectional_full"),
    "ps_method": ("logistic", "random_forest", "lightgbm"),
    "matching_space": ("covariates_only", "ps_only", "logit_ps_only", "hybrid_covariates_and_ps"),
    "trimming_strategy": ("none", "symmetric_quantile", "crump_optimal", "kde_density"),
    "distance_metric": ("euclidean", "mahalanobis", "gower", "weighted_hybrid", "ps_logit"),
    "matching_algorithm": ("greedy_nn", "optimal_hungarian", "optimal_transport_sinkhorn", "full_matching"),
    "caliper_scale": ("absolute", "standard_deviation"),
    "ties_handling": ("first", "random_seeded"),
}
PLANNED = {
    "bidirectional_full", "random_forest", "lightgbm", "crump_optimal", "kde_density", "ps_logit", "full_matching",
    "random_seeded",
}


def _known(**options):
    for name, value in options.items():
        if value not in KNOWN[name]:
            raise ConfigError(f"{name} must be one of {', '.join(KNOWN[name])}; got {value!r}")


@dataclass(frozen=True)
class Population:
    treatment_col: str
    id_col: str
    matching_direction: str = "treated_to_control"

    def __post_init__(self):
        _known(matching_direction=self.matching_direction)


@dataclass(frozen=True)
class Covariates:
    matching_covariates: tuple = ()
    evaluation_covariates: tuple = ()
    outcome_covariates: tuple = ()
    covariate_missing_threshold: float = 0.20

    def __post_init__(self):
        for name in ("matching_covariates", "evaluation_covariates", "outcome_covariates"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if not self.matching_covariates:
            raise ConfigError("at least one matching covariate is needed")
        if not 0 <= self.covariate_missing_threshold <= 1:
            raise ConfigError("covariate_missing_threshold lies between 0 and 1")


@dataclass(frozen=True)
class Trimming:
    apply_trimming: bool = False
    trimming_strategy: str = "none"
    trim_quantile: float = 0.02

    def __post_init__(self):
        _known(trimming_strategy=self.trimming_strategy)
        if not 0 <= self.trim_quantile < 0.5:
            raise ConfigError("trim_quantile lies in [0, 0.5)")


@dataclass(frozen=True)
class Representation:
    use_propensity_score: bool = False
    ps_method: str = "logistic"
    ps_config: PropensitySpec | None = None
    matching_space: str = "covariates_only"

    def __post_init__(self):
        _known(ps_method=self.ps_method, matching_space=self.matching_space)
        if self.ps_config is not None and not self.use_propensity_score:
            raise ConfigError("ps_config is set although no propensity score is used")
        if self.matching_space != "covariates_only" and not self.use_propensity_score:
            raise ConfigError(f"matching space '{self.matching_space}' needs the propensity score")
        if self.use_propensity_score and self.ps_config is None:
            object.__setattr__(self, "ps_config", PropensitySpec())


@dataclass(frozen=True)
class CaliperWindow:
    covariate: str
    caliper_value: float
    scale: str = "absolute"

    def __post_init__(self):
        self.window()

    def window(self) -> Window:
        return Window(self.covariate, self.caliper_value, self.scale)


@dataclass(frozen=True)
class Constraints:
    exact_match_covariates: tuple = ()
    stratified_matching: bool = False
    caliper_windows: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "exact_match_covariates", tuple(self.exact_match_covariates))
        windows = tuple(_section(CaliperWindow, w) for w in self.caliper_windows)
        object.__setattr__(self, "caliper_windows", windows)


@dataclass(frozen=True)
class Distance:
    distance_metric: str = "euclidean"
    weight_numerical: float = 0.6
    weight_categorical: float = 0.4

    def __post_init__(self):
        _known(distance_metric=self.distance_metric)


@dataclass(frozen=True)
class Strategy:
    matching_algorithm: str = "greedy_nn"
    matching_ratio_k: int = 1
    allow_replacement: bool = False
    caliper_value: float | None = None
    caliper_scale: str = "absolute"
    ties_handling: str = "first"
    optimal_transport_target_size: int | None = None
    apply_candidate_prefilter: bool = False
    prefilter_k_neighbors: int = 7
    prefilter_min_candidates: int | None = None

    def __post_init__(self):
        _known(
            matching_algorithm=self.matching_algorithm, caliper_scale=self.caliper_scale, ties_handling=self.ties_handling
        )
        if self.matching_ratio_k < 1 or self.prefilter_k_neighbors < 1:
            raise ConfigError("k must be at least 1")
        if self.matching_algorithm == "optimal_hungarian" and self.allow_replacement:
            raise ConfigError("optimal assignment is one-to-one: replacement is not possible")
        transport = self.matching_algorithm == "optimal_transport_sinkhorn"
        if transport != (self.optimal_transport_target_size is not None):
            raise ConfigError("optimal_transport_target_size goes with optimal_transport_sinkhorn, and only with it")
        if transport and self.optimal_transport_target_size < 1:
            raise ConfigError("optimal_transport_target_size must be positive")


@dataclass(frozen=True)
class Diagnostics:
    run_overlap_diagnostics: bool = True
    run_pair_diagnostics: bool = True
    run_balance_diagnostics: bool = True
    balance_metrics: tuple = ("smd",)

    def __post_init__(self):
        object.__setattr__(self, "balance_metrics", tuple(self.balance_metrics))


@dataclass(frozen=True)
class CausalEstimation:
    estimand: str | None = None


@dataclass(frozen=True)
class MatchSpec:
    population: Population
    covariates: Covariates
    preprocessing: Trimming = field(default_factory=Trimming)
    representation: Representation = field(default_factory=Representation)
    constraints: Constraints = field(default_factory=Constraints)
    distance: Distance = field(default_factory=Distance)
    strategy: Strategy = field(default_factory=Strategy)
    diagnostics: Diagnostics = field(default_factory=Diagnostics)
    causal_estimation: CausalEstimation | None = None

    @staticmethod
    def from_dict(raw: Mapping) -> "MatchSpec":
        sections = {
            "population": Population, "covariates": Covariates, "preprocessing": Trimming, "representation": Representation,
            "constraints": Constraints, "distance": Distance, "strategy": Strategy, "diagnostics": Diagnostics,
            "causal_estimation": CausalEstimation,
        }
        unknown = sorted(set(raw) - set(sections))
        if unknown:
            raise ConfigError(f"unknown section(s) {unknown}")
        built = {name: _section(cls, raw[name]) for name, cls in sections.items() if raw.get(name) is not None}
        try:
            return MatchSpec(**built)
        except TypeError as exc:
            raise ConfigError(f"incomplete match spec: {exc}") from exc


def _section(cls, raw):
    if not isinstance(raw, Mapping):
        return raw
    names = {f.name for f in fields(cls)}
    unknown = sorted(set(raw) - names)
    if unknown:
        raise ConfigError(f"unknown option(s) {unknown} for {cls.__name__.lower()}")
    values = dict(raw)
    if cls is Representation and isinstance(values.get("ps_config"), Mapping):
        values["ps_config"] = _section(PropensitySpec, values["ps_config"])
    try:
        return cls(**values)
    except TypeError as exc:
        raise ConfigError(f"{cls.__name__.lower()}: {exc}") from exc


def spec_to_dict(value):
    if is_dataclass(value):
        return {f.name: spec_to_dict(getattr(value, f.name)) for f in fields(value)}
    return [spec_to_dict(v) for v in value] if isinstance(value, tuple) else value


def capability(field_name: str, value: str) -> str:
    """``supported`` or ``planned``; whatever is not known counts as planned."""
    known = METRICS if field_name == "balance_metric" else KNOWN.get(field_name, ())
    return "supported" if value in known and value not in PLANNED else "planned"


def check_capabilities(spec: MatchSpec) -> None:
    chosen = [
        ("matching_direction", spec.population.matching_direction),
        ("ps_method", spec.representation.ps_method),
        ("matching_space", spec.representation.matching_space),
        ("trimming_strategy", spec.preprocessing.trimming_strategy),
        ("distance_metric", spec.distance.distance_metric),
        ("matching_algorithm", spec.strategy.matching_algorithm),
        ("ties_handling", spec.strategy.ties_handling),
        *[("balance_metric", m) for m in spec.diagnostics.balance_metrics],
    ]
    for name, value in chosen:
        if capability(name, value) != "supported":
            raise UnsupportedCapability(name, value)
    if spec.strategy.caliper_value is not None and spec.strategy.caliper_scale != "absolute":
        raise UnsupportedCapability("caliper_scale", spec.strategy.caliper_scale)
    if spec.causal_estimation is not None and spec.causal_estimation.estimand is not None:
        raise UnsupportedCapability("causal_estimation.estimand", spec.causal_estimation.estimand)
