"""Run specification: the YAML sections as frozen dataclasses. Values learned from data are never written back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml

from chronoloom.models.additive import AdditiveParams


@dataclass(frozen=True)
class ExtractSpec:
    name: str = ""
    ts_column: str = "date"
    prediction_column: str = "y"
    categoric_numeric_columns: tuple[str, ...] = ()
    type_extraction: str = "local_parquet"
    excel_split: bool = False
    clean_columns_rows: bool = False
    variable_issues: tuple[tuple[str, str], ...] = ()
    path: str | None = None


@dataclass(frozen=True)
class PrepareSpec:
    deal_na: str = ""
    substitute_na_value: object = None
    date_type: str = ""
    year_pivot: int = 30
    difference: str = ""
    keys: tuple[str, ...] = ()
    aggr_time: bool = True
    aggr_time_level: str = "daily"
    mean_columns: tuple[str, ...] = ()
    sum_columns: tuple[str, ...] = ()
    unique_columns: tuple[str, ...] = ()
    columns_to_shift: tuple[str, ...] = ()
    columns_to_divide_by_time: tuple[str, ...] = ()
    number_to_divide_by_time: float = 1.0
    type_normalization: str = ""
    normalize: bool = False
    normalize_if_not_diff: bool = False
    normalize_independent_var: bool = False
    cut_extremes: bool = False
    fit_on: str = "all"

    @property
    def max_difference(self) -> int:
        return {"one": 1, "second": 2}.get(self.difference or "", 0)


@dataclass(frozen=True)
class LagSpec:
    steps: int = 1
    compute_lags: bool = False
    metric: str = "AIC"
    max_lags: int = 10
    vars_to_lag: tuple[str, ...] = ()


@dataclass(frozen=True)
class FeatureSpec:
    add_date: bool = False
    add_holidays: bool = False
    country: str = "US"
    years_list: tuple[int, ...] = ()
    mean_vars: tuple[tuple[str, int, int], ...] = ()
    median_vars: tuple[tuple[str, int, int], ...] = ()
    mean_weighted_vars: tuple[tuple[str, int, int], ...] = ()


@dataclass(frozen=True)
class ReportSpec:
    vars_to_plot_scatter: tuple[tuple[str, str], ...] = ()
    vars_to_add_heatmap: tuple[str, ...] = ()
    feature_eng_vars: bool = False


@dataclass(frozen=True)
class TunedModel:
    """Fixed parameters, or a grid that is searched once when `optimize` is on."""

    params: Mapping = field(default_factory=dict)
    grid: Mapping = field(default_factory=dict)
    optimize: bool = False


@dataclass(frozen=True)
class ModelSpec:
    horizon: int = 20
    use_feature_eng_on_ts_models: bool = False
    use_lags_on_ts_models: bool = False
    use_original_for_baseline: bool = True
    max_p: int = 4
    max_q: int = 4
    seasonal_periods: tuple[float, ...] = (7, 30)
    additive: TunedModel = TunedModel()
    additive_exo: TunedModel = TunedModel()
    additive_initial_days: int = 0
    additive_horizon_days: int = 0
    additive_exo_initial_days: int = 0
    additive_exo_horizon_days: int = 0
    xgb: TunedModel = TunedModel({"n_estimators": 50, "max_depth": 5, "learning_rate": 0.1, "colsample_bytree": 0.8})
    rf: TunedModel = TunedModel({"n_estimators": 50, "max_depth": 10, "max_features": "sqrt", "min_samples_split": 2})
    svr: TunedModel = TunedModel({"C": 1.0, "epsilon": 0.1, "kernel": "rbf"})
    elastic: TunedModel = TunedModel({"alpha": 1.0, "l1_ratio": 0.5})
    knn: TunedModel = TunedModel({"n_neighbors": 5, "weights": "uniform", "p": 2})
    tree_refit: str = "each"
    arima_method: str = "likelihood"
    tune_on: str = "newest"
    skip: tuple[str, ...] = ()


@dataclass(frozen=True)
class SelectSpec:
    min_steps: int = 6
    ignore_models: tuple[str, ...] = ()
    exclude_bagging_models: bool = False


@dataclass(frozen=True)
class RunSpec:
    mode: str = "ts_only"
    extract: ExtractSpec = ExtractSpec()
    prepare: PrepareSpec = PrepareSpec()
    lags: LagSpec = LagSpec()
    features: FeatureSpec = FeatureSpec()
    report: ReportSpec = ReportSpec()
    model: ModelSpec = ModelSpec()
    select: SelectSpec = SelectSpec()


def _tuple(value) -> tuple:
    if value is None or value == "":
        return ()
    if isinstance(value, (list, tuple)):
        return tuple(tuple(v) if isinstance(v, list) else v for v in value)
    return (value,)


def _spans(value) -> tuple:
    return tuple((str(v), int(a), int(b)) for v, a, b in _tuple(value))


def _plain(cls, section: Mapping, **overrides):
    """Fields of `cls` found in the section by name; empty entries keep the default."""
    known = {}
    for name, spec in cls.__dataclass_fields__.items():
        if name in overrides or name not in section or section[name] is None:
            continue
        value = section[name]
        known[name] = _tuple(value) if isinstance(spec.default, tuple) else value
    return cls(**known, **overrides)


def _tuned(section: Mapping | None, prefix: str, default: TunedModel = TunedModel()) -> TunedModel:
    if not section:
        return default
    return TunedModel(
        params={**default.params, **(section.get(f"{prefix}_params") or {})},
        grid=section.get(f"{prefix}_param_grid") or section.get(f"{prefix}_grid") or {},
        optimize=bool(section.get("optimize_params")),
    )


def _with_cap(tuned: TunedModel, cap) -> TunedModel:
    return tuned if cap is None else TunedModel({**tuned.params, "cap": float(cap)}, tuned.grid, tuned.optimize)


def _own_days(section: Mapping, other: Mapping, what: str) -> int:
    """Days of the model with exogenous columns: its own entry, under either name, else the plain model's."""
    for value in (section.get(f"prophet_ex_{what}"), section.get(f"prophet_{what}"), other.get(f"prophet_{what}")):
        if value is not None:
            return int(value)
    return 0


def spec_from_dict(raw: Mapping) -> RunSpec:
    """Accepts the nested configuration layout with its original section and entry names."""
    pre = raw.get("preprocessing") or {}
    model = raw.get("model") or {}
    keys = dict.fromkeys([*_tuple(pre.get("aggr_attr")), *_tuple(pre.get("aggr_lvl"))])
    add = model.get("prophet") or {}
    defaults = ModelSpec()
    additive = _tuned(add, "prophet")
    add_ex = model.get("prophet_ex") or {}
    exo = _with_cap(_tuned(add_ex, "prophet_ex"), add_ex.get("cap", add.get("cap")))
    additive = _with_cap(additive, add.get("cap"))
    return RunSpec(
        mode=raw.get("type_analysis") or "ts_only",
        extract=_plain(ExtractSpec, {"path": (raw.get("data_extraction") or {}).get("s3_route"), **(raw.get("data_extraction") or {})}),
        prepare=_plain(
            PrepareSpec, pre, keys=tuple(keys), unique_columns=_tuple(pre.get("unique_columns") or pre.get("unique")),
            number_to_divide_by_time=float(pre.get("number_to_divide_by_time") or 1),
        ),
        lags=_plain(LagSpec, raw.get("ts_into_tab") or {}),
        features=_plain(
            FeatureSpec,
            raw.get("feature_eng") or {},
            mean_vars=_spans((raw.get("feature_eng") or {}).get("mean_vars")),
            median_vars=_spans((raw.get("feature_eng") or {}).get("median_vars")),
            mean_weighted_vars=_spans((raw.get("feature_eng") or {}).get("mean_weighted_vars")),
        ),
        report=_plain(ReportSpec, raw.get("EDA") or {}),
        model=ModelSpec(
            horizon=int(model.get("percentage_predicted") or defaults.horizon),
            use_feature_eng_on_ts_models=bool(model.get("use_feature_eng_on_ts_models")),
            use_lags_on_ts_models=bool(model.get("use_lags_on_ts_models")),
            use_original_for_baseline=bool(model.get("use_original_for_baseline", True)),
            max_p=int((model.get("arima") or {}).get("max_p", defaults.max_p)),
            max_q=int((model.get("arima") or {}).get("max_q", defaults.max_q)),
            arima_method=str((model.get("arima") or {}).get("method", defaults.arima_method)),
            seasonal_periods=_tuple((model.get("tbats") or {}).get("max_sp")) or defaults.seasonal_periods,
            additive=additive,
            additive_exo=exo,
            additive_initial_days=int(add.get("prophet_initial") or 0),
            additive_horizon_days=int(add.get("prophet_horizon") or 0),
            additive_exo_initial_days=_own_days(add_ex, add, "initial"),
            additive_exo_horizon_days=_own_days(add_ex, add, "horizon"),
            xgb=_tuned(model.get("xgb"), "xgb", defaults.xgb),
            rf=_tuned(model.get("rf"), "rf", defaults.rf),
            svr=_tuned(model.get("svr"), "svr", defaults.svr),
            elastic=_tuned(model.get("elastic"), "elastic", defaults.elastic),
            knn=_tuned(model.get("knn"), "knn", defaults.knn),
            tree_refit=str(model.get("tree_refit") or defaults.tree_refit),
            tune_on=str(model.get("tune_on") or defaults.tune_on),
            skip=_tuple(model.get("skip")),
        ),
        select=_plain(SelectSpec, raw.get("model_selector") or {}),
    )


def load_spec(path: str) -> RunSpec:
    with open(path, encoding="utf-8") as f:
        return spec_from_dict(yaml.safe_load(f))


def additive_params(tuned: TunedModel) -> AdditiveParams:
    known = {k: v for k, v in tuned.params.items() if k in AdditiveParams.__dataclass_fields__}
    return AdditiveParams(**known)
