"""Whole runs from one specification: prepare, backtest, combine, select, score, write."""

from chronoloom.plans.report import report_tables
from chronoloom.plans.run import RunResult, prepare_series, run
from chronoloom.plans.spec import RunSpec, load_spec, spec_from_dict

__all__ = ["RunResult", "RunSpec", "load_spec", "prepare_series", "report_tables", "run", "spec_from_dict"]
