"""Result tables on disk: one directory per table under a name that states what was run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def result_name(dataset: str, variable: str, horizon: int, scaler: str | None = None) -> str:
    """`{dataset}_analysis_[{scaler}_]{variable}_{horizon}`; the scaler is named only when the target was scaled."""
    parts = [dataset, "analysis"] + ([scaler] if scaler else []) + [variable, str(horizon)]
    return "_".join(parts)


def write_results(tables: Mapping[str, DataFrame], root: str, name: str, fmt: str = "parquet") -> list[str]:
    """Writes `metrics_df`, `fast_summary`, `raw_data` (or whatever is given) to `{root}/{name}/{table}`."""
    paths = []
    for table, df in tables.items():
        path = f"{root.rstrip('/')}/{name}/{table}"
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        paths.append(path)
    return paths
