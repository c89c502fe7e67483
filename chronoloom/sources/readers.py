"""Table readers. Paths may be local or any Hadoop URI; the format is always explicit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Configuration names of the six source kinds, as (format, remote).
SOURCE_KINDS = {
    "local_csv": ("csv", False),
    "local_parquet": ("parquet", False),
    "local_excel": ("split", False),
    "s3_csv": ("csv", True),
    "s3_parquet": ("parquet", True),
    "s3_excel": ("split", True),
}
EXTENSIONS = {"csv": ".csv", "parquet": ".parquet", "split": ".txt"}


@dataclass(frozen=True)
class SourceSpec:
    kind: str
    path: str
    split: bool = False
    options: dict = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Header on; every cell is text until `coerce_numeric` decides, so no schema-inference scan is paid."""
    return spark.read.options(header=True, **options).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_column(lines: DataFrame, column: str, header: list[str], separator: str = ",") -> DataFrame:
    """One text column of joined cells -> one column per header name; copies of the header line are dropped."""
    cells = F.split(F.col(column), f"\\Q{separator}\\E", -1)
    body = lines.filter(F.col(column) != separator.join(header))
    return body.select(*[F.get(cells, i).alias(name) for i, name in enumerate(header)])


def read_split_text(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Single-column file whose first line is the joined header. Only that one line reaches the driver."""
    lines = spark.read.text(path)
    header = lines.first()[0].split(separator)
    return split_column(lines, "value", header, separator)


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind {spec.kind!r}")
    fmt, _ = SOURCE_KINDS[spec.kind]
    if fmt == "split":
        if spec.split:
            return read_split_text(spark, spec.path)
        return read_csv(spark, spec.path, **spec.options)
    if fmt == "csv":
        return read_csv(spark, spec.path, **spec.options)
    return read_parquet(spark, spec.path)
