"""Sinks: tables, one folder per target, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.text import safe_filename


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def sort_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in a total order, for a file that is the same after every run: by ``keys``, missing values last, then by
    all other columns that can be ordered."""
    others = [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    return df.orderBy(*[F.asc_nulls_last(f"`{c}`") for c in [*keys, *others]])


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Each table under its name; returns the paths."""
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def write_per_target(hits: DataFrame, path: str, key: str = "protein_key", fmt: str = "parquet") -> str:
    """One folder per target, named by its key with ``::`` made safe.

    Rows are clustered by target first, so each folder gets few files. Hits
    are at most K rows per target.
    """
    safe = hits.withColumn(f"{key}_safe", safe_filename(F.col(key)))
    writer = safe.repartition(f"{key}_safe").write.mode("overwrite").partitionBy(f"{key}_safe").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def append_outputs(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(spark: SparkSession, report: Mapping[str, Any], path: str) -> str:
    """A run's summary as JSON and as flat ``key: value`` lines."""
    flat = []
    for key, value in report.items():
        if isinstance(value, Mapping):
            flat.append(f"{key}:")
            flat += [f"  {k}: {v}" for k, v in value.items()]
        else:
            flat.append(f"{key}: {value}")
    import json

    text = json.dumps(report, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")
    spark.createDataFrame([("\n".join(flat),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/txt")
    return path


def report_dict(row: DataFrame) -> dict[str, Any]:
    """A one-row report frame as a dictionary."""
    return row.first().asDict(recursive=True)
