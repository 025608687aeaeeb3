"""An extension beyond the batch engine: cells kept up to date from a stream of loan-months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.operators.cells import CellSpec, keyed


def running_cells(months: DataFrame, spec: CellSpec) -> DataFrame:
    """The collapse of a stream, for update or complete mode: state is one count per cell, however many loan-months come."""
    return keyed(months, spec).groupBy(*spec.key).agg(F.count("*").alias("loan_months"))


def merge_batches(path: str, key: list[str]):
    """A foreachBatch sink: each batch's cells are appended under its number, so a repeated batch replaces itself; read_merged() adds up."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(F.sum("loan_months").alias("loan_months")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def read_merged(spark, path: str, key: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*key).agg(F.sum("loan_months").alias("loan_months"))
