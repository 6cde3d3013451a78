"""Scenario files: JSON cases with mock input tables and an expected row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.schemas import TABLES

SCENARIO = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("scenario_type", T.StringType()),
        T.StructField(
            "mock_inputs",
            T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in TABLES.items()]),
        ),
        T.StructField(
            "expected_output",
            T.StructType(
                [
                    T.StructField("expected_row_count", T.LongType()),
                    T.StructField("description", T.StringType()),
                ]
            ),
        ),
    ]
)


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario."""
    return spark.read.schema(SCENARIO).json(path, multiLine=True)


def scenario_tables(scenarios: DataFrame, title: str) -> dict[str, DataFrame]:
    """The mock tables of one scenario, empty where the scenario gives no rows."""
    chosen = scenarios.filter(F.col("title") == title)
    return {name: chosen.select(F.inline(f"mock_inputs.{name}")) for name in TABLES}
