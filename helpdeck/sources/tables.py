"""A1/A2 table reads.

Parquet carries its schema, so reads never infer; column pruning and filter
pushdown reach the scan because everything downstream is declarative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    """A1 ``queryAll``: one table as a DataFrame."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_row(df: DataFrame, *order) -> DataFrame:
    """A2 ``queryOne``: the first row by the given order (0 or 1 rows).

    ``orderBy().limit(1)`` plans as TakeOrderedAndProject: each task keeps
    one candidate, so nothing but one row per task is shuffled.
    """
    return df.orderBy(*order).limit(1)


def load_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """A12 ``seed`` guard: the target plus the seed rows only when the target is empty.

    One lazy plan: the seed rows are kept only under ``NOT EXISTS (target)``
    (an uncorrelated subquery, evaluated once).
    """
    return target.unionByName(seed.where(~target.exists()))
