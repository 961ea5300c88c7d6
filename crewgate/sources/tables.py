"""Entity tables as plain Parquet folders.

A table is ``<root>/<name>``, a folder that Spark writes and reads.  K1 is
Spark's own append to it.  K4, a table as of a state, is a folder
``<root>/<name>/version=<N>`` whose number the caller gives; it is written
once, and an existing one is never replaced.  Nothing else keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.schema import TABLES


def table_path(root: str, name: str, version: int | None = None) -> str:
    path = f"{root.rstrip('/')}/{name}"
    return path if version is None else f"{path}/version={int(version)}"


def read_table(spark: SparkSession, root: str, name: str,
               version: int | None = None) -> DataFrame:
    """Scan a table, or one version of it, with its declared schema."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(table_path(root, name, version))


def _sorted(df: DataFrame, sort_within: list[str] | None) -> DataFrame:
    return df.sortWithinPartitions(*sort_within) if sort_within else df


def append_rows(df: DataFrame, root: str, name: str,
                sort_within: list[str] | None = None) -> None:
    """K1: add the rows of ``df`` to the table, cast to its declared types."""
    if name in TABLES:
        df = df.select([F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
    _sorted(df, sort_within).write.mode("append").parquet(table_path(root, name))


def write_snapshot(df: DataFrame, root: str, name: str, version: int,
                   sort_within: list[str] | None = None) -> None:
    """K4: write ``df`` as version ``version``; an error if it exists.

    ``sort_within`` orders rows inside each file (e.g. company_id,
    expiry_date) so that Parquet min/max statistics skip row groups.
    """
    _sorted(df, sort_within).write.mode("error").parquet(table_path(root, name, version))
