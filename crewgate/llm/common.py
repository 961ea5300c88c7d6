"""Shared helpers of the operators: tables, scratch data, Arrow batches.

Intermediate tables are Parquet folders under the folder the cluster names in
``spark.checkpoint.dir`` (``crewgate.session.scratch_path``).  ``stored``
writes one and reads it back, so that what follows never recomputes it and an
executor lost later costs nothing; ``drop_stored`` deletes one that nothing
reads any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.session import scratch_path

# Bytes of text handled at once inside a Python worker: bounds its memory
# whatever the Arrow batch holds (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a new scratch folder; the frame read back, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that Spark shuffles and sorts, whatever size it takes it for.

    Spark sizes a stored table by its compressed files and an explode by its input, so it
    would send (and build in the driver's memory) narrow tables of millions of rows.
    """
    return df.hint("merge")


def crc32_of_id(column: str = "doc_id"):
    """crc32 of a doc id written as text (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Zero-copy slices of an Arrow batch holding about ``limit`` bytes of ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False).astype(np.int64)
    start, room = 0, limit
    for i, n in enumerate(sizes.tolist()):
        if i > start and n > room:
            yield batch.slice(start, i - start)
            start, room = i, limit
        room -= n
    yield batch.slice(start)
