import os

import pytest
from pyspark.errors import AnalysisException

from crewgate.schema import COMPANIES
from crewgate.sources import tables
from fixtures import company_row


def one(spark, i, name):
    return spark.createDataFrame([company_row(i, name)], COMPANIES)


def ids(df):
    return sorted(r["company_id"] for r in df.collect())


def test_append_adds_rows(spark, scratch):
    with pytest.raises(AnalysisException):
        tables.read_table(spark, scratch, "companies")
    for i in range(3):
        tables.append_rows(one(spark, i, f"C{i}"), scratch, "companies", sort_within=["company_id"])
    got = tables.read_table(spark, scratch, "companies")
    assert ids(got) == [0, 1, 2] and got.schema.names == COMPANIES.names


def test_versions_are_written_once(spark, scratch):
    tables.write_snapshot(one(spark, 1, "A"), scratch, "companies", 0)
    tables.write_snapshot(one(spark, 2, "B"), scratch, "companies", 1)
    with pytest.raises(AnalysisException):
        tables.write_snapshot(one(spark, 3, "C"), scratch, "companies", 1)
    assert ids(tables.read_table(spark, scratch, "companies", 0)) == [1]
    assert ids(tables.read_table(spark, scratch, "companies", 1)) == [2]


def test_a_failed_write_leaves_the_table(spark, scratch):
    from pyspark.sql import functions as F

    tables.append_rows(one(spark, 1, "A"), scratch, "companies")
    bad = one(spark, 2, "B").withColumn("note", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        tables.append_rows(bad, scratch, "companies")
    assert ids(tables.read_table(spark, scratch, "companies")) == [1]
    assert os.path.isdir(os.path.join(scratch, "companies"))
