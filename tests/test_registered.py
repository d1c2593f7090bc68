"""Every registered query runs, and equals its SQL check where it has one."""

import pytest

import __spark_entry__ as entry_point
from tests.conftest import SMALL
from tests.oracle import compare

QUERIES, CHECKS = entry_point.queries(), entry_point.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark):
    assert compare(name, QUERIES[name], CHECKS.get(name), spark, SMALL) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_lines_of_code_are_those_of_the_sql(spark, tmp_path):
    """The look-up that makes lines gives what the one SQL text of both engines gives, odd ids included."""
    from registry import tables as t

    assert not any("!" in x for x in t.TEMPLATES)
    ids = spark.range(-300, 20_000).unionByName(spark.createDataFrame([(None,), (7,), (7,)], "id BIGINT")).withColumnRenamed("id", "event_id")
    ids.write.parquet(str(tmp_path / "events.parquet"))
    ids.createOrReplaceTempView("fernsift_test_events")
    want = spark.sql(t.code_lines_sql("fernsift_test_events"))
    got = t.code_lines(spark, str(tmp_path))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
