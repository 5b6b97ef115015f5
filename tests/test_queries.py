"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from lexora import plans
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, name):
    got = spark_rows(plans.queries()[name](spark, sf_dir))
    assert got == duck_rows(plans.oracle_sql()[name], sf_dir)


def test_all_have_sql():
    assert plans.queries().keys() == plans.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["run", "segmented", "score2"]
    assert plans.queries().keys() <= e.queries().keys()
