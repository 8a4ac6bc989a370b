"""Every core query against DuckDB on the smallest tables."""

import pytest

from lagweave.plans import catalogue_pool, catalogue_prep, catalogue_profiles, catalogue_rules, problems

CASES = [(n, m) for m in (problems, catalogue_prep, catalogue_rules, catalogue_profiles, catalogue_pool) for n in m.ORACLE]


@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_query_equals_sql(against_sql, name, module):
    against_sql(module.QUERIES[name], module.ORACLE[name])


def test_registry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["feed", "period_start"]
