import pytest

from tests.oracle import assert_same
from weldrow import catalog

WITH_SQL = sorted(catalog.ORACLES)
WITHOUT = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", WITHOUT)
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_blocking_never_plans_a_nested_loop(spark, sf_dir):
    plan = catalog.block_union(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_imports_without_a_session():
    """The query names can be read before any session exists."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120, check=False)
    assert said.returncode == 0, said.stderr
