import pytest

from tests.conftest import SF, rows
from textloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_agrees_with_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracles()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert (registry.queries()[name](spark, SF).count() > 0) == (name != "event_changepoints")  # these events have no change; changepoints() is tested on steps


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_is_needed(spark):
    plan = registry.queries()["event_set_diff"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan
