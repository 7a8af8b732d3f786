"""Every query of the reference's operators against its SQL, and the driver's entry."""

import pytest

from tracewright.plans import registry
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, same, spark):
    if name in registry.ORACLES:
        same(registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_inputs(spark):
    from tracewright.plans import views

    assert registry.QUERIES["ag20_drop_totals"](spark, SF).first().before == views.trace(spark, SF).count()
    assert registry.QUERIES["rw1_compact"](spark, SF).where("n_compacted > 0").count() > 0
    assert {r.detector for r in registry.QUERIES["wn7_annotate"](spark, SF).select("detector").distinct().collect()} >= {"M1", "M4", "E2", "E3"}
