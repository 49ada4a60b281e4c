"""Plan-shape guards over every registered query."""

import pytest

from shelfwise.registry import REGISTRY, present
from shelfwise.sources.catalog import Catalog

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name in sorted(REGISTRY):
        df = present(REGISTRY[name](Catalog.from_tpch(spark, SF_SMALL)))
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert not {n: f for n, f in bad.items() if f}


def test_scans_are_pruned(plans):
    # no plan uses l_tax / l_linestatus, so column pruning must keep them out of every lineitem scan
    seen = 0
    for name, p in plans.items():
        for line in p.splitlines():
            if "lineitem" in line and "ReadSchema" in line:
                seen += 1
                assert "l_tax" not in line and "l_linestatus" not in line, (name, line)
    assert seen > 50
