"""Distinct pairs of families are told apart in the tasks that make their rows, also where a family lies in two blocks."""

from __future__ import annotations

from pathlib import Path

import pytest

from duotrace.config import FIXTURE
from duotrace.operators import pairing
from duotrace.plans import registry, search

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
NAMES = ["named_events", "pair_dedup_dominance"]


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_not_sent(spark, name):
    """Rows are counted by pair of families, and these counts put together, before any exchange."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "CollectMetrics bounded" in line)
    above = [step for line in reversed(plan[:at]) for step in ("Exchange", "HashAggregate") if f" {step}" in line and "Broadcast" not in line]
    assert above[:2] == ["HashAggregate", "HashAggregate"]


@pytest.mark.parametrize("name", NAMES)
def test_families_in_two_blocks(spark, monkeypatch, name):
    whole = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(pairing, "BLOCK", 18)
    monkeypatch.setattr(pairing, "BLOCKS", 40)
    win = search._win(spark, SF)
    assert pairing.split_families(win, search.fx.segments(win), FIXTURE).count() > 100
    assert sorted(map(str, registry.QUERIES[name](spark, SF).collect())) == whole
