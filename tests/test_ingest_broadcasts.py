"""Ingest and backfill join by measured sizes: no table is broadcast because its compressed files are small."""

import pytest

from __spark_entry__ import SMOKE_DIR
from alertloom.operators import identity, ingest, mentions, resolve
from alertloom.plans import places
from alertloom.plans.catalog import QUERIES
from alertloom.session import MEASURED

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")


@pytest.mark.parametrize("name", ["i6_backfill", "ing3_stats"])
def test_all_that_is_written_is_planned_by_measured_sizes(spark, monkeypatch, name):
    seen = {}

    def noted(df, label, *more):
        """Nothing is run: the settings count with which the table would be written."""
        seen[label] = {k: spark.conf.get(k, None) for k in MEASURED}
        return spark.createDataFrame([], df.schema)

    for module in (identity, ingest, mentions, resolve, places):
        monkeypatch.setattr(module, "write_and_read", noted)
    monkeypatch.setattr(places, "_COMPILED", {})
    before = {k: spark.conf.get(k, None) for k in MEASURED}
    answer = QUERIES[name](spark, SMOKE_DIR)
    assert {"index-words", "ingest", "hits", "mentioned", "ingest-actions"} <= set(seen)
    assert not [label for label, conf in seen.items() if conf != MEASURED]
    assert {k: spark.conf.get(k, None) for k in MEASURED} == before
    # What the caller plans has nothing left to guess.
    assert not any(j in answer._jdf.queryExecution().executedPlan().toString() for j in JOINS)
