"""Profiles by look-up against joins, and what lies on disk after a written step."""

import os
import time

import pytest

from linkweave.operators import features as FE
from linkweave.operators import lookup
from linkweave.plans.queries import Plan
from linkweave.sources.paths import written


@pytest.mark.parametrize("size", [40_000, 7])
def test_look_up_equals_joins(spark, rows, size, monkeypatch):
    """With ids that are null, unknown or there twice; in one slice and in many."""
    monkeypatch.setattr(lookup, "ROWS", size)
    monkeypatch.setattr(lookup, "TILE", size)
    s = spark.createDataFrame([(f"S1-{i % 29}", f"n{i}", [f"a{i}", "b"]) for i in range(30)], "entity_id string, n string, l array<string>")
    t = spark.createDataFrame([(f"S2-{i}", f"m{i}" if i else None, []) for i in range(40)], "entity_id string, n string, l array<string>")
    pairs = spark.createDataFrame([(f"S1-{i % 31}" if i % 50 else None, f"S2-{i % 41}", i) for i in range(400)], "s1_id string, tid string, x int")
    want = FE.with_profiles_of(pairs, s, t, ["n", "l"])
    got = lookup.with_profiles_of(pairs, s, t, ["n", "l"])
    assert rows(got.select(*want.columns)) == rows(want) and rows(got)


def test_features_move_no_profiles(spark):
    """Stored candidates get their profiles without an exchange."""
    p = Plan(spark, "/root/testdata/sf0.001")
    plan = FE.vectors(p.wide, FE.ranker_features())._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_shuffle_files_go_with_their_step(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in root for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    some = written(spark.range(1000).repartition(3, "id"), "some")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert len(some.collect()) == 1000
