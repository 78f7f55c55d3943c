"""Keyed state: newest entries, untouched files, replays."""

from pathlib import Path

import pytest
from pyspark.sql import types as T

from merchantscope.operators import cases as cs
from merchantscope.sources.state import SLOT, KeyedState

SCHEMA = T.StructType().add("merchant_id", T.LongType()).add("filed_at", T.LongType()).add("note", T.StringType())


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def state(spark, tmp_path):
    return KeyedState(spark, f"{tmp_path}/state", SCHEMA, ("merchant_id",), ("filed_at", "note"), slots=16)


def test_newest_entries_stay_and_other_slots_keep_their_files(spark, state):
    first = [(i, 10, "a") for i in range(200)] + [(None, 10, "none"), (5, 11, "b"), (5, 9, "old"), (6, None, "undated")]
    assert state.rows().count() == 0
    assert len(state.upsert(spark.createDataFrame(first, SCHEMA))) == 16
    want = {i: (10, "a") for i in range(200)} | {None: (10, "none"), 5: (11, "b")}
    assert {r[0]: tuple(r)[1:] for r in state.rows().collect()} == want
    assert state.rows().count() == 201

    before = files(state.path)
    changes = spark.createDataFrame([(5, 12, "c"), (7, 3, "late"), (None, 20, "again")], SCHEMA)
    altered = state.upsert(changes)
    after = files(state.path)
    want |= {5: (12, "c"), None: (20, "again")}
    assert {r[0]: tuple(r)[1:] for r in state.rows().collect()} == want
    kept = {f for f in before if int(f.split(f"{SLOT}=")[1].split("/")[0]) not in altered}
    assert 1 <= len(altered) <= 2 and kept and kept <= after
    assert not (before - kept) & after

    assert state.upsert(changes) == [] and files(state.path) == after  # a replay is no news


def test_a_path_keeps_its_number_of_slots(spark, state):
    state.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    with pytest.raises(ValueError, match="laid out"):
        KeyedState(spark, state.path, SCHEMA, ("merchant_id",), ("filed_at",), slots=8).rows()


def test_patches_replayed_from_a_log_state(spark, tmp_path):
    schema = T._parse_datatype_string("patch_id long, patched_at long, case_id string, status string, assigned_analyst string, notes array<string>")
    log = KeyedState(spark, f"{tmp_path}/patches", schema, ("patch_id",), ("patched_at",), slots=4)
    one = spark.createDataFrame([(1, 5, "A", "triage", None, ["n1"]), (2, 7, "A", None, "kim", ["n2", "n3"]), (3, 1, "B", None, None, None)], schema)
    two = spark.createDataFrame([(4, 6, "A", "escalated", None, None), (2, 7, "A", None, "kim", ["n2", "n3"])], schema)
    for batch in (one, two, one):
        log.upsert(batch)
    cases = spark.createDataFrame([("A", "new", None, ["o"]), ("B", "new", "lee", ["o"]), ("C", "new", None, [])],
                                  "case_id string, status string, assigned_analyst string, notes array<string>")
    merged = {r.case_id: tuple(r)[1:] for r in cs.merge_patches(cases, cs.fold_patches(log.rows())).collect()}
    assert merged == {"A": ("escalated", "kim", ["o", "n1", "n2", "n3"]), "B": ("new", "lee", ["o"]), "C": ("new", None, [])}
