"""Incremental ingest, combination and the gate behind it."""

import uuid

import pytest

from cohortlens.plans import batch_job as B
from cohortlens.session import scratch_path


def _lines(spark, rows):
    return spark.createDataFrame(rows, "batch_no INT, line_pos BIGINT, value STRING")


def _rec(patient, label):
    return f'{{"patient_id":"{patient}","label":"{label}"}}'


ONE = [(1, 0, _rec("P1", "a")), (1, 1, "{oops"), (1, 2, "[1]"), (1, 3, '{"label":"x"}'), (1, 4, _rec("P1", "b"))]
TWO = [(2, 0, _rec("P2", "c")), (2, 1, _rec("P1", "d")), (2, 2, _rec("P9", "e")), (2, 3, _rec("  ", "f"))]


def _state(spark, folder):
    expected = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P3",)], "patient_id STRING")
    records, rejects = B.combine(spark, folder, expected)
    return (sorted((r.patient_id, r.batch_no, r.record, r.status) for r in records.collect()),
            sorted((r.batch_no, r.line_pos, r.reason) for r in rejects.collect()))


WANT = ([("P1", 1, _rec("P1", "a"), "labelled"), ("P2", 2, _rec("P2", "c"), "labelled"),
         ("P3", None, None, "missing")],
        [(1, 1, "invalid JSON"), (1, 2, "row is not an object"), (1, 3, "no patient id"),
         (1, 4, "repeated patient"), (2, 1, "repeated patient"), (2, 2, "unknown patient"), (2, 3, "no patient id")])


@pytest.fixture
def folder(spark):
    path = scratch_path(spark, "job")
    B.create(spark, path)
    return path


@pytest.mark.parametrize("calls", [[ONE, TWO], [TWO, ONE], [ONE + TWO], [ONE, ONE, ONE + TWO, TWO]])
def test_any_order_and_repetition_of_calls(spark, folder, calls):
    for rows in calls:
        B.ingest(_lines(spark, rows), folder)
    assert _state(spark, folder) == WANT


def test_a_call_that_died_before_its_commit_leaves_no_rows(spark, folder):
    B.ingest(_lines(spark, ONE), folder)
    B.checked(_lines(spark, [(2, 0, _rec("P2", "half"))])).write.parquet(f"{folder}/runs/run={uuid.uuid4().hex}")
    assert _state(spark, folder)[0][1] == ("P2", None, None, "missing")
    B.ingest(_lines(spark, TWO), folder)
    assert _state(spark, folder) == WANT


def test_two_calls_at_once_count_once(spark, folder):
    """Both saw the batch as new: the manifest names it twice."""
    B.ingest(_lines(spark, ONE), folder)
    run = "0" * 32
    B.checked(_lines(spark, ONE)).write.parquet(f"{folder}/runs/run={run}")
    spark.createDataFrame([(1, run)], B.SEEN).write.mode("append").parquet(f"{folder}/manifest")
    assert B.committed(spark, folder).count() == len(ONE)


def test_empty_job(spark, folder):
    B.ingest(_lines(spark, []), folder)
    records, rejects = _state(spark, folder)
    assert [r[3] for r in records] == ["missing"] * 3 and rejects == []


def test_gate_fails_behind_the_tables(spark, folder):
    B.ingest(_lines(spark, ONE + TWO), folder)
    expected = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "patient_id STRING")
    out = scratch_path(spark, "out")
    with pytest.raises(Exception, match="job is not complete: (missing|unknown patient) 1"):
        B.finalize(spark, folder, expected, out).collect()
    assert spark.read.parquet(f"{out}/records").count() == 3
    assert spark.read.parquet(f"{out}/rejects").count() == 7
    B.ingest(_lines(spark, [(3, 0, _rec("P3", "late"))]), folder)
    found = B.finalize(spark, folder, expected, scratch_path(spark, "out"), fatal=("missing",)).collect()
    assert {r.outcome: r.n for r in found} == {
        "labelled": 3, "invalid JSON": 1, "row is not an object": 1, "no patient id": 2,
        "repeated patient": 2, "unknown patient": 1}
