"""Resumable export: killed and resumed, it gives what one run gives, from one snapshot."""

import pytest
from pyspark.sql import functions as F

from logloom.checks import registry as R
from logloom.plans import export as X
from logloom.plans import query as Q
from logloom.plans import resume as XR
from logloom.plans import tables
from logloom.session import path_exists, scratch_path
from logloom.sources import table as TB

from .conftest import SF_SMALL

SIZES = {"chunk_rows": 0, "chunks_per_commit": 3}


@pytest.fixture(scope="module")
def logs(spark):
    path = TB.compact_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-resume"), R.BATCH_BUCKET)
    logs = TB.read_logs(spark, path)
    SIZES["chunk_rows"] = Q.select_logs(logs, R.PAGE_CHAIN, R.PAGE_TOPIC).count() // 8 + 1
    return logs


def run(logs, path, **more):
    return XR.export_resumable(logs, path, R.PAGE_CHAIN, R.PAGE_TOPIC, **SIZES, **more)


def manifest(m):
    return [tuple(r) for r in m.drop("file").orderBy("chunk").collect()]


def content(spark, path, fmt="parquet"):
    return sorted(map(tuple, XR.read_committed_export(spark, path, fmt).collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark, logs):
    path = scratch_path(spark, "t-whole")
    return manifest(run(logs, path)), content(spark, path)


def test_one_run_equals_plain_export(spark, logs, whole):
    path = scratch_path(spark, "t-plain")
    X.export_logs(logs, path, R.PAGE_CHAIN, R.PAGE_TOPIC)
    assert content(spark, path) == [] and whole[1] == sorted(map(tuple, X.read_export(spark, path).collect()), key=repr)
    assert len(whole[0]) > 2 * SIZES["chunks_per_commit"]
    assert sum(m[1] for m in whole[0]) == len(whole[1])
    ends = [tuple(map(int, c.split(":"))) for m in whole[0] for c in (m[3], m[4])]
    assert all(a <= b for a, b in zip(ends[::2], ends[1::2])) and all(a < b for a, b in zip(ends[1::2], ends[2::2]))


@pytest.mark.parametrize("step", ["write_chunks", "commit_chunks"])
def test_killed_in_a_step_and_resumed(spark, logs, whole, monkeypatch, step):
    """The second commit dies before or after its files are written; the rows
    that the table gains meanwhile stay out."""
    path, real, calls = scratch_path(spark, "t-killed"), getattr(XR, step), []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(XR, step, dies)
    with pytest.raises(RuntimeError, match="killed"):
        run(logs, path)
    monkeypatch.undo()
    done = manifest(XR.committed_manifest(spark, path))
    assert done == whole[0][:SIZES["chunks_per_commit"]]
    assert XR.last_cursor(spark, path) == done[-1][-1]
    assert len(content(spark, path)) == sum(m[1] for m in done)  # files of the dead step are not read
    before = {r["file"] for r in XR.committed_manifest(spark, path).collect()}
    grown = logs.unionByName(logs.withColumn("block_number", F.col("block_number") + 1))
    m = run(grown, path)
    assert manifest(m) == whole[0] and content(spark, path) == whole[1]
    assert before <= {r["file"] for r in m.collect()}  # committed files were not written again
    assert not path_exists(spark, f"{path}/_snapshot")
    assert manifest(run(grown, path)) == whole[0]


def test_killed_while_the_snapshot_is_taken(spark, logs, whole, monkeypatch):
    path, real = scratch_path(spark, "t-early"), XR.take_snapshot

    def dies(*args):
        real(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(XR, "take_snapshot", dies)
    with pytest.raises(RuntimeError):
        run(logs.where("block_number % 2 = 0"), path)
    monkeypatch.undo()
    assert manifest(run(logs, path)) == whole[0]


def test_bounded_runs_and_text_chunks(spark, logs, whole):
    path, n = scratch_path(spark, "t-slots"), 0
    while not n or path_exists(spark, f"{path}/_snapshot"):
        run(logs, path, max_commits=1, fmt="json")
        n += 1
    assert n == -(-len(whole[0]) // SIZES["chunks_per_commit"])
    assert manifest(XR.committed_manifest(spark, path)) == whole[0]
    assert content(spark, path, "json") == whole[1]


def test_other_request_is_refused_and_empty_export(spark, logs):
    path = scratch_path(spark, "t-empty")
    assert run(logs.where("false"), path).collect() == [] and content(spark, path) == []
    assert run(logs, path).collect() == []  # the request was answered already
    with pytest.raises(ValueError, match="holds an export"):
        run(logs, path, to_block=5)
    with pytest.raises(ValueError):
        XR.export_resumable(logs, path + "-x", R.PAGE_CHAIN, "no topic")


def test_one_position_only(spark, logs):
    """All rows at one position make one chunk; the chunks planned beside it are empty."""
    n = 3 * SIZES["chunk_rows"]
    same = Q.select_logs(logs, R.PAGE_CHAIN, R.PAGE_TOPIC).limit(1).withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    same = same.withColumn("data", F.col("id").cast("string").cast("binary")).drop("id")
    path = scratch_path(spark, "t-one")
    assert [r["rows"] for r in run(same, path).collect()] == [n]
    assert len(content(spark, path)) == n


def test_chunks_are_in_order_inside(spark, logs):
    path = scratch_path(spark, "t-order")
    m = run(logs, path).collect()
    for r in m[:3]:
        commit = r["chunk"] // SIZES["chunks_per_commit"]
        pos = [(x[0], x[1]) for x in spark.read.schema(X.EXPORT_SCHEMA).parquet(f"{path}/data/commit_no={commit}/{r['file']}")
               .select("blockNumber", "logIndex").collect()]
        assert pos == sorted(pos) and len(pos) == r["rows"]
