"""Rounds write files by their rows, however many shuffle partitions there are."""

import uuid

import pytest

from tessera.llm import _common as C
from tessera.llm import components, line_dedup


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_write_few_files(spark, monkeypatch, many_partitions):
    seen, checkpoint = [], C.checkpoint

    def watched(df):
        out = checkpoint(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components.C, "checkpoint", watched)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49], "u long, v long")).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}
    assert len(seen) > 2 and max(seen) <= C.ROUND_TASKS


def test_line_rounds_write_few_files(spark, monkeypatch, many_partitions):
    seen, written = [], C.written

    def watched(df):
        out = written(df)
        seen.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(line_dedup.C, "written", watched)
    text = "\n".join(f"line {i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, "own\n" + text), (3, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (300, 0, text), 2: (301, 300, "own"), 3: (1, 0, "alone")}
    # The first table's size is not known beforehand.
    assert len(seen) > 4 and max(seen[1:]) <= C.ROUND_TASKS


def test_large_rounds_keep_their_partitions(spark):
    assert C.few(spark.range(0, 100, 1, 30), 40 * C.ROUND_ROWS).rdd.getNumPartitions() == 30


def tasks_of(spark, run):
    """What run returns, and how many tasks each stage of its jobs has."""
    group, tracker = f"tasks-{uuid.uuid4().hex}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, [x.numTasks for s in stages if (x := tracker.getStageInfo(s)) is not None and x.numCompletedTasks]


def test_rounds_run_few_tasks(spark, many_partitions):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49], "u long, v long").coalesce(2)
    try:
        got, tasks = tasks_of(spark, lambda: components.components(edges).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["node"]: r["component"] for r in got} == {i: i // 50 * 50 for i in range(200)}
    # Stages that read a union have twice as many tasks.
    assert len(tasks) > 10 and max(tasks) <= 2 * C.ROUND_TASKS
