"""State that ends and upserts that read only what they must."""

from __future__ import annotations

import datetime as dt

import pytest

from veriskill.operators import tracks
from veriskill.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batches_of(spark, rows, schema, path):
    """One file for each batch, oldest first."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in")


def test_a_finished_run_leaves_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "run string, step int, lat double, lon double, time timestamp"
    a = [("a", s, 10 + 0.4 * s, 120.0 + s, at(6 * s)) for s in range(4)] + [("a", 2, -40.0, 10.0, at(12))]
    b = [("b", s, 20 + 0.3 * s, 140.0, at(6 * s)) for s in range(0, 60, 2)]
    steps = [[r for r in a + b if r[1] in group] for group in (range(2), range(2, 4), range(4, 20), range(20, 40), range(40, 60))]
    # a row of the old run that is later than the watermark begins it anew
    stream = batches_of(spark, [*steps, [("a", 100, 0.0, 0.0, at(600))]], schema, tmp_path)
    paths = streams.path_stream(stream, "run", "time", idle_hours=48, memory=2)
    q = paths.writeStream.outputMode("append").format("memory").queryName("ended").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    state = lambda batch: {r.key.run for r in spark.read.format("statestore").option("stateVarName", "run_so_far").option("batchId", batch).load(f"{tmp_path}/c").collect()}
    assert state(1) == {"a", "b"} and state(4) == {"b"}
    got = sorted((r.run, r.step, r.lat, r.path_id) for r in spark.table("ended").collect())
    whole = tracks.link_paths(spark.createDataFrame(a + b, schema), ["run"]).collect()
    assert got == sorted([*((r.run, r.step, r.lat, r.path_id) for r in whole), ("a", 100, 0.0, 0)])
    assert {p for r, _, _, p in got if r == "b"} == {0} and {p for r, s, _, p in got if r == "a" and s < 100} == {0, 1}


@pytest.mark.parametrize("within", [None, "init"])
def test_upserts_read_only_parts_that_may_hold_a_key(spark, tmp_path, within):
    schema = "init timestamp, lead int, v double"
    day = lambda d: dt.datetime(2024, 1, d, 0, 0, 0, 123456)
    first = [(day(d), h, float(d)) for d in (1, 2) for h in range(0, 240, 6)]
    second = [(day(d), h, float(d)) for d in (3, 4) for h in range(0, 240, 6)]
    between = [(day(d), h, 9.0) for d in (1, 4) for h in range(3, 240, 6)]  # in the ranges of both, in neither's keys
    again = [(day(4), 6, -1.0), (day(5), 0, 5.0), (day(5), 0, 6.0), (None, 0, 1.0)]
    target = f"{tmp_path}/target"
    rows = [spark.createDataFrame(x, schema).coalesce(1) for x in (first, second, between, again, [(None, 0, 2.0), (day(6), None, 1.0)])]
    assert [streams.upsert(r, k, target, ["init", "lead"], within) for k, r in enumerate(rows)] == [0, 0, 0, 1, 1]
    assert streams.parts_that_may_hold(rows[3], target, ["init", "lead"]) == [1, 3]
    assert streams.parts_that_may_hold(spark.createDataFrame([(day(2), 12, 0.0)], schema), target, ["init", "lead"]) == [0]
    want = [*first, *second, *between, (day(5), 0, 6.0), (None, 0, 1.0), (day(6), None, 1.0)]
    seen = lambda: sorted((str(r.init), str(r.lead), r.v) for r in streams.read_committed(spark, target).select("init", "lead", "v").collect())
    assert seen() == sorted((str(i), str(h), v) for i, h, v in want)
    # a replayed batch adds nothing, and what a failed attempt left is not seen
    assert streams.upsert(rows[3], 3, target, ["init", "lead"], within) == 0
    rows[0].write.parquet(f"{target}/batch=9")
    assert seen() == sorted((str(i), str(h), v) for i, h, v in want)
    streams.upsert(spark.createDataFrame([], schema), 10, target, ["init", "lead"], within)
    assert streams.committed_parts(spark, target) == [0, 1, 2, 3, 4, 10] and len(seen()) == len(want)


def test_append_new_stream(spark, tmp_path):
    stream = batches_of(spark, [[(k, float(n)) for k in range(3 * n, 3 * n + 5)] for n in range(4)], "k int, v double", tmp_path)
    assert streams.append_new(stream, f"{tmp_path}/t", ["k"], f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.k, r.v) for r in streams.read_committed(spark, f"{tmp_path}/t").collect())
    assert got == [(k, float(max(0, (k - 2) // 3))) for k in range(14)]
