"""Debounced requests over event time with late, repeated and out-of-order events and a restart; bucketed merges that follow the batch, replays and readers."""

import datetime as dt
import json
import os

import pytest

from auditloom.streaming import state

START = dt.datetime(2024, 5, 1, 12)
EVENT = "k string, ts timestamp, request_id string, payload string"


@pytest.fixture(scope="module")
def stream(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    yield spark
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, number, events):
    """A file of events (key, second, request, payload)."""
    rows = [{"k": k, "ts": (START + dt.timedelta(seconds=s)).isoformat(), "request_id": r, "payload": p} for k, s, r, p in events]
    name = folder / f"{number:03d}.json"
    name.write_text("\n".join(map(json.dumps, rows)) + "\n")
    os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, out, checkpoint):
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder))
    q = state.debounced(source, "k", quiet="10 seconds", late="5 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.key, r.request_id, r.payload, int((r["at"] - START).total_seconds()), r.n_requests) for r in spark.read.parquet(str(out)).collect())


def test_debounce(stream, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    put(folder, 1, [("a", 0, "r1", "one"), ("b", 0, "r1", "bee"), ("a", 4, "r2", "two"), ("a", 4, "r2", "two")])
    put(folder, 2, [("a", 9, "r3", "three"), ("a", 7, "r0", "older"), (None, 9, "x", "none")])
    put(folder, 3, [("c", 16, "r1", "see")])  # the watermark reaches 11: b is due, a (19) is not
    assert run(stream, folder, out, checkpoint) == [("b", "r1", "bee", 0, 1)]
    # A restart goes on from the checkpoint: a is superseded again, then due.
    put(folder, 4, [("a", 17, "r4", "four"), ("a", 2, "late", "dropped")])
    put(folder, 5, [("z", 60, "r", "zed")])
    put(folder, 6, [("z", 61, "s", "zed")])
    got = run(stream, folder, out, checkpoint)
    assert [g for g in got if g[0] == "a"] == [("a", "r4", "four", 17, 5)]
    assert [g for g in got if g[0] == "c"] == [("c", "r1", "see", 16, 1)] and not [g for g in got if g[0] == "z"]


ROW = "id long, name string, v long"


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_bucketed_merge_follows_the_batch(spark, tmp_path):
    table = state.BucketedTable(spark, str(tmp_path / "t"), ["id"], "v", buckets=16)
    assert table.read() is None and table.manifest() is None
    assert table.merge(spark.createDataFrame([(k, "first", 1) for k in range(400)], ROW), 0)
    first = files_of(tmp_path)
    assert table.merge(spark.createDataFrame([(7, "second", 2), (7, "older", 0), (9, "tie", 1), (1000, "new", 1)], ROW), 1)
    added = files_of(tmp_path) - first
    assert 1 <= len(added) <= 3
    rows = {r.id: (r.name, r.v) for r in table.read().collect()}
    assert len(rows) == 401 and rows[7] == ("second", 2) and rows[9] == ("tie", 1) and rows[1000] == ("new", 1) and rows[8] == ("first", 1)
    # An epoch that is there is not merged again; readers of an epoch keep what it was.
    assert not table.merge(spark.createDataFrame([(7, "again", 99)], ROW), 1) and {r.name for r in table.read().where("id = 7").collect()} == {"second"}
    assert table.read(0).where("id = 7").first().name == "first" and table.read(0).count() == 400
    # An epoch that failed before its manifest is overwritten.
    (tmp_path / "t/data/epoch=2/__bucket=3").mkdir(parents=True)
    (tmp_path / "t/data/epoch=2/__bucket=3/part-x.parquet").write_text("broken")
    assert table.merge(spark.createDataFrame([(8, "third", 3)], ROW), 2) and table.read().where("id = 8").first().name == "third" and table.read().count() == 401
    assert table.merge(spark.createDataFrame([], ROW), 3) and table.read().count() == 401
    assert table.vacuum(keep=1) > 0 and table.read().count() == 401


def test_bucketed_sink_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "name": f"e{k}", "v": k}) for i in range(k, 6)) + "\n")
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    table = state.BucketedTable(spark, str(tmp_path / "t"), ["id"], "v", buckets=4)
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(folder))
    source.writeStream.foreachBatch(state.bucketed_sink(table)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.name for r in table.read().collect()} == {0: "e0", 1: "e1", 2: "e2", 3: "e2", 4: "e2", 5: "e2"}
    assert table.manifest()["epoch"] == 2
