"""Streams over files that come one after another: late and future rows, recovery, state, sinks."""

import json

import pytest

from tidewake.sources import feed
from tidewake.streaming import live

KIND = "mmsi long, ts double, lon double, lat double, sog double, arrived double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def finish(query):
    query.awaitTermination()


def test_future_times_are_clamped_and_recovery_equals_one_run(spark, tmp_path):
    day = 86400.0
    put(spark, tmp_path / "in", "a", [(1, 100 * day, 24.0, 59.0, 1.0, 100 * day), (1, 100 * day, 24.0, 59.0, 1.0, 100 * day), (2, 200 * day, 24.0, 59.0, 1.0, 100 * day)])
    sink = lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
    once = lambda: live.deduplicated(live.clamped(source(spark, tmp_path / "in")))
    finish(live.run(once(), sink, str(tmp_path / "check")))
    # A restart goes on from the checkpoint: a row that came before isn't given again.
    put(spark, tmp_path / "in", "b", [(1, 100 * day, 24.0, 59.0, 1.0, 101 * day), (1, 101 * day, 24.0, 59.0, 1.0, 101 * day)])
    finish(live.run(once(), sink, str(tmp_path / "check")))
    put(spark, tmp_path / "in", "c", [(3, 101 * day, 24.0, 59.0, 1.0, 101 * day), (3, 50 * day, 24.0, 59.0, 1.0, 101 * day)])
    finish(live.run(once(), sink, str(tmp_path / "check")))
    got = sorted((r.mmsi, r.ts / day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # The row of day 50 is later than the horizon.
    assert got == [(1, 100), (1, 101), (2, 100), (3, 101)]


def test_snapshot_keeps_absent_vessels_until_they_are_stale(spark, tmp_path):
    snapshot = live.Snapshot(spark, str(tmp_path / "state"))
    batch = lambda *rows: spark.createDataFrame(rows, KIND)
    snapshot(batch((1, 0.0, 24.0, 59.0, 1.0, 0.0), (2, 1000.0, 24.0, 59.0, 1.0, 0.0)), 0)
    snapshot(batch((3, 1900.0, 24.0, 59.0, 1.0, 0.0), (3, 1800.0, 25.0, 59.0, 1.0, 0.0), (2, 900.0, 26.0, 59.0, 1.0, 0.0)), 1)
    want = {2: 1000.0, 3: 1900.0}
    assert {r.mmsi: r.ts for r in snapshot.read(1).collect()} == want
    snapshot(batch((3, 1900.0, 24.0, 59.0, 1.0, 0.0), (3, 1800.0, 25.0, 59.0, 1.0, 0.0), (2, 900.0, 26.0, 59.0, 1.0, 0.0)), 1)
    assert {r.mmsi: r.ts for r in snapshot.read(1).collect()} == want and snapshot.read(7) is None
    snapshot(batch().limit(0), 2)
    assert {r.mmsi for r in snapshot.read(2).collect()} == {2, 3}


def test_fan_out_drops_a_dead_sink(spark, tmp_path):
    seen = []

    def dead(batch, number):
        raise OSError("gone")

    hub = live.FanOut({"a": lambda b, n: seen.append((n, b.count())), "dead": dead})
    put(spark, tmp_path / "in", "a", [(1, 1.0, 24.0, 59.0, 1.0, 1.0)])
    put(spark, tmp_path / "in", "b", [(1, 2.0, 24.0, 59.0, 1.0, 2.0)])
    finish(live.run(source(spark, tmp_path / "in"), hub, str(tmp_path / "check")))
    assert sorted(n for n, _ in seen) == [0, 1] and set(hub.sinks) == {"a"} and "gone" in hub.dropped["dead"]


def test_single_flight_recovery_and_swap(spark, tmp_path):
    asked = spark.createDataFrame([("x", 2.0), ("x", 1.0), ("y", 3.0)], "scene string, asked double")
    running = spark.createDataFrame([("y",)], "scene string")
    assert [tuple(r) for r in live.single_flight(asked, running).collect()] == [("x", 1.0)]
    scenes = spark.createDataFrame([("x", "processing"), ("y", "clear")], "scene string, status string")
    assert {r.scene: r.status for r in live.recovered(scenes).collect()} == {"x": "catalogued", "y": "clear"}
    rows = lambda *r: spark.createDataFrame(r, "slick_id long, mmsi long, score double")
    path = str(tmp_path / "analyses")
    live.swap(rows((1, 10, 5.0), (1, 11, 4.0), (2, 10, 1.0)), path)
    live.swap(rows((1, 12, 9.0)), path)
    assert sorted((r.slick_id, r.mmsi) for r in spark.read.parquet(path).collect()) == [(1, 12), (2, 10)]


FIXES = "mmsi long, ts double, lon double, lat double, sog double, tie long"


def snapshot_of(rows):
    """By hand: each vessel's latest fix, if it is less than 1800 s behind the latest of all."""
    latest, newest = max(r[1] for r in rows), {}
    for r in rows:
        if r[0] not in newest or (r[1], r[5]) > (newest[r[0]][1], newest[r[0]][5]):
            newest[r[0]] = r
    return {m: (r[1], r[5]) for m, r in newest.items() if int(r[1] * 1000) > int(latest * 1000) - 1_800_000}


def test_state_keeps_the_latest_fix_and_timers_evict(spark, tmp_path):
    log, seen = live.ChangeLog(spark, str(tmp_path / "out")), []
    batches = [
        [(1, 0.0, 24.0, 59.0, 1.0, 1), (2, 1000.0, 24.0, 59.0, None, 2), (2, 1000.0, 25.0, 59.0, 1.0, 1)],
        [(3, 1900.0, 24.0, 59.0, 1.0, 3), (3, 1800.0, 25.0, 59.0, 1.0, 4), (2, 900.0, 26.0, 59.0, 1.0, 5)],
        [(1, 50.0, 24.0, 59.0, 1.0, 9), (4, 2900.0, 24.0, 59.0, 1.0, 3), (1, 2000.0, 24.0, 59.0, 1.0, 9)],
        [(5, 4700.0, 24.0, 59.0, 1.0, 3), (5, 4700.0, 24.5, 59.0, 1.0, 3)],
    ]
    for i, given in enumerate(batches):
        rows = [(r[0], r[1] + 1e9, *r[2:]) for r in given]
        seen += rows
        spark.createDataFrame(rows, FIXES).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        # Each call is a restart from the checkpoint.
        finish(live.run(live.live_changes(stream), log, str(tmp_path / "check")))
        assert {r.mmsi: (r.ts, r.tie) for r in log.snapshot().collect()} == snapshot_of(seen)
    first = {r.mmsi: r for r in log.snapshot(0).collect()}
    assert first[2].tie == 2 and first[2].sog is None


def test_a_lost_batch_is_an_error(spark, tmp_path):
    log = live.ChangeLog(spark, str(tmp_path / "out"))
    assert log.snapshot().count() == 0
    one = spark.createDataFrame([(1, 1.0, 1, 24.0, 59.0, 1.0, False)], live.CHANGE)
    for n in (0, 1, 3):
        log(one, n)
    assert log.snapshot(1).count() == 1
    with pytest.raises(FileNotFoundError, match=r"\[2\]"):
        log.snapshot()
    with pytest.raises(FileNotFoundError):
        log.snapshot(5)
    with pytest.raises(FileNotFoundError):
        live.Snapshot(spark, str(tmp_path / "state"))(spark.createDataFrame([(1, 1.0, 24.0, 59.0, 1.0, 1.0)], KIND), 4)


def document(*fixes):
    return json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"coordinates": at}, "properties": told} for at, told in fixes]})


def test_feed_reads_each_document_once(spark, tmp_path):
    folder = tmp_path / "feed"
    assert feed.names(str(folder)) == []
    folder.mkdir()
    (folder / "0001.json").write_text(document(([24.0, 59.0], {"mmsi": 1, "timestampExternal": 1000, "sog": 3}), ([], {"mmsi": 2, "timestampExternal": 1000})))
    (folder / "_half.json").write_text("{")
    (folder / "0002.json").write_text(document(([24.0, 59.0], {"mmsi": None}), ([25.0, 59.5], {"mmsi": 3, "timestampExternal": 99_000_000_000, "navStat": 5})))
    assert feed.feed(spark, str(folder)).count() == 4
    got = {r.mmsi: (r.ts, r.navstat) for r in feed.feed(spark, f"file:{folder}", now=500.0).collect()}
    assert got == {1: (1.0, None), 3: (500.0, 5)}
    log = live.ChangeLog(spark, str(tmp_path / "out"))
    once = lambda: finish(live.run(feed.feed(spark, str(folder), now=500.0, stream=True), log, str(tmp_path / "check")))
    read = lambda: sorted((r.document, r.mmsi) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    once()
    assert read() == [("0001.json", 1), ("0002.json", 3)]
    (folder / "0003.json").write_text(document(([24.0, 59.0], {"mmsi": 7, "timestampExternal": 1000})))
    once()
    once()  # nothing new, nothing twice
    assert read() == [("0001.json", 1), ("0002.json", 3), ("0003.json", 7)]
    (folder / "0004.json").write_text("not a document")
    with pytest.raises(Exception, match="JSON"):
        once()


def test_documents_hold_all_positions(spark, tmp_path):
    rows = [(i % 7, i * 40.0, 24.0, 59.0 + i / 1000, 1.0, 2.0, 3) for i in range(300)]
    feed.write_documents(spark.createDataFrame(rows, "mmsi long, ts double, lon double, lat double, sog double, cog double, navstat int"), str(tmp_path / "d"), most=30)
    got = sorted(tuple(r)[:7] for r in feed.feed(spark, str(tmp_path / "d"), lines=True).collect())
    assert got == sorted(rows)
