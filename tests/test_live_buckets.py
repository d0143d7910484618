"""The live snapshot's state by buckets of vessels: one value, one timer, whatever the number of vessels."""

import random

import pandas as pd

from tidewake.streaming import live

FIXES = "mmsi long, ts double, lon double, lat double, sog double, tie long"


class Handle:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def clear(self):
        self.value = None

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):
        self.timers.remove(at)
        self.calls += 1


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_bucket_is_one_value_and_one_timer():
    store, bucket = Handle(), live.LatestFixes()
    bucket.init(store)
    given = pd.DataFrame({"mmsi": range(1000), "ts": [1e6 + i for i in range(1000)], "tie": range(1000), "lon": 24.0, "lat": 59.0, "sog": None})
    (out,) = bucket.handleInputRows((0,), iter([given[500:], given[:500], given]), None)
    assert len(out) == 1000 and not out.gone.any() and store.calls == 2 and store.timers == {1_000_000_000}
    # What is known already or earlier changes nothing.
    assert list(bucket.handleInputRows((0,), iter([given, given.assign(ts=0.0)]), None)) == [] and store.calls == 2
    (out,) = bucket.handleInputRows((0,), iter([given[:1].assign(ts=2e6), given[1:2].assign(tie=7, lon=25.0)]), None)
    assert out[["mmsi", "ts", "tie", "lon"]].values.tolist() == [[0, 2e6, 0, 24.0], [1, 1e6 + 1, 7, 25.0]]
    assert store.timers == {live.expiry(1e6 + 1)}
    store.timers.clear()  # it fires
    (out,) = bucket.handleExpiredTimer((0,), Times(live.expiry(1e6 + 600)), Times(live.expiry(1e6 + 1)))
    assert sorted(out.mmsi) == list(range(1, 601)) and out.gone.all() and store.timers == {live.expiry(1e6 + 601)}
    store.timers.clear()
    (out,) = bucket.handleExpiredTimer((0,), Times(live.expiry(3e6)), Times(live.expiry(3e6)))
    assert len(out) == 400 and store.value is None and not store.timers


def test_vessels_of_one_bucket_go_each_at_its_time(spark, tmp_path):
    rng = random.Random(4)
    log, seen = live.ChangeLog(spark, str(tmp_path / "out")), []
    for i in range(3):
        rows = [(rng.randrange(60), 1e9 + 900.0 * i + rng.randrange(1500), 24.0, 59.0, rng.choice([None, 1.0]), n + 1000 * i) for n in range(80)]
        seen += rows
        spark.createDataFrame(rows, FIXES).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    live.run(live.live_changes(stream, buckets=1), log, str(tmp_path / "check")).awaitTermination()
    end, newest = max(r[1] for r in seen), {}
    for r in seen:
        newest[r[0]] = max(newest.get(r[0], r), r, key=lambda r: (r[1], r[5]))
    want = {r[0]: (r[1], r[5], r[4]) for r in newest.values() if r[1] > end - live.STALE_S}
    assert {r.mmsi: (r.ts, r.tie, r.sog) for r in log.snapshot().collect()} == want and len(want) < len(newest)
