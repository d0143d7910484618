"""Fixes of a vessel within one rounded time."""

import datetime

from tidewake.streaming import ingest

START = datetime.datetime(2024, 1, 1, 1)


def test_times_that_round_alike_are_one_fix(spark, tmp_path):
    """40 milliseconds of the events are one of the positions."""
    rows = [(n, START + datetime.timedelta(microseconds=us), 7, "view", 1.0, "{}") for n, us in enumerate((0, 100, 200, 80_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = ingest.stream_ingest_equals_batch(spark, str(tmp_path)).collect()
    assert sorted(r.ts for r in got) == [90.0, 90.002]
