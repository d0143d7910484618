"""Fixes at and before the epoch of their clock, where a stream's watermark starts."""

import datetime

import pytest

from tidewake.streaming import ingest

START = datetime.datetime(2024, 1, 1)
AT = (-400, -2, 0, 0.01, 0.12, 400)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(n, START + datetime.timedelta(seconds=s), 7, "view", 1.0, "{}") for n, s in enumerate(AT)]
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/events.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_fixes_at_and_before_the_epoch_are_kept(spark, events):
    assert sorted(r.ms for r in ingest.feed_ingest(spark, events).collect()) == [-10_000, -50, 0, 3, 10_000]
    assert sorted(r.ts for r in ingest.stream_ingest_equals_batch(spark, events).collect()) == [-10.0, -0.05, 0.0, 0.003, 10.0]
