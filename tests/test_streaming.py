"""Streams leave their rows with the executors."""

import pytest

from tidewake import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_ingest_equals_batch", "stream_live_snapshot"])
def test_result_lies_in_the_shared_folder(spark, name):
    got = registry.QUERIES[name](spark, SF)
    files = got.inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)
