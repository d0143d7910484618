"""Drift runs that share an id: the first of the table, on several executors as well."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidewake import registry
from tidewake.sources.fixtures import BASE

SF = "/root/testdata/sf0.001"
RUN = """
import json, sys
from pyspark.sql import SparkSession
from tidewake import registry
folder, split = sys.argv[1:]
conf = {"ui.enabled": "false", "ui.showConsoleProgress": "false", "executor.memory": "1g", "sql.shuffle.partitions": "4", "sql.session.timeZone": "UTC",
        "sql.files.maxPartitionBytes": split, "sql.files.openCostInBytes": "0", "checkpoint.dir": folder + "/shared", "sql.warehouse.dir": folder + "/warehouse"}
builder = SparkSession.builder.master("local-cluster[3,1,1024]")
for key, value in conf.items():
    builder = builder.config("spark." + key, value)
spark = builder.getOrCreate()
assert spark.read.parquet(folder + "/lineitem.parquet").rdd.getNumPartitions() > 5
print(json.dumps([sorted(map(list, registry.QUERIES["latest_drift_run"](spark, folder).collect())) for _ in range(2)]))
spark.stop()
"""


def test_runs_that_share_an_id_are_the_tables_first(tmp_path):
    for t in BASE:
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    n, lines = 8_000, tmp_path / "lineitem.parquet"
    lines.unlink()
    at = list(range(n))
    pq.write_table(pa.table({"l_orderkey": [7] * n, "l_suppkey": [i * 7919 % 50 for i in at], "l_linenumber": pa.array([1 + i // 50 % 2 for i in at], "int32"), "l_quantity": [float(i) for i in at]}), lines, row_group_size=1_000)
    con = duckdb.connect()
    con.execute("set threads = 1")  # with more the SQL has several answers
    con.execute(f"create view lineitem as select * from '{lines}'")
    want = sorted(map(list, con.execute(registry.ORACLE["latest_drift_run"]).fetchall()))
    assert len(want) == 100 and {r[3] for r in want} == {float(i) for i in range(100)}
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), str(lines.stat().st_size // 8)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert json.loads(out.stdout.splitlines()[-1]) == [want, want]
