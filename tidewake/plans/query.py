"""A named query: the tables it needs and its SQL in a dialect."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewake.plans.dialect import DUCKDB, SPARK, Dialect
from tidewake.plans.ship import ship
from tidewake.sources.fixtures import BASE, with_tables


@dataclass(frozen=True)
class Query:
    name: str
    needs: tuple[str, ...]
    body: Callable[[Dialect], str]
    steps: Callable[[Dialect], list[tuple[str, str]]] | None = None
    #: Gives the result from DataFrames (by their tables' names); the SQL is then the oracle's alone.
    frame: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None

    def text(self, d: Dialect) -> str:
        return counted(with_tables(d, self.needs, self.steps(d) if self.steps else []) + self.body(d))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        if self.frame is not None:
            return self.frame(lambda name: spark.sql(f"{with_tables(SPARK, (name,))}select * from {name}"))
        return spark.sql(self.text(SPARK))

    def over(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The query over a caller's tables, by the names it needs (``needs``); tables made of others are made of those."""
        views = {n: f"given_{n}_{uuid.uuid4().hex}" for n in frames}
        for n, view in views.items():
            frames[n].createOrReplaceTempView(view)
        if self.frame is not None:
            return self.frame(lambda n: spark.sql(f"{with_tables(SPARK, (n,), given=views)}select * from {n}"))
        return spark.sql(counted(with_tables(SPARK, self.needs, self.steps(SPARK) if self.steps else [], views) + self.body(SPARK)))

    def oracle(self) -> str:
        return self.text(DUCKDB)


def counted(sql: str) -> str:
    """``count_if(x)`` as a count of a case, which is a bigint in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + len('count_if('):end - 1]} then 1 end){sql[end:]}"
    return sql


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views over the driver's tables; column pruning and filters reach the Parquet scans."""
    ship(spark)
    for t in BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def query(name: str, *needs: str, steps: Callable[[Dialect], list[tuple[str, str]]] | None = None, frame: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None):
    """Makes a Query of a function from a dialect to SQL."""
    return lambda body: Query(name, needs, body, steps, frame)
