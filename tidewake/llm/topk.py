"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of at most ``block`` rows (a broadcast of bounded
size); every block meets every candidate.  Each pass scores all candidates in
matrix products and sends, for every query, the counts of the score bins that
can still hold the k-th best: a task's own k best lie in its top bins, so the
lower ones are cut where they are made.  The summed histogram locates the bin
of the k-th value; the next pass divides that bin, until a bin is one score
wide.  A last pass keeps what scores above the k-th value, and of the ties the
least ids that still fit: at most k of either a task and query.

Scores are integer inner products of floor(scale * x).  They are computed in
double precision where no partial sum can reach 2**53 and in Python integers
otherwise, so they are exact; a score beyond 64 bits raises an error.

Defined results: vectors that are null, hold null or non-finite components, or
whose length differs from the queries', take no part; a null id neither; rows
of one id count as one candidate each, but no query meets its own id; repeated
query ids are searched once, by their least vector; fewer than k candidates
give what there is; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path

RESULT = "query_id long, rank int, vec_id long, score long"
BINS, BLOCK = 4_096, 4_096
TILE = 512


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``x array<double>`` of whole numbers; only the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # From 2**53 on a double is whole already, and its floor might not fit a long.
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.filter(finite).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given width as a matrix, and which rows those are."""
    at = np.asarray(column.offsets)
    fits = np.flatnonzero(np.diff(at) == width)
    flat = np.asarray(column.values)
    if len(fits) == len(column):
        return flat[at[0] : at[-1]].reshape(-1, width), fits
    return np.array([flat[at[i] : at[i + 1]] for i in fits]).reshape(-1, width), fits


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products, one row a query."""
    if not len(rows) or not queries.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in rows.tolist()]
    out = [[sum(int(a) * b for a, b in zip(q, r, strict=True)) for r in whole] for q in queries.tolist()]
    if any(not -(2**63) <= s < 2**63 for r in out for s in r):
        raise OverflowError("a score exceeds 64 bits")
    return np.array(out, np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate ids, scores, and a mask that leaves out each query's own id."""
    for b in batches:
        for i in range(0, b.num_rows, TILE):
            part = b.slice(i, TILE)
            rows, fits = _matrix(part.column(1), queries.shape[1])
            if len(fits):
                own = np.asarray(part.column(0))[fits]
                yield own, _scores(queries, rows), ids[:, None] != own[None, :]


def _block(queries: DataFrame, after: int | None, block: int) -> list:
    """The next queries by id: at most ``block`` rows reach the driver."""
    return (queries if after is None else queries.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(block).collect()


def _search(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, bins: int) -> DataFrame:
    n = len(queries)
    spark = rows.sparkSession

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, count = np.full(n, 2**63 - 1), np.full(n, -(2**63)), np.zeros(n, np.int64)
        for _, s, ok in _tiles(batches, ids, queries):
            lo = np.minimum(lo, np.where(ok, s, 2**63 - 1).min(axis=1))
            hi = np.maximum(hi, np.where(ok, s, -(2**63)).max(axis=1))
            count += ok.sum(axis=1)
        q = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(lo[q]), pa.array(hi[q]), pa.array(count[q])], names=["q", "lo", "hi", "n"])

    def histogram(lo: np.ndarray, hi: np.ndarray, width_of: np.ndarray, need: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = [np.zeros(0, np.int64)] * n
            for _, s, ok in _tiles(batches, ids, queries):
                bin_of = (s - lo[:, None]) // width_of[:, None]
                ok = ok & (s >= lo[:, None]) & (s <= hi[:, None])
                for q in np.flatnonzero(ok.any(axis=1)):
                    got = np.concatenate([top[q], bin_of[q][ok[q]]])
                    # The need-th best of this task bounds the bin that is sought from below.
                    top[q] = got if len(got) <= need[q] else np.partition(got, len(got) - need[q])[len(got) - need[q] :]
            out = [(q, *np.unique(t, return_counts=True)) for q, t in enumerate(top) if len(t)]
            qs = np.concatenate([np.full(len(u), q) for q, u, _ in out]) if out else np.zeros(0, np.int64)
            cat = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(cat(1), pa.int64()), pa.array(cat(2), pa.int64())], names=["q", "bin", "n"])

        return run

    def final(kth: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, int]]] = {}
            for own, s, ok in _tiles(batches, ids, queries):
                ok = ok & (s >= kth[:, None])
                for q in np.flatnonzero(ok.any(axis=1)):
                    at = np.flatnonzero(ok[q])
                    best = at[np.lexsort((own[at], -s[q][at]))][:k]
                    held[q] = sorted([*held.get(q, []), *zip((-s[q][best]).tolist(), own[best].tolist(), strict=True)])[:k]
            out = [(int(ids[q]), c, -s) for q, found in held.items() for s, c in found]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        return run

    lo, hi, have = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for r in rows.mapInArrow(bounds, "q long, lo long, hi long, n long").groupBy("q").agg(F.min("lo"), F.max("hi"), F.sum("n")).collect():
        lo[r[0]], hi[r[0]], have[r[0]] = r[1], r[2], r[3]
    need = np.minimum(k, have)  # of each query: the rank that is sought within [lo, hi]
    live = need > 0
    while live.any() and (hi > lo)[live].any():
        width_of = np.maximum(1, -(-(hi - lo + 1) // bins))
        # A bin's rank counts from the top of [lo, hi]; scores above hi are already accounted for in need.
        summed = rows.mapInArrow(histogram(lo, hi, width_of, need), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        limits = spark.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q long, need long")
        found = summed.withColumn("above", above).join(F.broadcast(limits), "q").filter((F.col("above") >= F.col("need")) & (F.col("above") - F.col("n") < F.col("need")))
        for r in found.select("q", "bin", F.col("need") - (F.col("above") - F.col("n"))).collect():
            q, b = r[0], r[1]
            lo[q], hi[q], need[q] = lo[q] + b * width_of[q], min(hi[q], lo[q] + (b + 1) * width_of[q] - 1), r[2]
    kth = np.where(live, lo, 2**63 - 1)
    best = rows.mapInArrow(final(kth), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``query`` holds."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col)
    # Written once: each block is a short scan of the queries alone.
    asked = materialise(quantised(vectors.filter(query), scale, id_col, vector_col).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    path, after = scratch_path(spark, "topk"), None
    while found := _block(asked, after, block):
        after = found[-1][0]
        for width in sorted({len(r[1]) for r in found}):
            some = [r for r in found if len(r[1]) == width]
            matrix = np.array([r[1] for r in some], np.float64).reshape(len(some), width)
            best = _search(rows, np.array([r[0] for r in some], np.int64), matrix, k, bins)
            best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    if after is None:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)
