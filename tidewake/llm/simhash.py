"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits: bit i is set where over half the XXH64 values of a
text's word shingles have it set.  Equal fingerprints are folded to one row
first, so copies cost nothing later.  The 64 bits are cut into five blocks; two
fingerprints at distance 3 or less agree on at least two whole blocks, so each
fingerprint is filed under its ten pairs of blocks and only fingerprints under
one key are compared, exactly, by Hamming distance.

A bucket need not give all its pairs: a search from one unvisited fingerprint
to the next, over the bucket, yields its components, and a link from each
member to the least one keeps them.  Buckets over ``BUCKET_ROWS`` are dealt by a salt into
parts, and each two parts meet in one task, so no task holds an unbounded
bucket and no pair is missed.  Components of the links follow by alternating
large-star and small-star rounds over tables in the shared folder.

Defined results: a null text is an empty one; texts without words have
fingerprint zero, which links like any other; fewer words than a shingle make
one shingle; repeated rows stay, with one component; null ids stay in the
result and never name a component of others; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, shared_dir, slices, text_of

SEED, DISTANCE = 42, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUCKET_ROWS = 4_096


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every word shingle, A-Z lower-cased, joined by single spaces."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    h = shingle_hashes(text, words)
    n, ones = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 18):
        part = np.ascontiguousarray(h[i : i + (1 << 18)].astype("<u8", copy=False))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the fingerprint as a signed long and the row's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "key_hash"])

    text = text_of(docs, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text, keys(docs, id_col, text_col)[1]).mapInArrow(run, "doc_id long, fp long, key_hash long")


def keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Rows that agree on these are copies under one id."""
    return row_key(F.col(id_col).cast("long"), text_of(docs, text_col))


def block_keys(fp):
    """The ten (pair of blocks, their bits) of a fingerprint, each packed in one long."""
    bits = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in BLOCKS]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return F.array(*(F.lit(n << 40).bitwiseOR(F.shiftleft(bits[i].cast("long"), 13)).bitwiseOR(bits[j]) for n, (i, j) in enumerate(pairs)))


def stars(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """(member, least member) of each component among ``a``, or of the links between ``a`` and ``b``.

    Breadth-first over what isn't visited yet: a dense bucket takes few steps.
    """
    nodes = a if b is None else np.concatenate([a, b])
    side = None if b is None else np.arange(len(nodes)) >= len(a)
    found: list[tuple[int, int]] = []
    todo = np.arange(len(nodes))
    while len(todo):
        group, todo = [int(todo[0])], todo[1:]
        for at in group:  # grows while it is walked
            if not len(todo):
                break
            near = np.bitwise_count((nodes[todo] ^ nodes[at]).view(np.uint64)) <= distance
            if side is not None:
                near &= side[todo] != side[at]
            if near.any():
                group += todo[near].tolist()
                todo = todo[~near]
        if len(group) > 1:
            members = nodes[group]
            root = int(members.min())
            found += [(int(x), root) for x in members if x != root]
    return found


def links(distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) with the components of all pairs within ``distance``; ``distinct`` has a column fp."""
    if distance > DISTANCE:
        raise ValueError(f"five blocks cover distances up to {DISTANCE}")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            left, right = b.column(0), b.column(1)
            for i in range(b.num_rows):
                x = np.asarray(left[i].values)
                y = np.asarray(right[i].values) if right[i].is_valid else None
                for u, v in stars(x, y, distance):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    filed = distinct.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp")
    sizes = filed.groupBy("key").count().filter("count > 1")
    common = filed.join(sizes.filter(F.col("count") <= bucket_rows).hint("merge"), "key").groupBy("key").agg(F.collect_list("fp").alias("a"))
    # Of a larger bucket, a row of part p goes to every cell (p, q) and (q, p).
    parts = F.ceil(F.col("count") / F.lit(bucket_rows)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
    hot = filed.join(sizes.filter(F.col("count") > bucket_rows).hint("merge"), "key").withColumn("parts", parts)
    dealt = hot.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).select("key", "fp", "p", F.explode(cells).alias("c"))
    dealt = dealt.select("key", "fp", "p", "c.i", "c.j").repartition("key", "i", "j")
    met = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.when(F.col("p") == F.col("i"), F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("p") != F.col("i"), F.col("fp"))).alias("b"))
    met = met.select("a", F.when(F.col("i") != F.col("j"), F.col("b")).alias("b"))
    return common.select("a", F.lit(None).cast("array<long>").alias("b")).unionByName(met).mapInArrow(within, "u long, v long")


def is_settled(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return open_.limit(1).count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` with the least node of each component, for the nodes of ``edges`` (u, v)."""
    shared_dir(edges.sparkSession)
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if is_settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(docs: DataFrame, words: int, distance: int, id_col: str, text_col: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and each distinct one's ``root`` (of its component) and ``least`` id."""
    rows = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp"), distance, bucket_rows))
    return rows, distinct.join(linked.hint("merge"), distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least id that links reach."""
    rows, named = grouped(docs, words, distance, id_col, text_col, bucket_rows)
    # A component's node of least fingerprint need not hold its least document.
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(names.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each component, its columns as they are: of the least id (null is the highest), of its texts the one of the least hash."""
    rows, named = grouped(docs, words, distance, id_col, text_col, bucket_rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key_hash"))
    of_print = rows.groupBy("fp").agg(F.min(rank).alias("first"))
    first = of_print.join(named.select("fp", "root").hint("merge"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    first = first.select(F.coalesce("first.doc_id", F.lit(-1)).alias("key_id"), F.col("first.key_hash").alias("key_hash"))
    names = [f"column {i}" for i in range(len(docs.columns))]  # clash with none of ours
    keyed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), *keys(docs, id_col, text_col))
    left = keyed.join(first.hint("merge"), ["key_id", "key_hash"], "left_semi").dropDuplicates(["key_id", "key_hash"])
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
