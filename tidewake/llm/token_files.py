"""Token-id files: Parquet with a list column, ordered by document id.

Format: one file a task, rows in ascending ``doc_id`` order within and across
files (``part`` numbers the files in that order).  ``tokens`` is a list of
32-bit ids, dictionary-encoded (``delta=True``: DELTA_BINARY_PACKED), in row
groups and pages of a given size with page indexes, so that readers fetch
single columns, row groups or pages.  ``local_start`` and ``n_tokens`` are
metadata columns: document offsets come from them without reading ids.

Texts of ASCII and Latin-1 letters, whose pre-tokens are plain, are merged by
rank; others go to the ``tokenizers`` library.  White space is no part of any
token of a word-end vocabulary, so the latter are cut at ASCII white space and
each distinct piece is encoded once per worker, into a bounded cache.  Tests
hold both ways against the library on whole texts.  An added token in a text
gives its own id, as in the library.

Defined results: a null text is empty (it gives its end id); null ids sort
first; repeated rows stay; an empty table writes no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, slices, text_of
from .vocab import added_tokens, around_added, encode_plain, from_word_end_json

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
CACHE_WORDS = 200_000


class WordEncoder:
    """Encodes by white-space-separated pieces; keeps at most ``CACHE_WORDS`` of them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path, self.ranks = path, from_word_end_json(path)
        self.added = [t.encode() for t in added_tokens(path)[1]]
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [self._around(t) if any(a in t for a in self.added) else encode_plain(self.ranks, t.decode("utf-8", "replace")) for t in texts]
        rest = iter(self._by_pieces([t for t, p in zip(texts, plain, strict=True) if p is None]))
        return [next(rest) if p is None else np.array(p, "<i4") for p in plain]

    def _around(self, text: bytes) -> list[int]:
        def between(part: str) -> list[int]:
            ids = encode_plain(self.ranks, part)
            return self._by_pieces([part.encode()])[0].tolist() if ids is None else ids

        return around_added(self.path, text.decode("utf-8", "replace"), between)

    def _by_pieces(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.known)) if words else []
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set().union(*words))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            for w, e in zip(part, got, strict=True):
                self.known[w] = np.array(e.ids, "<i4").tobytes()
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, ws)), "<i4") for ws in words]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, delta: bool = False) -> None:
    """Encodes every whole text and writes the files to ``path``.

    The texts are range-partitioned by id; a running number breaks ties, so
    rows that share an id still spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for b in slices(batches, "text", 4 << 20):
            ids = [np.concatenate([x, end]) for x in enc.encode(b.column(1).to_pylist())]
            n = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), list_array(ids, pa.int32())], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    writer = ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd")
    layout = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": str(not delta).lower(), "parquet.writer.version": "v2" if delta else "v1"}
    for k, v in layout.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """The documents with ``start``, the ids of all documents before each; ``tokens=False`` reads metadata columns only.

    The broadcast side has a row a file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", *(["tokens"] if tokens else []))


def digests(documents: DataFrame) -> DataFrame:
    """``ids_crc32`` over the ids as little-endian 32-bit integers."""
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(3)
            flat = np.asarray(col.values).astype("<u4", copy=False)
            at = np.asarray(col.offsets)
            crc = [crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
