"""Packing: concatenate and cut.

Pass one encodes each document, once, into a table in the shared folder and
keeps a running token count within each task.  Prefix sums over the tasks'
totals (a row a task) turn these into global offsets.  Pass two cuts the
tokens at the multiples of ``seq_len``; a document that crosses a cut gives
boundary records.  There is no shuffle of tokens, and only the last sequence
is short, so padding is below ``seq_len`` ids in total.

Ids are the library's: an added token in a text, such as an end mark, gives its
own id.

Defined results: a null text is an empty one (it gives its end id); a null
``doc_id`` stays null; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_of
from .vocab import around_added, encode_text, from_byte_level_json

ENCODED = "doc_id long, part int, local_start long, doc_tokens long, tokens binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary, continued boolean, continues boolean"


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its ids (little-endian 32-bit) with the end id, and the ids before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = from_byte_level_json(tokenizer), TaskContext.get().partitionId(), 0
        end = [end_id]
        for b in slices(batches, "text"):
            blobs, starts, counts = [], [], []
            for text in b.column(1).to_pylist():
                ids = np.array(around_added(tokenizer, text.decode("utf-8", "replace"), partial(encode_text, enc)) + end, "<u4")
                blobs.append(ids.tobytes())
                starts.append(at)
                counts.append(len(ids))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(blobs), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "part", "local_start", "doc_tokens", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col)).mapInArrow(run, ENCODED)


def with_offsets(encoded: DataFrame) -> DataFrame:
    """Adds ``global_start``, the ids before a document over all tasks.

    The broadcast side has a row a task of pass one (a few bytes each).
    """
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return encoded.join(F.broadcast(base), "part").withColumn("global_start", F.col("base") + F.col("local_start"))


def cut(placed: DataFrame, seq_len: int) -> DataFrame:
    """Pieces of documents by fixed windows over the global offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_(), pa.bool_()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens", "continued", "continues"]
        for b in slices(batches, "tokens"):
            rows = []
            for doc, at, n, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                start = 0
                while start < n:
                    seq, off = divmod(at + start, seq_len)
                    length = min(n - start, seq_len - off)
                    rows.append((doc, start, length, n, seq, off, blob[4 * start : 4 * (start + length)], start > 0, start + length < n))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return placed.select("doc_id", "global_start", "doc_tokens", "tokens").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), sequence and place in it."""
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
    return cut(with_offsets(materialise(encode(docs, tokenizer, end_id, id_col, text_col), "packing")), seq_len)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues")
