"""Byte-level BPE: overlapping chunk encoding, and decoding by joined bytes.

Texts up to ``chunk_chars`` are encoded where they are read.  Longer ones are
cut into chunks that overlap by ``overlap`` characters; the chunks are spread
over the cluster and pre-tokenised there.  The pattern looks ahead but never
back, so once two neighbouring chunks share a pre-token boundary they agree
from there on: that boundary becomes the stitch.  Each piece between stitches
is encoded by itself, and the pieces of a text are put together in order.
A text with no stitch in some overlap (say a run of letters longer than that)
is encoded whole.

Boundaries within ``MARGIN`` characters of a chunk's end aren't used (the
pattern looks at most three characters ahead), nor ones after white space (the
left piece would then end in a run that the pattern takes otherwise at an end).

Defined results: a null text is empty and has no ids; a null id stays null;
repeated rows are encoded as often as they occur; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, slices, text_of
from .vocab import PRE_TOKEN, encode_text, from_ranks

MARGIN = 16
CHUNK, OVERLAP = 32_768, 2_048


def boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Ends of pre-tokens in [lo, hi] that follow a visible character; 0 counts as one."""
    found = [0] if lo <= 0 else []
    for m in PRE_TOKEN.finditer(text):
        e = m.end()
        if e > hi:
            break
        if e >= lo and not text[e - 1].isspace():
            found.append(e)
    return found


def _ids(column: pa.Array, enc) -> list[np.ndarray]:
    return [np.array(encode_text(enc, t.decode("utf-8", "replace")), np.int32) for t in column.to_pylist()]


def _long(docs: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for key, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = raw.decode("utf-8", "replace")
                starts = range(0, max(1, len(text) - overlap), step)
                parts = [text[i : i + chunk].encode() for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["key", "doc_id", "k", "text"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            left, right = [], []
            for k, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = raw.decode()
                ends = boundaries(text, 0, len(text) - MARGIN)
                left.append(np.array([e + k * step for e in ends if e <= overlap], np.int64))
                right.append(np.array([e + k * step for e in ends if e >= step], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, list_array(left, pa.int64()), list_array(right, pa.int64())], names=["key", "doc_id", "k", "text", "left", "right"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks)
        for b in slices(batches, "text"):
            parts = []
            for k, raw, start, end in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                text = raw.decode()
                parts.append(text[start - k * step : None if end is None else end - k * step].encode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), list_array(_ids(pa.array(parts, pa.binary()), enc), pa.int32())], names=["key", "doc_id", "k", "ids"])

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(_ids(b.column(2), enc), pa.int32())], names=["key", "doc_id", "ids"])

    chunks = docs.mapInArrow(split, "key long, doc_id long, k int, text binary").repartition("key", "k")
    marked = chunks.mapInArrow(pre_tokenise, "key long, doc_id long, k int, text binary, left array<long>, right array<long>")
    order, whole = Window.partitionBy("key").orderBy("k"), Window.partitionBy("key")
    stitched = marked.withColumn("start", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("left", F.lag("right").over(order)))))
    stitched = stitched.withColumn("end", F.lead("start").over(order)).withColumn("torn", F.max(F.col("start").isNull()).over(whole))
    pieces = stitched.filter(~F.col("torn")).select("key", "doc_id", "k", "text", "start", "end").repartition("key", "k").mapInArrow(encode, "key long, doc_id long, k int, ids array<int>")
    joined = pieces.groupBy("key", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    own = F.expr(f"cast(substring(cast(text as string), 1, {step}) as binary)")
    last = F.max("k").over(whole)
    torn = stitched.withColumn("last", last).filter("torn").select("key", "doc_id", "k", F.when(F.col("k") == F.col("last"), F.col("text")).otherwise(own).alias("text"))
    rebuilt = torn.groupBy("key", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"].cast("string")), "").cast("binary").alias("text"))
    again = rebuilt.select("key", "doc_id", "text").mapInArrow(encode_whole, "key long, doc_id long, ids array<int>")
    return joined.select("doc_id", "ids").unionByName(again.select("doc_id", "ids"))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``ids array<int>`` for every row."""
    if chunk_chars <= 2 * overlap or overlap <= 2 * MARGIN:
        raise ValueError("chunk_chars must be over twice the overlap, which must be over twice the margin")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(_ids(b.column(1), enc), pa.int32())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col))
    n = F.length(F.col("text").cast("string"))
    fits = rows.filter(n <= chunk_chars).mapInArrow(short, "doc_id long, ids array<int>")
    over = rows.filter(n > chunk_chars).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return fits.unionByName(_long(over, ranks, chunk_chars, overlap))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``bytes``, the tokens' bytes joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks)
        for b in batches:
            ids = b.column(1)
            flat, at = np.asarray(ids.values), np.asarray(ids.offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([enc.decode_bytes(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
