"""Quality rules: word and line rules, and perplexity bands of a Kneser-Ney model.

The model is a character model of order 4 with modified Kneser-Ney smoothing
over all documents: each task counts n-grams of its texts, Spark adds them up,
and discounts, continuation counts and probabilities follow by DataFrame
operations.  Symbols are 12 bits (a code point below 1984 is one, any other a
lead and a trail, so none share), so an n-gram is one long, its context and its
suffix are shifts and masks of it.  It is stored as arrays of hashes in ascending order with an index on
their top bits; a shard has at most ``SHARD_ROWS`` entries (48 MB), and a model
of more entries is scored shard by shard: all entries that a position needs
share its last context symbol, by which shards are cut.

Beside it stands a word model of order 2, whose table grows with the corpus: the
word pairs of all documents.  Its symbols are the words that make up a share of
all words of at least one in ``VOCABULARY``; the others share one symbol, for
the character model rates their spelling.  So the vocabulary has a proven bound
and is broadcast, with each word's totals; the pairs, which have none, are not.
Each chunk of documents sends its pairs, as sorted packed arrays, to the buckets
of their hashes, which add them up and answer with the counts (the chunk's
arrays, packed again).  Nearly every pair is rare, and a document would know its
own, so each is scored by what the others hold: its own occurrences are taken
from the counts of its pairs and of their first words (the weight of the lower
order, at most 1, keeps the first word's discounts of all documents).

A document's figures are its mean negative log-probabilities (the logs of its
perplexity) a character of its words and a word, and of its word pairs.  Each language has an upper and
a lower band of both around the median of its documents: ``width`` robust
deviations, which shrink with the root of the length, and ``ALLOW`` nats for one
odd item, such as a number of 16 digits.  Documents outside one of them are
rejected.  Symbols after words are cheap a character, since the model has seen
them, and dear a word.  Word pairs have an upper band only, for copies are
cheap and no junk.  Medians come from exact histograms on fine grids.

Defined results: null and empty texts have no words, fail the base rules and
take no part in the bands; a null language is one of its own; repeated rows
count as often as they occur; an empty table gives no rows; other columns are
not read (``without_rejected`` passes them on).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, row_key, slices, text_of

ORDER, SYMBOL_BITS, BOS = 4, 12, 1
SYMBOLS = 1 << SYMBOL_BITS
#: Code points below LEAD are a symbol; of others the lead holds all but the last ten bits, the trail those.
LEAD, TRAIL = 1984, 3072
SHARD_ROWS = 4_000_000
#: Languages up to which their bands are broadcast (16 bytes and a name each).
BROADCAST_ROWS = 100_000
#: Bytes of text handled at once, and n-grams a task holds before it merges them.
SLICE, MERGE_AT = 1 << 20, 2_000_000
#: The word model: the share of all words that makes a symbol, ids of the others and of a text's start; words of a chunk,
#: pairs of a bucket.
VOCABULARY, ID_BITS, RARE, START = 1 << 21, 22, 0, 1
CHUNK_WORDS, BUCKET_PAIRS = 1_000_000, 2_000_000
ALLOW = 40.0


class Measure(NamedTuple):
    """Perplexity a unit: the units' column, the results' prefix, the bands' width in robust deviations, units from which bands shrink no more, the medians' grids."""

    per: str
    prefix: str
    width: float
    full: int
    grid: float
    deviation_grid: float
    nll: str = "nll"
    lower: bool = True

    def value(self) -> Column:
        return F.try_divide(self.nll, self.per)

    def root(self) -> Column:
        return F.sqrt(F.least(F.greatest(self.per, F.lit(1)), F.lit(self.full)))


#: A character, bands are wider: texts with lines in another language pass.
MEASURES = (Measure("word_chars", "", 5.0, 8_000, 5e-4, 1e-2), Measure("n_words", "word_", 4.0, 1_500, 5e-3, 5e-2), Measure("n_pairs", "pair_", 4.0, 1_500, 5e-3, 5e-2, "pair_nll", False))
#: The characters that count as symbols.
SYMBOL_CHARS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word's hash is the sum of its bytes' numbers, each times a power of the (odd) step; words part at white space.
_STEP, _BYTES = np.uint64(0xD1342543DE82EF93), np.frombuffer(b"".join(blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8")
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def joined(text: bytes) -> bytes:
    """The words, joined by single spaces; no byte of it is the start symbol."""
    return b" ".join(text.split()).replace(b"\x01", b"\x02").replace(b"\x00", b"\x02")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of the joined texts, and the text's number."""
    pad = b"\x01" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    s = codes.astype(np.int64)
    if len(two := np.flatnonzero(codes >= LEAD)):
        trail = TRAIL + (s[two] & 1023)
        s[two] = LEAD + (s[two] >> 10)
        s = np.insert(s, two + 1, trail)
    key = s.copy()
    for j in range(1, ORDER):
        key[j:] |= s[:-j] << (SYMBOL_BITS * j)
    real = s != BOS
    # Each text follows ORDER - 1 start symbols.
    doc = np.cumsum((s == BOS))[real] // (ORDER - 1) - 1
    return key[real], doc


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    both, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, where = np.unique(both, return_inverse=True)
    return keys, np.bincount(where, counts, minlength=len(keys)).astype(np.int64)


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``kind, key, n``: occurrences of each n-gram of characters (kind 0) and of each word (kind 1) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def out(kind: int, part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *map(pa.array, part)], names=["kind", "key", "n"])

        for b in slices(batches, "text", SLICE):
            texts = b.column(0).to_pylist()
            for kind, keys in enumerate((grams([joined(t) for t in texts])[0], word_hashes(texts)[0])):
                held[kind].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[kind]) > MERGE_AT:
                    held[kind][:] = [merged(held[kind])]
                    if len(held[kind][0][0]) > MERGE_AT // 2:
                        yield out(kind, held[kind].pop())
        for kind in (0, 1):
            if held[kind]:
                yield out(kind, merged(held[kind]))

    return docs.select(text_of(docs, text_col)).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def model_table(counts: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """``kind, key, value``: kind n > 0 has log-probabilities of n-grams, kind -n log-weights of contexts of n symbols.

    Orders below the highest count distinct left neighbours.
    """
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        longer = levels[n + 1]
        levels[n] = longer.groupBy(F.col("key").bitwiseAND((1 << SYMBOL_BITS * n) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out, lower = None, None
    for n in range(1, ORDER + 1):
        rows = levels[n].withColumn("context", F.shiftright("key", SYMBOL_BITS)).withColumn("suffix", F.col("key").bitwiseAND((1 << SYMBOL_BITS * (n - 1)) - 1))
        rows = rows.crossJoin(F.broadcast(discounts(rows))).withColumn("d", discount(F.col("n")))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed")).withColumn("weight", F.col("freed") / F.col("total"))
        rows = rows.join(sums, "context")
        below = F.lit(1.0 / SYMBOLS) if lower is None else F.col("p_lower")
        if lower is not None:
            rows = rows.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("p_lower")), "suffix")
        rows = rows.select("key", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * below).alias("p"))
        rows = keep(rows, f"model{n}")
        lower = rows
        part = rows.select(F.lit(n).cast("int").alias("kind"), "key", F.log("p").cast("float").alias("value"))
        part = part.unionByName(sums.select(F.lit(1 - n).cast("int").alias("kind"), F.col("context").alias("key"), F.log("weight").cast("float").alias("value")))
        out = part if out is None else out.unionByName(part)
    return out


class HashArrays:
    """Values by 64-bit hashes in ascending order, found through an index on the hashes' top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        h = keys.astype(np.uint64) * _MIX
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key isn't held."""
        out = np.full(len(keys), np.nan)
        if not len(self.hashes):
            return out
        h = keys.astype(np.uint64) * _MIX
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < len(self.hashes)]
            here = self.hashes[at[open_]]
            hit = open_[here == h[open_]]
            out[hit] = self.values[at[hit]]
            open_ = open_[here < h[open_]]
            at[open_] += 1
        return out


class Shard:
    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables = {int(k): HashArrays(keys[kinds == k], values[kinds == k]) for k in np.unique(kinds)}

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """By the longest n-gram that was seen; the weights of longer contexts that were seen multiply in."""
        out, added = np.full(len(keys), np.nan), np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            if not len(open_):
                return out
            part = keys[open_] & ((1 << SYMBOL_BITS * n) - 1)
            got = self.tables[n].find(part) if n in self.tables else np.full(len(part), np.nan)
            out[open_] = got + added[open_]
            miss = np.isnan(got)
            open_ = open_[miss]
            weight = self.tables[1 - n].find(part[miss] >> SYMBOL_BITS) if 1 - n in self.tables else np.zeros(len(open_))
            added[open_] += np.nan_to_num(weight)
        out[open_] = added[open_] - np.log(SYMBOLS)
        return out


def shards(table: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[tuple[int, int, Shard]]:
    """(number of shards, which, its arrays): at most about ``shard_rows`` entries reach the driver at once."""
    n = max(1, -(-table.count() // shard_rows))
    last = F.when(F.col("kind") > 0, F.shiftright("key", SYMBOL_BITS)).otherwise(F.col("key")).bitwiseAND(SYMBOLS - 1)
    for i in range(n):
        rows = table if n == 1 else table.filter((F.abs("kind") <= 1) & (F.col("kind") >= 0) | (F.pmod(last, F.lit(n)) == i))
        got = rows.toArrow()
        yield n, i, Shard(*(got[c].to_numpy() for c in ("kind", "key", "value")))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the texts' words, the same in every process, and each text's number of words."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[buffer]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begin, length = edges[::2], edges[1::2] - edges[::2]
    body, at = buffer[inside], np.cumsum(length) - length
    power = np.cumprod(np.full(length.max(initial=0), _STEP))
    hashes = np.add.reduceat(_BYTES[body] * power[np.arange(len(body)) - np.repeat(at, length)], at) if len(at) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return hashes.view(np.int64), np.diff(np.searchsorted(begin, ends), prepend=0)


def repeat_words(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words in 3-word windows that occur twice or more in their text; equality by 64-bit hashes."""
    h, doc = hashes.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    if len(h) < 3:
        return np.zeros(len(sizes), np.int64)
    window = (h[:-2] * _MIX ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:] * np.uint64(0x165667B19E3779F9) ^ doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = doc[:-2] == doc[2:]
    order = np.sort(window[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(h), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
        found = np.flatnonzero(whole & (twice[at] == window))
        for j in range(3):
            covered[found + j] = True
    return np.bincount(doc, covered, minlength=len(sizes)).astype(np.int64)


def vocabulary(words: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the words with a share of at least one in ``size`` and two occurrences, the most frequent first: ``size`` at most."""
    total = words.agg(F.sum("n")).first()[0] or 0
    got = words.filter(F.col("n") >= max(2, -(-total // size))).select("key", "n").toArrow()
    key, n = (got[c].to_numpy() for c in ("key", "n"))
    return key[np.lexsort((key, -n))]


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers from 0 (ascending: their differences) by planes of bytes, compressed."""
    x = x.astype("<u8")
    if ascending:
        x = np.diff(x, prepend=np.uint64(0))
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    body = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return planes.to_bytes(1, "little") + len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpacked(blob: bytes, ascending: bool = False) -> np.ndarray:
    planes, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :planes] = np.frombuffer(pa.Codec("zstd").decompress(blob[9:], planes * n, asbytes=True), np.uint8).reshape(planes, n).T
    x = out.view("<u8").ravel().astype(np.int64)
    return np.cumsum(x) if ascending else x


def pair_keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pair that ends at each word: the word before (``START`` at a text's first) above the word."""
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return context << ID_BITS | words


def dealt(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket that keeps theirs within one, and where each bucket begins."""
    bucket = (keys.view(np.uint64) * _MIX >> np.uint64(32)).astype(np.int64) % n_buckets
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(n_buckets + 1))


ANSWERS = "chunk long, bucket int, n binary, word long, total long, n1 long, n2 long, n3 long, before long, t1 long, t2 long, t3 long, t4 long"


def answers(chunked: DataFrame, n_buckets: int) -> DataFrame:
    """What the buckets of pairs tell: counts for each chunk, in its order; of each word (by its id) the pairs it begins by count, and ends; the counts of counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, sizes, words = b.column(0)[i].as_py(), unpacked(b.column(1)[i].as_py()), unpacked(b.column(2)[i].as_py())
                keys, n = np.unique(pair_keys(words, sizes), return_counts=True)
                order, at = dealt(keys, n_buckets)
                keys, n = keys[order], n[order]
                for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if lo < hi:
                        yield pa.RecordBatch.from_pylist([{"bucket": k, "chunk": chunk, "keys": packed(keys[lo:hi], True), "n": packed(n[lo:hi])}], pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())]))

    def add(sent: pa.Table) -> pa.Table:
        keys, counts = ([unpacked(x, up) for x in sent[c].to_pylist()] for c, up in (("keys", True), ("n", False)))
        each = np.cumsum([len(k) for k in keys])[:-1]
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        context, word = keys >> ID_BITS, keys & (1 << ID_BITS) - 1
        ids, at = np.unique(np.concatenate([context, word]), return_inverse=True)
        first, second = at[: len(keys)], at[len(keys) :]
        of = lambda x, by: np.bincount(x, by, minlength=len(ids)).astype(np.int64)
        stats = [ids, of(first, n), of(first, n == 1), of(first, n == 2), of(first, n > 2), of(second, None)]
        empty = lambda kind, rows: pa.nulls(rows, kind)
        replies = [packed(x) for x in np.split(n[where], each)]
        parts = [
            [sent["chunk"].combine_chunks(), sent["bucket"].combine_chunks(), pa.array(replies, pa.binary()), *(empty(pa.int64(), len(replies)) for _ in range(10))],
            [empty(pa.int64(), len(ids)), empty(pa.int32(), len(ids)), empty(pa.binary(), len(ids)), *map(pa.array, stats), *(empty(pa.int64(), len(ids)) for _ in range(4))],
            [empty(pa.int64(), 1), empty(pa.int32(), 1), empty(pa.binary(), 1), *(empty(pa.int64(), 1) for _ in range(6)), *(pa.array([int((n == i).sum())]) for i in (1, 2, 3, 4))],
        ]
        names = [f.split()[0] for f in ANSWERS.split(", ")]
        return pa.concat_tables([pa.table(dict(zip(names, p, strict=True))) for p in parts])

    pairs = chunked.select("chunk", "sizes", "words").mapInArrow(send, "bucket int, chunk long, keys binary, n binary")
    return pairs.groupBy("bucket").applyInArrow(add, ANSWERS)


class PairModel(NamedTuple):
    """Each word's totals by its id, the pairs' discounts and how many pairs differ."""

    total: np.ndarray
    freed: np.ndarray
    before: np.ndarray
    discounts: np.ndarray
    types: int

    def nats(self, keys: np.ndarray, n: np.ndarray, own: np.ndarray, own_context: np.ndarray) -> np.ndarray:
        """-log p of pairs that stand ``n`` times in all texts, ``own`` times in the scored one."""
        context, others = keys >> ID_BITS, n - own
        rest = self.total[context] - own_context
        high = np.where(others > 0, (others - self.discounts[np.minimum(others, 3)]) / np.maximum(rest, 1), 0.0)
        weight = np.where(rest > 0, np.minimum(self.freed[context] / np.maximum(rest, 1), 1.0), 1.0)
        return -np.log(high + weight * self.before[keys & (1 << ID_BITS) - 1] / self.types)


def pair_model(found: DataFrame, n_ids: int) -> PairModel:
    """From the buckets' answers; one row a word of the bounded vocabulary reaches the driver."""
    t = [x or 0 for x in found.filter("t1 is not null").agg(*(F.sum(f"t{i}") for i in (1, 2, 3, 4))).first()]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.5
    d = np.array([0.0, *(min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3))])
    rows = found.filter("word is not null").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "before"))).toArrow()
    at = rows["word"].to_numpy()
    columns = {}
    for c in ("total", "n1", "n2", "n3", "before"):
        columns[c] = np.zeros(n_ids, np.int64)
        columns[c][at] = rows[c].to_numpy()
    freed = d[1] * columns["n1"] + d[2] * columns["n2"] + d[3] * columns["n3"]
    return PairModel(columns["total"], freed, columns["before"], d, max(1, int(columns["before"].sum())))


def document_nats(words: np.ndarray, sizes: np.ndarray, n: np.ndarray, n_buckets: int, model: PairModel) -> np.ndarray:
    """Each text's nats; ``n`` are the counts of the chunk's pairs, bucket by bucket."""
    keys, at = np.unique(pair_keys(words, sizes), return_inverse=True)
    counts = np.empty(len(keys), np.int64)
    counts[dealt(keys, n_buckets)[0]] = n
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pair, own = np.unique(doc * len(keys) + at, return_counts=True)
    doc, at = np.divmod(pair, max(len(keys), 1))
    starts = np.flatnonzero(np.diff(doc * (1 << ID_BITS) + (keys[at] >> ID_BITS), prepend=-1))
    own_context = np.repeat(np.add.reduceat(own, starts), np.diff(np.append(starts, len(at)))) if len(at) else own
    # Summed as whole millionths: no order of the rows changes a verdict.
    return np.bincount(doc, np.rint(1e6 * own * model.nats(keys[at], counts[at], own, own_context)), minlength=len(sizes)) / 1e6


def discounts(rows: DataFrame) -> DataFrame:
    """``d1, d2, d3`` by the numbers of n-grams that occur once to four times; each stays within [0.1, i - 0.1], so that no seen n-gram loses all and contexts keep some weight."""
    t = [F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(t[0], t[0] + 2 * t[1]), F.lit(0.5))
    d = [F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(t[i], t[i - 1]), F.lit(0.5)), F.lit(0.1)), F.lit(i - 0.1)) for i in (1, 2, 3)]
    return rows.agg(*(x.alias(f"d{i}") for i, x in enumerate(d, 1)))


def discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


FIGURES = "row long, doc_id long, lang string, key_id long, key_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, nll double"
CHUNKS = "chunk long, n_pairs long, docs binary, sizes binary, words binary"


def character_nll(texts: list[bytes], shard: Shard, n_shards: int = 1, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each text's characters, and the part of its negative log-probability that the shard holds."""
    key, doc = grams([joined(t) for t in texts])
    n_chars = np.bincount(doc[(key & (SYMBOLS - 1)) < TRAIL], minlength=len(texts))
    if n_shards > 1:
        own = (key >> SYMBOL_BITS & (SYMBOLS - 1)) % n_shards == which
        key, doc = key[own], doc[own]
    pair, times = np.unique(key << 16 | doc, return_counts=True)
    keys, at = np.unique(pair >> 16, return_inverse=True)
    value = shard.log_probabilities(keys)[at]
    return n_chars, -np.bincount(pair & 0xFFFF, times * value, minlength=len(texts))


def base_figures(texts: list[bytes], hashes: np.ndarray, n_words: np.ndarray, n_chars: np.ndarray) -> list:
    lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] for t in texts]
    symbols = [sum(t.count(SYMBOL_CHARS[i : i + 1]) for i in range(len(SYMBOL_CHARS))) for t in texts]
    return [n_words, np.maximum(n_chars - np.maximum(n_words - 1, 0), 0), symbols, [len(x) - len(set(x)) for x in lines], repeat_words(hashes, n_words), n_chars]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes and rows."""
    for big in slices(batches, "text", SLICE):
        yield from (big.slice(i, 1 << 15) for i in range(0, big.num_rows, 1 << 15))


def chunks(rows: DataFrame, part: tuple[int, int, Shard], known: np.ndarray) -> DataFrame:
    """Chunks of about ``CHUNK_WORDS`` words: the documents' figures, their numbers of words and the words' ids."""
    n_shards, which, _ = part
    sent = rows.sparkSession.sparkContext.broadcast((part[2], HashArrays(known, np.arange(2, 2 + len(known)))))
    names = [f.split()[0] for f in FIGURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = sent.value
        docs, found, chunk = [], [], TaskContext.get().partitionId() << 33

        def out() -> pa.RecordBatch:
            batch = pa.Table.from_batches(docs).combine_chunks().to_batches()[0]
            sizes, words = batch.column("n_words").to_numpy(), np.concatenate(found)
            row = {"chunk": chunk, "n_pairs": len(np.unique(pair_keys(words, sizes))), "docs": ipc(batch), "sizes": packed(sizes), "words": packed(words)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("n_pairs", pa.int64()), *((c, pa.binary()) for c in ("docs", "sizes", "words"))]))

        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            hashes, n_words = word_hashes(texts)
            n_chars, nll = character_nll(texts, shard, n_shards, which)
            cols = base_figures(texts, hashes, n_words, n_chars)
            docs.append(pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), *(pa.array(c, pa.int64()) for c in cols), pa.array(nll, pa.float64())], names=names))
            found.append(np.nan_to_num(ids.find(hashes), nan=RARE).astype(np.int64))
            if sum(map(len, found)) >= CHUNK_WORDS or sum(d.num_rows for d in docs) >= CHUNK_WORDS:
                yield out()
                docs, found, chunk = [], [], chunk + 1
        if docs:
            yield out()

    return rows.mapInArrow(run, CHUNKS)


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def scored(chunked: DataFrame, found: DataFrame, n_buckets: int, model: PairModel) -> DataFrame:
    """``FIGURES`` and ``pair_nll`` of every document: each chunk meets its answers."""
    sent = chunked.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.Table) -> pa.Table:
        own = rows.filter(pa.compute.equal(rows["bucket"], -1)).to_pylist()[0]
        replies = rows.filter(pa.compute.greater_equal(rows["bucket"], 0)).sort_by("bucket")["a"].to_pylist()
        n = np.concatenate([unpacked(x) for x in replies]) if replies else np.zeros(0, np.int64)
        nats = document_nats(unpacked(own["c"]), unpacked(own["b"]), n, n_buckets, sent.value)
        return pa.ipc.open_stream(own["a"]).read_all().append_column("pair_nll", pa.array(nats, pa.float64()))

    docs = chunked.select("chunk", F.lit(-1).alias("bucket"), F.col("docs").alias("a"), F.col("sizes").alias("b"), F.col("words").alias("c"))
    replies = found.filter("chunk is not null").select("chunk", "bucket", F.col("n").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))
    return docs.unionByName(replies).groupBy("chunk").applyInArrow(run, FIGURES + ", pair_nll double")


def shard_nll(rows: DataFrame, part: tuple[int, int, Shard]) -> DataFrame:
    """``row, more``: a further shard's part of each text's negative log-probability."""
    n_shards, which, _ = part
    sent = rows.sparkSession.sparkContext.broadcast(part[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            nll = character_nll(b.column(1).to_pylist(), sent.value, n_shards, which)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nll, pa.float64())], names=["row", "more"])

    return rows.select("row", "text").mapInArrow(run, "row long, more double")


def language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")


def keys(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[Column]:
    """Rows that agree on these have the same verdict."""
    return row_key(F.col(id_col).cast("long"), language(lang_col), text_of(docs, text_col))


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, shard_rows: int, bucket_pairs: int) -> DataFrame:
    """Base figures, ``nll`` and ``pair_nll`` of every row, written."""
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.materialise(counted(docs, text_col), "counts")
        table = scratch.materialise(model_table(counts.filter("kind = 0").drop("kind"), scratch.materialise), "model")
        known = vocabulary(counts.filter("kind = 1"))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), language(lang_col), *keys(docs, id_col, text_col, lang_col), text_of(docs, text_col))
        parts = shards(table, shard_rows)
        first = next(parts)
        if first[0] > 1:  # rows are numbered once, for all shards
            rows = scratch.materialise(rows, "rows")
        chunked = scratch.materialise(chunks(rows, first, known), "chunks", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
        more = [scratch.materialise(shard_nll(rows, p), "shard") for p in parts]
        n_buckets = max(1, -(-(chunked.agg(F.sum("n_pairs")).first()[0] or 0) // bucket_pairs))
        found = scratch.materialise(answers(chunked, n_buckets), "pairs")
        out = scored(chunked, found, n_buckets, pair_model(found, len(known) + 2))
        if more:
            rest = more[0]
            for m in more[1:]:
                rest = rest.unionByName(m)
            out = out.join(rest.groupBy("row").agg(F.sum("more").alias("more")), "row").withColumn("nll", F.col("nll") + F.col("more")).drop("more")
        return materialise(out, "scored")


def middle(rows: DataFrame, bin_: Column, name: str) -> DataFrame:
    """The (lower) median of ``bin_`` by language and measure; a task holds one language's grid, not its rows."""
    bins = rows.select("lang", "per", F.round(bin_).cast("long").alias("bin")).groupBy("lang", "per", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang", "per")
    upto = F.sum("n").over(w.orderBy("bin"))
    return bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).filter(2 * F.col("upto") >= F.col("all")).groupBy("lang", "per").agg(F.min("bin").alias(name))


def sized(by_language: DataFrame, name: str) -> DataFrame:
    """The rows of languages, written; broadcast while they are few, else for a merge join, whose hot keys can be split."""
    rows = materialise(by_language, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", measures: tuple[Measure, ...] = MEASURES, allow: float = ALLOW, shard_rows: int = SHARD_ROWS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Base figures, ``base_failed``, both perplexities, its language's bands and ``kept`` for every row."""
    found = measured(docs, id_col, text_col, lang_col, shard_rows, bucket_pairs).withColumn("n_pairs", F.col("n_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumns({m.prefix + "log_perplexity": m.value() for m in measures})
    sound = found.filter(~F.col("base_failed") & F.col("nll").isNotNull() & (F.col("word_chars") > 0))
    each = F.array(*(F.struct(F.lit(m.per).alias("per"), (m.value() / m.grid).alias("steps"), (m.root() * (m.grid / m.deviation_grid)).alias("scale")) for m in measures))
    each_measure = sound.select("lang", F.explode(each).alias("m")).select("lang", "m.*")
    centre = sized(middle(each_measure, F.col("steps"), "centre"), "centres")
    spread = middle(each_measure.join(centre, ["lang", "per"]), F.abs(F.col("steps") - F.col("centre")) * F.col("scale"), "spread")
    of = lambda c, m: F.max(F.when(F.col("per") == m.per, F.col(c))).alias(f"{c}_{m.per}")
    bands = sized(centre.join(spread, ["lang", "per"]).groupBy("lang").agg(*(of(c, m) for m in measures for c in ("centre", "spread"))), "bands")
    banded, inside = found.join(bands, "lang", "left"), ~F.col("base_failed")
    for m in measures:
        middle_, least = F.col(f"centre_{m.per}") * m.grid, sqrt(m.full) * m.grid
        half = F.lit(m.width * 1.4826) * F.greatest(F.col(f"spread_{m.per}") * m.deviation_grid, F.lit(least)) / m.root() + F.lit(allow) / F.greatest(m.per, F.lit(1))
        banded = banded.withColumns({m.prefix + "lower": middle_ - half, m.prefix + "upper": middle_ + half})
        least_ = F.col(m.prefix + "lower") if m.lower else F.lit(float("-inf"))
        inside &= F.coalesce(F.col(m.prefix + "log_perplexity").between(least_, F.col(m.prefix + "upper")), F.lit(False))
    return banded.withColumn("kept", inside).drop("row", "nll", "pair_nll", "n_pairs", *(f"{c}_{m.per}" for m in measures for c in ("centre", "spread")))


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: object) -> DataFrame:
    """The rows that are kept, with their columns as they are.  Each is judged by its own text, whatever else has its id."""
    kept = judge(docs, id_col, text_col, lang_col, **limits).filter("kept").select("key_id", "key_hash")
    names = [f"column {i}" for i in range(len(docs.columns))]  # clash with none of ours
    keyed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), *keys(docs, id_col, text_col, lang_col))
    left = keyed.join(kept.hint("merge"), ["key_id", "key_hash"], "left_semi")
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
