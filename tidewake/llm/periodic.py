"""Periodic runs of words: bit-parallel lags over big-integer bit planes.

The words of a text are numbered by frequency, and bit k of all their numbers
makes plane k, one big integer with a bit a word.  For a lag q each plane is
XORed with itself shifted by q; the OR of these marks the words that differ
from the one q later.  A stretch of m matches in a row is isolated by ANDing
the matches with themselves shifted by 1, 2, 4, ... places, m in all.  A
maximal stretch with ``exponent`` q words or more, q included, is a run of
period q, unless a shorter period gave the same words.

A lag of 64 or more is looked at only where a run of it can lie: lags from w to
2w - 1 (w a power of two) need some w words from a multiple of w that stand
again a lag later, which sorted hashes of w words tell.  Repeats within a run
that is known already, and long enough to hold every longer run of its words,
are passed over.  A hash tells where to look and never decides, so nothing is
lost, and a text takes about n log n steps and a plane's length a lag looked at.

Words are what lies between ASCII white space, compared byte by byte.

Defined results: a null text has no words; a text without runs has
``n_runs`` 0, nulls for the longest run and all its words; a null id stays
null; repeated rows stay; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

#: A run has this many words at least, and this many times its period.
LEAST, EXPONENT = 6, 4
#: Lags from here on are narrowed by repeated stretches; a power of two.
NARROWED = 64


class Run(NamedTuple):
    start: int
    length: int
    period: int


def planes(numbers: np.ndarray) -> list[int]:
    """Bit k of every number as one big integer, word i at bit i."""
    top = int(numbers.max()).bit_length() if len(numbers) else 0
    return [int.from_bytes(np.packbits((numbers >> k) & 1, bitorder="little").tobytes(), "little") for k in range(top)]


def stretches(bits: int, m: int) -> int:
    """The places from which ``m`` ones or more follow, by ANDs over doubling shifts."""
    have = 1
    while bits and have < m:
        step = min(have, m - have)
        bits &= bits >> step
        have += step
    return bits


def places(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def runs_of_lag(given: Sequence[int], n: int, q: int, least: int, exponent: int) -> list[Run]:
    """Maximal stretches of period q (it need not be their smallest)."""
    m = max(least, exponent * q) - q
    room = (1 << (n - q)) - 1
    left = stretches(room, m)
    differ = 0
    for plane in given:
        differ |= (plane ^ (plane >> q)) & room
        left &= stretches(room ^ differ, m)
        if not left:
            return []
    first, last = places(left & ~(left << 1)), places(left & ~(left >> 1))
    return [Run(int(a), int(b - a) + m + q, q) for a, b in zip(first, last, strict=True)]


def repeated_lags(hashes: np.ndarray, w: int, n: int, top: int, known: Sequence[Run]) -> list[int]:
    """Lags from ``w`` to ``top`` at which the w words from some multiple of w stand again.

    ``hashes`` has one of each w words in a row.  A lag is passed over where a
    known run of period p holds p + lag words from there on: a longer run there
    would share them, so its period would be a multiple of p and no smallest one.
    """
    held = np.zeros(n + 1, np.int64)
    for r in known:
        upto = np.arange(r.start, r.start + r.length - r.period)
        held[upto] = np.maximum(held[upto], r.start + r.length - r.period - upto)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = np.arange(0, len(hashes), w)
    at = at[held[at] < top]
    found: list[np.ndarray] = []
    step = place[at]
    live = np.ones(len(at), bool)
    # Equal stretches lie side by side in order of place, so the next ones are met one after the other.
    while live.any():
        step = step + 1
        live &= step < len(order)
        at, step = at[live], step[live]
        nxt = order[step]
        lag = nxt - at
        live = (ranked[step] == hashes[at]) & (lag <= top)
        found.append(lag[live & (lag >= w) & (lag > held[at])])
    return np.unique(np.concatenate(found)).tolist() if found else []


def runs(numbers: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of a sequence of word numbers, by start and period.

    ``exponent`` is three or more: then a stretch with a smaller period, too, is that
    period's run, and a run holds w words from a multiple of w twice, for w up to its period.
    """
    if exponent < 3 or least < 1:
        raise ValueError("exponent must be 3 or more, and least 1 or more")
    n, found = len(numbers), {}
    given, most = planes(numbers), len(numbers) // exponent

    def look(q: int) -> None:
        for r in runs_of_lag(given, n, q, least, exponent):
            found.setdefault((r.start, r.length), r)

    for q in range(1, min(NARROWED - 1, most) + 1):
        look(q)
    if most >= NARROWED:
        with np.errstate(over="ignore"):
            hashes, w = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
            while w <= most:
                if w >= NARROWED:
                    for q in repeated_lags(hashes, w, n, min(2 * w - 1, most), list(found.values())):
                        look(q)
                odd = np.uint64(0xD6E8FEB86659FD93)
                pair = (hashes[:-w] ^ (hashes[:-w] >> np.uint64(32))) * odd + hashes[w:]
                hashes, w = pair ^ (pair >> np.uint64(29)), 2 * w
    return sorted(found.values(), key=lambda r: (r.start, r.period))


def kept(n: int, found: Sequence[Run]) -> np.ndarray:
    """Which words stay: not those after a run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in found:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """A number a word, the most frequent 0, so that the low planes tell most words apart."""
    rank = {w: i for i, (w, _) in enumerate(Counter(words).most_common())}
    return np.fromiter((rank[w] for w in words), np.int64, len(words))


def repeating(words: list[bytes], a: int, p: int) -> list[bytes]:
    """The words from ``a`` on replaced by the first ``p`` of them, over and over."""
    block, rest = words[a : a + p], len(words) - a
    return words[:a] + (block * (rest // p + 1))[:rest]


FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, seed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its runs by start and period, and its text without the words that repeat.

    ``seed`` plants a run for trials: where its value h (null: none) is divisible
    by 10, the words from g % n on repeat with the period
    1 + (n - a) // (3 + g % 8), with g = h // 10 and a = g % n.
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, lists, texts = [], [], []
            for text, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if n and h is not None and h % 10 == 0:
                    g = h // 10
                    words = repeating(words, g % n, 1 + (n - g % n) // (3 + g % 8))
                rows = runs(numbered(words), least, exponent)
                stay = kept(n, rows)
                counts.append(n)
                lists.append([r._asdict() for r in rows])
                texts.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(struct)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    planted = (F.lit(None) if seed is None else seed).cast("long").alias("seed")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col), planted).mapInArrow(run, FOUND)


def without_repeats(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text with each run cut to its first period."""
    return find(docs, least, exponent, None, id_col, text_col).select("doc_id", F.col("collapsed").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the words that stay."""
    first = F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))))[0]
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")
    rows = found.withColumn("first", F.when(F.size("runs") > 0, first))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("first.start").alias("start"),
        (-F.col("first.length")).alias("length"),
        F.col("first.period").alias("period"),
        F.expr("1000 * -first.length div first.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def oracle() -> str:
    """The contract's digests in SQL: all equal words at most n / 4 apart, their stretches, and the smallest period of each."""
    return r"""
with docs as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as raw from documents),
hashed as (
  select r, doc_id, raw, len(raw) as n, case when doc_id is not null then xor(list_reduce(
    flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0])),
    lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1)), 4294967295), 4294967295) end as h from docs),
planted as (
  select r, doc_id, raw, n, h % 10 = 0 and n > 0 as does, (h // 10) % greatest(n, 1) as a, 3 + (h // 10) % 8 as parts from hashed),
texts as materialized (
  select r, doc_id, n, case when does then list_transform(range(n), lambda i: raw[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // parts) end]) else raw end as w from planted),
words as materialized (select r, n, unnest(w) as word, unnest(range(n)) as i from texts),
pairs as (
  select x.r, y.i - x.i as q, x.i from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs),
stretches as (
  select r, min(i) as start, count(*) + q as length, q from islands group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select r, start, length, min(q) as period from stretches group by r, start, length),
covers as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
stay as (
  select w.r, string_agg(w.word, ' ' order by w.i) as collapsed from words w anti join covers c on w.r = c.r and w.i = c.i group by w.r),
digest as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    min({'less': -length, 'start': start, 'period': period}) as top from runs group by r)
select t.doc_id, coalesce(d.n_runs, 0) as n_runs, d.top.start as start, -d.top.less as length, d.top.period as period,
  1000 * -d.top.less // d.top.period as exponent_milli, sha256(coalesce(d.lines, '')) as runs_sha256,
  sha256(coalesce(s.collapsed, '')) as collapsed_sha256, t.n as n_words
from texts t left join digest d on t.r = d.r left join stay s on t.r = s.r"""
