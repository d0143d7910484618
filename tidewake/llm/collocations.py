"""Collocations: frequent phrases of a language, by count-min sketches and an exact second pass.

Sketches: each task files n-grams under a cell of each of ``DEPTH`` rows of
counters, which saturate at the least count asked for; the tasks' rows are
added block by block.  No sum is below an n-gram's count, so whatever is
frequent has full cells in all rows.  Words and pairs are filed first, then a
length at a time, only n-grams whose two parts of a word less have full cells;
so rare words, pairs and triples crowd no later sketch.  The last pass adds up,
exactly and by the words themselves, the n-grams whose own cells and whose
parts' cells are full.  Then each candidate's cuts are scored by the exact
counts, and phrases that a longer one explains go.

A sketch's width follows the corpus (a cell for ``BYTES_A_CELL`` bytes of text,
up to ``WIDEST``): a bit a cell of each sketch goes to the tasks, 64 MB at the
most.  A task counts ``ROUND`` cells of a row at once, and a wider sketch in
rounds over the texts.  A corpus beyond 34 GB of text makes cells full that
needn't be, which costs the last pass rows and changes no result.

Parts that very many candidates share (a thousandth of all lookups or more, so
a thousand at most) are looked up by a broadcast, all others by a join; longer
phrases are reduced to their maximum before the shuffle.

Defined results: a null text is empty; a null language is ``und``; a language
without candidates gives no rows, an empty table none; repeated rows count as
often as they stand; ids and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, slices, text_of

DEPTH, BYTES_A_CELL, NARROWEST, WIDEST, ROUND = 1, 64, 1 << 16, 1 << 29, 1 << 27
#: Cells of a block of counters, bytes of text that a task works on at once, and those that it sketches in all.
BLOCK, PORTION, TASK_BYTES = 1 << 16, 4 << 20, 1 << 30
#: Words whose hashes are kept at once, and bytes that are hashed at once.
MOST_HASHES, STRETCH = 1 << 18, 1 << 18
#: Parts of a language that are ranked apart first.
PARTS = 64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPLIT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_SEPARATOR = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BREAK, _BASE = 1, 0xBF58476D1CE4E5B9


def sections(text: bytes, size: int = PORTION) -> Iterator[bytes]:
    """A text in stretches of about ``size`` bytes, cut at separators alone."""
    at = 0
    while len(text) - at > size:
        m = _SEPARATOR.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def portions(batches: Iterator[pa.RecordBatch], size: int = PORTION) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by line ends), of about ``size`` bytes."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in slices(batches, "text", size):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in sections(text, size):
                held.setdefault(lang, []).append(part)
                total += len(part)
                if total > size:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, total = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def tokens(text: bytes) -> list[bytes]:
    """The words of lower-cased pieces, in order; a line end between pieces."""
    found = text.lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")
    return [t for t in found if t]


class Hashes(dict[bytes, int]):
    """A hash a word, kept while few enough: one by one what ``word_hashes`` gives for a text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_HASHES:
            self.clear()
        h = self[word] = int(word_hashes(word)[0])
        return h


def powers(n: int, known: list[np.ndarray] = []) -> list[np.ndarray]:
    """Of ``_BASE`` and its inverse the powers from 0 on, ``n`` or more of each, in whole numbers of 64 bits."""
    if not known or len(known[0]) < n:
        known[:] = [np.full(2 * n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in known:
            p[0] = 1
            np.cumprod(p, out=p)
    return known


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each of the ``tokens`` of a text, ``_BREAK`` for a line end, from all bytes at once.

    A word's polynomial is a difference of prefix sums, divided by the power at which the word begins.
    """
    a = np.frombuffer(text.lower().translate(_SPLIT), np.uint8)
    ends = a == 10
    within = np.zeros(len(a) + 2, bool)
    within[1:-1] = ~(ends | (a == 32))
    first, last = np.flatnonzero(within[1:-1] & ~within[:-2]), np.flatnonzero(within[1:-1] & ~within[2:]) + 1
    ends[first] = True
    where = np.flatnonzero(ends)
    out, h = np.full(len(where), _BREAK, np.uint64), np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + STRETCH, "right")))
        at, own = first[i], a[first[i] : last[j - 1]]
        up, down = powers(max(STRETCH, len(own)))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own + np.uint64(1)) * up[: len(own)], out=sums[1:])
        h[i:j] = (sums[last[i:j] - at] - sums[first[i:j] - at]) * down[first[i:j] - at]
        i = j
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD[1])
    out[a[where] != 10] = np.maximum(h ^ (h >> np.uint64(29)), 2)
    return out


def grams(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length, the hash of the words from each place on and whether they lie within one piece."""
    with np.errstate(over="ignore"):
        h, fits = words, words != _BREAK
        whole = fits
        for k in range(1, longest + 1):
            if k > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(_ODD[k % 4]) + words[k - 1 :]
                fits = fits[:-1] & whole[k - 1 :]
            yield h ^ (h >> np.uint64(32)), fits


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(_ODD[row])) >> np.uint64(65 - width.bit_length())).astype(np.uint32)


def hashed(text: bytes, lang: str) -> np.ndarray:
    h = word_hashes(text)
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    return np.where(h == _BREAK, h, np.maximum(h ^ salt, 2))


def width_for(n_bytes: int) -> int:
    wanted = max(1, n_bytes // BYTES_A_CELL)
    return min(WIDEST, max(NARROWEST, 1 << (wanted - 1).bit_length()))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(docs, text_col))


def likely(words: np.ndarray, longest: int, full: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length the hashes and which may be frequent: their parts' cells are full, and their own where ``full`` has their length.

    ``full`` has bits (a row of them a row of counters) for each length from one on, as far as they are known.
    """
    keep = None
    for k, (h, ok) in enumerate(grams(words, longest), 1):
        if keep is not None:
            ok = ok & keep[:-1] & keep[1:]
        if k <= len(full):
            where = np.flatnonzero(ok)
            for row, bits in enumerate(full[k - 1]):
                at = cells(h[where], row, 8 * len(bits))
                where = where[((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
            ok = np.zeros(len(ok), bool)
            ok[where] = True
        keep = ok
        yield h, ok


def count_into(have: np.ndarray, words: np.ndarray, longest: int, least: int, full: list[np.ndarray] | None = None, width: int = 0, start: int = 0) -> None:
    """Adds the n-grams of ``words`` that may be frequent, longer than those in ``full``, to a task's counters.

    A length at a time, since saturating sums don't depend on how they are cut.  ``have`` may be the cells of ``width`` from ``start`` on.
    """
    share, full = have.shape[1], full or []
    for k, (h, ok) in enumerate(likely(words, longest, full), 1):
        if k <= len(full):
            continue
        found = h[ok]
        for row in range(DEPTH):
            at = cells(found, row, width or share)
            if width > share:
                at = at[(at >= start) & (at < start + share)] - np.uint32(start)
            at.sort()
            first = np.flatnonzero(np.diff(at, prepend=at[:1] - np.uint32(1))) if len(at) else at
            n = np.diff(first, append=len(at))
            have[row, at[first]] = np.minimum(have[row, at[first]].astype(np.int64) + n, least)


def sketches(texts: DataFrame, width: int, longest: int, least: int, full: list[np.ndarray] = [], start: int = 0) -> DataFrame:
    """Each task's counters of the cells from ``start`` on, ``ROUND`` of a row at most, by block: ``block`` (rows one after the other), ``counts``."""
    kind, share = np.uint8 if least < 256 else np.uint32, min(width, ROUND)
    shared = texts.sparkSession.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((DEPTH, share), kind)
        for lang, text in portions(batches):
            count_into(have, hashed(text, lang), longest, least, shared.value, width, start)
        flat = have.reshape(-1, BLOCK)
        for i in np.flatnonzero(flat.any(axis=1)).tolist():
            row, own = divmod(i, share // BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([(row * width + start) // BLOCK + own], pa.int32()), pa.array([flat[i].tobytes()], pa.binary())], names=["block", "counts"])

    return texts.mapInArrow(run, "block int, counts binary")


def full_cells(parts: DataFrame, tasks: int, least: int) -> DataFrame:
    """The tasks' counters added up: a bit a cell, set where the sum is ``least`` or more."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = np.frombuffer(raw.as_buffer(), kind).astype(np.uint32)
                sums[i] = np.minimum(sums[i] + n, least) if i in sums else n
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return parts.repartition(tasks, "block").mapInArrow(run, "block int, bits binary")


def survivors(texts: DataFrame, full: list[np.ndarray], longest: int) -> DataFrame:
    """``lang, order, phrase, n``: counts, by portion, of the n-grams whose cells and whose parts' cells are full.

    Order 0 (phrase empty) counts all words.  ``full`` has the bits of each length.
    """
    shared = texts.sparkSession.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in portions(batches):
            listed, words = tokens(text), hashed(text, lang)
            number: dict[bytes, int] = {}
            exact = np.fromiter((number.setdefault(w, len(number)) for w in listed), np.int64, len(listed))
            orders, phrases, counts = [0], [b""], [int((words != _BREAK).sum())]
            same = None
            for k, (_, ok) in enumerate(likely(words, longest, shared.value), 1):
                key = exact if k == 1 else (same[:-1] << 32) | exact[k - 1 :]
                where = np.flatnonzero(ok)
                _, first, ids, n = np.unique(key[where], return_index=True, return_inverse=True, return_counts=True)
                same = np.zeros(len(ok), np.int64)
                same[where] = ids
                orders += [k] * len(first)
                phrases += [b" ".join(listed[i : i + k]) for i in where[first].tolist()]
                counts += n.tolist()
            for i in range(0, len(orders), 1 << 16):
                cut = slice(i, i + (1 << 16))
                columns = [pa.array([lang] * len(orders[cut])), pa.array(orders[cut], pa.int32()), pa.array(phrases[cut], pa.binary()).cast(pa.string()), pa.array(counts[cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "order", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, order int, phrase string, n long")


def counted(docs: DataFrame, scratch: Scratch, least: int, longest: int, lang_col: str, text_col: str, width: int | None = None) -> DataFrame:
    """Exact counts of all phrases of up to ``longest`` words that stand ``least`` times or more (``lang, order, phrase, n``), and of all words (order 0)."""
    spark, texts = docs.sparkSession, _texts(docs, lang_col, text_col)
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = width or width_for(n_bytes)
    # Few tasks with much text each, since their counters are what is shuffled, but no more than TASK_BYTES.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    full: list[np.ndarray] = []
    for k in range(2, longest + 1):
        bits = np.zeros((DEPTH, width // 8), np.uint8)
        for start in range(0, width, ROUND):
            sums = full_cells(sketches(texts.coalesce(tasks), width, k, least, full, start), tasks, least)
            for row in scratch.materialise(sums, "full-cells").collect():  # a bit a cell: bounded by WIDEST
                bits.reshape(-1, BLOCK // 8)[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        # Words and pairs have one sketch.
        full = full + [bits] if full else [bits, bits]
    found = survivors(texts, full, longest)
    sums = found.groupBy("lang", "order", "phrase").agg(F.sum("n").alias("n"))
    return scratch.materialise(sums.filter((F.col("order") == 0) | (F.col("n") >= least)), "phrases")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def _between(words: str, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, longest: int, share: int = 1000) -> DataFrame:
    """``lang, phrase, order, a, l, r, score`` of each candidate by its lowest-scoring cut."""
    given = counts.filter("order >= 2").select("lang", "order", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = F.expr("explode(sequence(1, order - 1))").alias("k")
    cut = given.select("lang", "order", "phrase", "a", "words", cuts)
    sides = F.array(F.struct(F.lit("l").alias("side"), _between("words", 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _between("words", F.col("k") + 1, F.col("order") - F.col("k")).alias("part")))
    need = cut.select("lang", "order", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "order", "phrase", "a", "k", "x.side", "x.part")
    known = counts.filter("order >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    total = given.agg(F.coalesce(F.sum(2 * (F.col("order") - 1)), F.lit(0))).first()[0]
    # Each of these parts has a share of 1 in ``share`` of all lookups, so there are ``share`` at most.
    common = need.groupBy("lang", "part").count().filter(F.col("count") >= max(1000, total / share)).select("lang", "part")
    common = known.join(common.hint("merge"), ["lang", "part"])
    looked = need.join(F.broadcast(common), ["lang", "part"]).unionByName(need.join(F.broadcast(common.select("lang", "part")), ["lang", "part"], "left_anti").join(known.hint("merge"), ["lang", "part"]))
    of_cut = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    rows = looked.groupBy("lang", "order", "phrase", "a").agg(*of_cut)

    def score(k: int) -> Column:
        return F.expr(f"cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0))) as bigint)")

    choices = F.array(*(F.when(F.col("order") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)))
    return rows.withColumn("best", F.array_min(F.filter(choices, lambda c: c.isNotNull()))).select("lang", "phrase", "order", "a", "best.l", "best.r", "best.score")


def unexplained(found: DataFrame, counts: DataFrame, percent: int = 80) -> DataFrame:
    """Those candidates that lie in no longer one with ``percent`` of their count."""
    longer = counts.filter("order >= 3").select("lang", "order", F.split("phrase", " ").alias("words"), "n")
    spans = F.expr("flatten(transform(sequence(2, order - 1), m -> transform(sequence(1, order - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    most = longer.select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    joined = found.join(most.hint("merge"), ["lang", "phrase"], "left")
    return joined.filter(F.col("longest").isNull() | (100 * _wide("longest") < percent * _wide("a"))).drop("longest")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", width: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    if not 2 <= longest <= 8 or least < 1:
        raise ValueError("longest must be 2 to 8 and least 1 or more")
    with Scratch(docs.sparkSession) as scratch:
        counts = counted(docs, scratch, least, longest, lang_col, text_col, width)
        left = unexplained(scored(counts, longest), counts, percent).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        # The first of each part of a language, then of those the first: no task takes more than PARTS * top rows of one.
        for keys in (["lang", "part"], ["lang"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
            left = left.withColumn("rank", place).filter(F.col("rank") <= top)
        first = left
        n = counts.filter("order = 0").select("lang", "n")
        out = first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return materialise(out, "collocations")


def oracle(least: int = 30, percent: int = 80, top: int = 2000) -> str:
    """The same in SQL, counting every n-gram."""
    return rf"""
with pieces as materialized (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
grams as (
  select lang, k as len, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from pieces cross join (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
counts as materialized (select lang, len, phrase, count(*) as a from grams group by all having count(*) >= {least}),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
cuts as (select lang, len, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, len)) as k from counts where len >= 2),
scores as (
  select c.lang, c.len, c.phrase, c.a, c.k, x.a as l, y.a as r, ((2000000::hugeint * c.a) // (x.a::hugeint + y.a))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.len = c.k and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join counts y on y.lang = c.lang and y.len = c.len - c.k and y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from scores qualify row_number() over (partition by lang, len, phrase order by score, k) = 1),
inner_phrases as (
  select lang, a, len, unnest(flatten(list_transform(range(2, len), lambda m: list_transform(range(1, len - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) as phrase
  from (select lang, a, len, string_split(phrase, ' ') as w from counts where len >= 3)),
longer as (select lang, phrase, max(a) as most from inner_phrases group by lang, phrase),
left_over as (
  select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase
  where g.most is null or 100::hugeint * g.most < {percent}::hugeint * b.a)
select o.lang, row_number() over (partition by o.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, t.n, score
from left_over o join totals t on t.lang = o.lang
qualify row_number() over (partition by o.lang order by score desc, a desc, encode(phrase)) <= {top}"""
