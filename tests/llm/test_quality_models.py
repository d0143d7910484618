"""Both Kneser-Ney models against brute force, whatever the number of shards and buckets."""

import collections
import math
import random

import numpy as np
import pytest

from tidewake.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def discounts(counts):
    t = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.5
    d = [min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3)]
    return lambda c: d[min(c, 3) - 1]


def brute_characters(texts):
    """Mean negative log-probability a character of the words, by recursion over the orders."""
    chars_of = [len("".join(t.split())) for t in texts]
    # A code point from LEAD on is two symbols.
    wide = lambda c: chr(quality.LEAD + (ord(c) >> 10)) + chr(quality.TRAIL + (ord(c) & 1023))
    joined = ["".join(c if ord(c) < quality.LEAD else wide(c) for c in " ".join(t.split())) for t in texts]
    n, levels = quality.ORDER, {}
    top = collections.Counter()
    for t in joined:
        s = "\x01" * (n - 1) + t
        top.update(s[i : i + n] for i in range(len(t)))
    levels[n] = top
    for k in range(n - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    d = {k: discounts(levels[k].values()) for k in levels}
    after = {k: collections.defaultdict(list) for k in levels}
    for k in levels:
        for g, c in levels[k].items():
            after[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        below = 1 / quality.SYMBOLS if k == 1 else p(g[1:])
        seen = after[k].get(g[:-1])
        if not seen:
            return below
        c = levels[k].get(g, 0)
        return ((c - d[k](c)) if c else 0) / sum(seen) + sum(map(d[k], seen)) / sum(seen) * below

    out = []
    for t, chars in zip(joined, chars_of, strict=True):
        s = "\x01" * (n - 1) + t
        out.append(-sum(math.log(p(s[i : i + n])) for i in range(len(t))) / chars)
    return out


def brute_pairs(texts):
    """Mean negative log-probability a word by the other texts."""
    docs = [t.split() for t in texts]
    words = collections.Counter(w for d in docs for w in d)
    floor = max(2, -(-sum(words.values()) // quality.VOCABULARY))
    docs = [[w if words[w] >= floor else None for w in d] for d in docs]
    of = [collections.Counter(zip(["", *d], d)) for d in docs]
    n = sum(of, collections.Counter())
    d = discounts(n.values())
    before = collections.Counter(w for _, w in n)
    out = []
    for mine in of:
        own_context, total, freed, nats = collections.Counter(), collections.Counter(), collections.Counter(), 0.0
        for (u, _), c in mine.items():
            own_context[u] += c
        for (u, w), c in n.items():
            total[u] += c
            freed[u] += d(c)
        for (u, w), c in mine.items():
            rest, others = total[u] - own_context[u], n[u, w] - c
            high = (others - d(others)) / rest if others else 0.0
            weight = min(freed[u] / rest, 1.0) if rest else 1.0
            nats -= c * math.log(high + weight * before[w] / len(n))
        out.append(nats / sum(mine.values()))
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 60, "bucket_pairs": 7}])
def test_both_models_equal_brute_force(spark, monkeypatch, limits):
    rng = random.Random(8)
    some = ["sea", "oil", "ship", "a", "the", "wind", "drift", "俵俵俵", "\U0001f600", "port"]
    texts = [" ".join(rng.choice(some) if rng.random() < 0.9 else f"x{rng.randrange(40)}" for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    texts += [texts[3], "俵俵俵俵 俵"]
    rows = [(i, t, "en", "", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in quality.judge(frame, **limits).collect()}
    for i, (c, w) in enumerate(zip(brute_characters(texts), brute_pairs(texts), strict=True)):
        assert got[i].log_perplexity == pytest.approx(c, rel=1e-5)
        assert got[i].pair_log_perplexity == pytest.approx(w, rel=1e-5)


def test_chunks_of_any_size_agree(spark, monkeypatch):
    """Documents' pairs are the same whatever the chunks; a worker reads the module's limits, so they are tried in NumPy."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 9, 12)
    words = rng.integers(0, 7, int(sizes.sum()))
    keys, n = np.unique(quality.pair_keys(words, sizes), return_counts=True)
    model = quality.PairModel(np.full(10, 50), np.full(10, 4.0), np.full(10, 3), np.array([0, 0.4, 0.7, 1.0]), 30)
    one = quality.document_nats(words, sizes, n[quality.dealt(keys, 1)[0]], 1, model)
    many = quality.document_nats(words, sizes, n[quality.dealt(keys, 5)[0]], 5, model)
    assert one.tolist() == many.tolist() and (one[sizes == 0] == 0).all()


def test_packed_numbers_return():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.array([0]), np.arange(1000), rng.integers(0, 1 << 43, 5000)):
        assert quality.unpacked(quality.packed(x)).tolist() == x.tolist()
        up = np.sort(x)
        assert quality.unpacked(quality.packed(up, True), True).tolist() == up.tolist()


def test_words_are_hashed_from_the_bytes_of_all_texts_at_once():
    rng = random.Random(3)
    texts = [b"", b" ", b"oil", b"\x00 a\x0bb\x1c\xc2\x85 \xff", "俵   oil\r\n".encode(), b"x" * 5000 + b" ba ab", b"ab ab ab ab ab"]
    texts += [bytes(rng.choice(b"ab \t") for _ in range(rng.randrange(40))) for _ in range(200)]
    hashes, sizes = quality.word_hashes(texts)
    words = [t.split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    # Each by itself, in whole numbers.
    of = lambda w: sum(int(quality._BYTES[b]) * pow(int(quality._STEP), i + 1, 1 << 64) for i, b in enumerate(w)) % (1 << 64)
    assert hashes.view(np.uint64).tolist() == [of(w) for ws in words for w in ws]
    assert len(set(hashes.tolist())) == len({w for ws in words for w in ws})
    repeats = quality.repeat_words(hashes, sizes)
    for ws, got in zip(words, repeats.tolist(), strict=True):
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        assert got == len({i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})
    assert quality.word_hashes([])[0].tolist() == quality.word_hashes([b" "])[0].tolist() == []
