"""What a task of the sketch holds beside its counters."""

import tracemalloc

import numpy as np

from tidewake.llm import collocations as c


def test_a_task_keeps_few_hashes_and_few_arrays():
    known = c.Hashes()
    for i in range(300_000):
        assert known[b"w%d" % i] == c.Hashes()[b"w%d" % i] if i % 50_000 == 0 else known[b"w%d" % i]
    assert len(known) <= 1 << 18 and c.PORTION <= 4 << 20
    words = np.random.default_rng(1).integers(2, 1 << 62, 400_000).astype(np.uint64) // np.uint64(1 << 50)
    have = np.zeros((c.DEPTH, c.NARROWEST), np.uint8)
    tracemalloc.start()
    c.count_into(have, words, 4, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(words)
    whole = np.concatenate([h[ok] for h, ok in c.grams(words, 4)])
    for row in range(c.DEPTH):
        assert np.array_equal(have[row], np.minimum(np.bincount(c.cells(whole, row, c.NARROWEST), minlength=c.NARROWEST), 30))
