"""Sketches that follow the corpus: their width, what is filed at each length, and rounds of cells."""

import numpy as np
import pytest
from test_runs_secrets_phrases import DOCS, phrase_rows, plain_phrases

from tidewake.llm import collocations as c


@pytest.mark.parametrize("gb", [0.5, 6, 30])
def test_cells_follow_the_text(gb):
    assert gb * 1e9 / c.width_for(int(gb * 1e9)) <= 64


def test_longer_phrases_are_filed_only_where_their_parts_may_be_frequent():
    rng = np.random.default_rng(5)
    often, rare = rng.integers(2, 1 << 62, 3).astype(np.uint64), rng.integers(2, 1 << 62, 200_000).astype(np.uint64)
    words = np.concatenate([np.tile(often, 40), rare])
    pairs = np.zeros((c.DEPTH, 1 << 20), np.uint8)
    c.count_into(pairs, words, 2, 30)
    bits = np.packbits(pairs >= 30, axis=1, bitorder="little")
    triples = np.zeros((c.DEPTH, 1 << 20), np.uint8)
    c.count_into(triples, words, 3, 30, [bits, bits])
    assert (triples > 0).sum(axis=1).tolist() == [3] * c.DEPTH and (triples == 30).sum() == 3 * c.DEPTH


def test_rounds_of_cells_are_one_sketch(spark, monkeypatch):
    rows = phrase_rows()
    words = np.random.default_rng(1).integers(2, 1 << 62, 5000).astype(np.uint64)
    whole, part = np.zeros((c.DEPTH, 1 << 18), np.uint8), np.zeros((c.DEPTH, 1 << 16), np.uint8)
    c.count_into(whole, words, 2, 30)
    c.count_into(part, words, 2, 30, None, 1 << 18, 1 << 17)
    assert part.any() and np.array_equal(part, whole[:, 1 << 17 : 3 << 16])
    monkeypatch.setattr(c, "ROUND", 1 << 16)
    got = c.mine(spark.createDataFrame(rows, DOCS).repartition(3), least=3, width=1 << 17)
    assert sorted(map(tuple, got.collect())) == plain_phrases([(r[2], r[1]) for r in rows], 3)


@pytest.mark.parametrize("stretch", [1, 7, 1 << 18])
def test_words_hashed_at_once_are_the_words_of_the_text(monkeypatch, stretch):
    monkeypatch.setattr(c, "STRETCH", stretch)
    known = c.Hashes()
    for text in (b"", b" ", b"\n", b"One  two.\tThree one two\r\n; aa a aaa \xc3\xa9 \x00 \x00\x00,", b"x" * 5000 + b" x y", b".a", b"a."):
        listed = c.tokens(text)
        got = c.word_hashes(text).tolist()
        assert got == [known[w] for w in listed]
        assert len(set(got)) == len(set(listed))
