"""Encoders over given vocabulary files; one of each is kept per Python worker.

Nothing is trained here and no file is copied: callers pass paths.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken

#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for the ``regex`` module, whose \s has other members.
PRE_TOKEN = regex.compile(BYTE_LEVEL_PATTERN.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
_LONG_SPACE = regex.compile(r"\p{White_Space}{10000,}+")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies print a byte as itself if it is visible Latin-1, else as the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[re.Pattern[str] | None, dict[str, int]]:
    """A pattern of the added tokens of a ``tokenizers`` file, which its library finds in the raw text first, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: added tokens with conditions")
    ids = {t["content"]: t["id"] for t in added}
    return re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None, ids


def around_added(path: str, text: str, encode: Callable[[str], list[int]]) -> list[int]:
    """Ids of a text: of its added tokens, and by ``encode`` of what stands between them."""
    pattern, ids = added_tokens(path)
    out: list[int] = []
    at = 0
    for m in pattern.finditer(text) if pattern else ():
        if m.start() > at:
            out += encode(text[at : m.start()])
        out.append(ids[m[0]])
        at = m.end()
    return out + encode(text[at:]) if at < len(text) or not at else out


@lru_cache(maxsize=2)
def from_ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def from_byte_level_json(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, run by rank.

    Ids equal those of the ``tokenizers`` library (tested) where ids rise in
    the order of the merges, which is checked; added tokens are the callers' (``around_added``).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    symbol, vocab = byte_of_symbol(), spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [vocab["".join(p)] for p in pairs]
    if ids != sorted(ids):
        raise ValueError(f"{path}: ids don't rise with the merges")
    ranks = {bytes(symbol[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text; very long white space, too deep for the library's matcher, is cut out first.

    The pattern keeps such a run together but for its last character, if a
    visible one follows.
    """
    if len(text) <= 10_000 or not _LONG_SPACE.search(text):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
        at = end
    return ids + enc.encode_ordinary(text[at:])


#: Characters whose pre-tokens need no library: visible ASCII, Latin-1 letters and ASCII white space.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*+")
#: Their pre-tokens other than runs of letters, once in lower case.
_MARKS = re.compile(r"'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]++")
#: Stands for a word's end; white space is in no word.
_END = " "


@lru_cache(maxsize=2)
def from_word_end_json(path: str) -> tiktoken.Encoding:
    """The merges of a word-end BPE of a ``tokenizers`` file, over pieces that end in ``_END``.

    A piece's last byte and its end are one symbol at the start: their ranks
    are below those of all merges, so they join first.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["end_of_word_suffix"] != "</w>":
        raise ValueError(f"{path}: no word-end vocabulary")
    special = {t["content"] for t in spec["added_tokens"]}
    symbol, vocab = byte_of_symbol(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab["".join(p)] for p in pairs]
    if ids != sorted(ids) or ids[0] < 512:
        raise ValueError(f"{path}: ids don't rise with the merges")
    ranks = {}
    for t, i in vocab.items():
        if t not in special:
            body = t.removesuffix("</w>")
            ranks[bytes(symbol[c] for c in body) + _END.encode() * (body != t)] = i
    return tiktoken.Encoding(path, pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def encode_plain(enc: tiktoken.Encoding, text: str) -> list[int] | None:
    """Ids of a text of plain characters by ``from_word_end_json``; None for other texts."""
    if _PLAIN.fullmatch(text) is None:
        return None
    pieces = _MARKS.sub(r" \g<0> ", text.lower()).split()
    return enc.encode_ordinary(_END.join(pieces) + _END) if pieces else []
