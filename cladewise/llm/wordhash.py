"""Hashes of the words of texts, for whole Arrow batches at a time with numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D, with
A-Z in lower case. All of this is decided on UTF-8 bytes: no byte of a longer
code is an ASCII byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes handled at once. Longer texts are cut at white space.
STEP = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = _LOWER[97:123]
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(STEP + 2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up: np.ndarray | None = None
    down: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if _Tables.up is None:
        _Tables.up, _Tables.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    return _Tables.up, _Tables.down


def _hash_long_word(word: bytes) -> int:
    """The same polynomial, for a word of over STEP bytes."""
    up, _ = _tables()
    h, at = 0, 1
    for i in range(0, len(word), STEP):
        part = _LOWER[np.frombuffer(word[i : i + STEP], np.uint8)]
        h = (h + at * int((part * up[: len(part)]).sum(dtype=np.uint64))) & _MASK
        at = at * pow(_BASE, STEP, 1 << 64) & _MASK
    return h


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of at most STEP bytes."""
    up, down = _tables()
    raw = np.frombuffer(piece, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _one(text: bytes) -> np.ndarray:
    """Word hashes of a text of any length."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + STEP)
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut >= at:
                end = cut + 1
            else:  # one word fills the piece
                m = _WHITE.search(text, end)
                end = m.start() if m else len(text)
                h = np.array([(_hash_long_word(text[at:end]) + end - at) & _MASK], np.uint64)
                out.append(mix(h))
                at = end
                continue
        out.append(_hash_piece(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yields (index of the first text, word hashes of it and those after it), a bounded piece at a time."""
    group: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        b = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(b) + 1 > STEP:
            yield first, _several(group)
            group, first, size = [], i, 0
        group.append(b)
        size += len(b) + 1
    if group:
        yield first, _several(group)


def _several(group: list[bytes]) -> list[np.ndarray]:
    if len(group) == 1:
        return [_one(group[0])]
    sizes = np.array([len(b) + 1 for b in group])
    hashes, start = _hash_piece(b" ".join(group))
    return np.split(hashes, np.searchsorted(start, np.cumsum(sizes)[:-1]))


_SHIFT = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * _SHIFT[i % len(_SHIFT)] + words[i : i + n])
    return np.unique(h)
