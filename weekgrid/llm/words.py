"""Words of whole texts as 64-bit hashes, for all texts of a batch at once.

A word is a run of bytes outside x20 and x09-x0D, A-Z lower-cased. Its hash is a polynomial over random byte values,
mixed at the end; two words share a hash by accident with a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: its random value (A-Z take that of a-z) and whether it is part of a word."""
    value = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    return value, inside


_VALUE, _INSIDE = _tables()
#: Bytes of words that are runs of letters, digits and anything beyond ASCII.
LETTERS = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 (null: empty), at most so many bytes together or one text, with the first one's place."""
    run: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > most:
            yield start, run
            run, start, size = [], i, 0
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def word_hashes(raw: list[bytes], member: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in their order, and where each text's words begin (one more at the end).

    `member` says which bytes words are made of; the line break never is one.
    """
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    terms = _VALUE[data]
    terms *= _powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    # Each word's sum starts at the power of its place; divide by it.
    hashes = (total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return mix(hashes), np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many neighbours; the order of the words matters."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = mix(out * _BASE + hashes[j : j + n])
    return out


def shingle_sets(raw: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Each text's distinct word shingles, sorted; a shorter text's whole word sequence is its one shingle."""
    hashes, begins = word_hashes(raw)
    runs = windows(hashes, size)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
