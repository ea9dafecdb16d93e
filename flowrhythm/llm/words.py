"""Words of many texts at once, hashed by prefix sums of their bytes."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: A value for each byte, and an odd factor, of whose powers modulo 2^64, and of those of its inverse, so many are kept.
BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
FACTOR, KEPT = 0x9E3779B97F4A7C15, 1 << 18
#: Bytes of a word whose sum is its hash, sums of longer ones being no good hashes; bytes that are hashed at once, about.
LONG, BLOCK = 64, 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """Powers of a factor from 0 to n, modulo 2^64."""
    own = _powers.get(factor)
    if own is None or len(own) <= n:
        own = np.full(max(n + 1, KEPT), factor, np.uint64)
        own[0] = 1
        own = np.cumprod(own, dtype=np.uint64)
        if len(own) == KEPT:
            _powers[factor] = own
    return own


def spans(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """Of each span of values their sum by powers of the factor from its begin on."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(factor, n)[:n], out=sums[1:])
        return (sums[ends] - sums[begins]) * powers(pow(factor, -1, 1 << 64), n)[begins]


def hashed(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin in bytes that have one space after each word, with the end of all; a hash of each."""
    place = np.concatenate([[0], np.flatnonzero(whole == 32) + 1])
    h = np.zeros(len(place) - 1, np.uint64)
    i = 0
    while i < len(h):
        j = min(max(int(np.searchsorted(place, place[i] + BLOCK, "right")) - 1, i + 1), len(h))
        own, begins = whole[place[i] : place[j]], place[i:j] - place[i]
        offset = np.minimum(np.arange(len(own)) - np.repeat(begins, np.diff(place[i : j + 1])), LONG)
        h[i:j] = np.add.reduceat(BYTE[own] * powers(FACTOR, LONG)[offset], begins)
        i = j
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    for i in np.flatnonzero(np.diff(place) > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(whole[place[i] : place[i + 1]].tobytes())
    return place, h


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space after each word, where words begin in them, hashes, whether a word begins a line, where each text's words begin).

    Spaces and line ends part words, and nothing else; a text's first word begins a line.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    line = raw == 10
    gap = (raw == 32) | line
    first = ~gap  # of a word
    keep = ~gap  # its bytes, and one after it
    first[1:] &= gap[:-1]
    keep[1:] |= ~gap[:-1]
    whole = raw[keep]
    whole[whole == 10] = 32
    place, h = hashed(whole)
    at = np.flatnonzero(first)
    number = np.cumsum(line)[at]
    lines = np.ones(len(h), bool)
    lines[1:] = number[1:] != number[:-1]
    starts = np.searchsorted(at, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return whole, place, h, lines, starts
