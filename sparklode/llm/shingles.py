"""Distinct word shingles of whole texts as sorted 64-bit hashes, by array operations."""

from hashlib import blake2b

import numpy as np

from sparklode.llm.common import mix

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# A hash modulo 2^64 gives long words of a certain make the same value whatever its base.
LONG_WORD = 32
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {}


def powers(size: int, base=_P) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < size:
        known = np.full(size + (1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 1 << 21:
            _powers[base] = known
    return known


def prefix_sums(flat: np.ndarray, codes: np.ndarray = _CODE) -> np.ndarray:
    """S with S[j] - S[i] = P^i * (hash of flat[i:j]), modulo 2^64."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(codes[flat] * powers(len(flat))[:len(flat)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = powers(len(sums), _P_INVERSE)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_spans(flat: np.ndarray, offsets: np.ndarray):
    """Starts, ends and text numbers of all words; words never cross two texts."""
    word = ~_SEPARATOR[flat]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(word)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``size`` words, hashed and sorted.

    A text with fewer words is one shingle of all its words; without words it has none.
    """
    lower = _LOWER[flat]
    starts, ends, owner = word_spans(lower, offsets)
    words = span_hashes(prefix_sums(lower), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = blake2b(lower[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        words[i] = int.from_bytes(word, "little")
    at = np.searchsorted(owner, np.arange(len(offsets)))
    factors = powers(size + 1, np.uint64(0xD6E8FEB86659FD93))[1:]
    count = max(len(words) - size + 1, 0)
    hashes = np.zeros(count, np.uint64)
    for i in range(size):
        hashes += words[i:i + count] * factors[i]
    hashes = mix(hashes)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            found = np.sort(hashes[a:b - size + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            sets.append(found[keep])
        elif b > a:
            whole = np.sum(words[a:b] * factors[:b - a], dtype=np.uint64)
            sets.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
