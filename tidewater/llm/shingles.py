"""Distinct word shingles of texts as sorted 64-bit hashes, computed on their UTF-8 bytes.

Many short texts are hashed together in one pass over their bytes; a long text goes alone, a piece at a
time, so memory is bounded by a part's size and a text's number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 5
PART_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Multipliers of a shingle's words, odd.
_PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED = _FOLD.astype(np.uint64) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of the base (0) or its inverse (1), modulo 2^64; those that a part needs are kept."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), (_BASE, _BASE_INVERSE)[which], np.uint64)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        if n > 2 * PART_BYTES:
            return powers[:n]
        _powers[which] = powers
    return _powers[which][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts that lie one after another in ``raw``, A-Z in lower case, by running
    sums of a polynomial; and the offsets of each text's words."""
    word = ~_BLANK[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FOLDED[raw] * _power(0, len(raw)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(1, len(raw) + 1)[starts]), np.searchsorted(starts, offsets)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """``raw`` cut at blanks into pieces of about PART_BYTES."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + PART_BYTES)
        while hi < len(raw) and not _BLANK[raw[hi]]:
            blanks = np.flatnonzero(_BLANK[raw[hi : hi + 65536]])
            hi = min(len(raw), hi + (int(blanks[0]) if len(blanks) else 65536))
        yield raw[lo:hi]
        lo = hi


def _distinct(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct shingle hashes of each text, from its words' hashes."""
    n = np.diff(at)
    many = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(to[-1], np.uint64)
    if len(words) >= K:
        total = words[: len(words) - K + 1] * _PLACES[0]
        for j in range(1, K):
            total += words[j : len(words) - K + 1 + j] * _PLACES[j]
        inside = np.ones(len(total), bool)
        for j in range(1, K):  # a shingle does not reach into the next text
            cut = at[1:] - j
            cut = cut[(cut >= at[:-1]) & (cut < len(total))]
            inside[cut] = False
        out[np.repeat(n >= K, many)] = mixed(total[inside])
    for j in range(1, K):
        few = np.flatnonzero(n == j)
        if len(few):
            total = np.full(len(few), np.uint64(j)) * _BASE
            for k in range(j):
                total += words[at[few] + k] * _PLACES[k]
            out[to[few]] = mixed(total)
    for lo, hi in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[to[:-1][to[:-1] < len(out)]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[to]


def contents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and the offsets of its rows."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets) for parts of the column, in order: each text's sorted distinct hashes of
    its shingles of K words; of fewer words, the one of all of them; none without words."""
    raw, offsets = contents(texts)
    lo, n = 0, len(texts)
    with np.errstate(over="ignore"):
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, "right")) - 1)
            part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(part) > PART_BYTES:  # one long text
                words = np.concatenate([word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(part)])
                yield lo, *_distinct(words, np.array([0, len(words)]))
            else:
                yield lo, *_distinct(*word_hashes(part, at))
            lo = hi


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """The set of one text, given as bytes."""
    sets = [tokens for _, tokens, _ in shingle_sets(pa.array([raw.tobytes()], pa.binary()))]
    return sets[0]
