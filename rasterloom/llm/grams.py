"""Words and word n-grams of many texts at once, as hashes computed with numpy.

A word's hash is a chain over its eight-byte parts, each mixed into what came before; a run's hash is
made of its halves' in the same way. Neither is linear in what it hashes, so there are no texts that
collide by their form; with two seeds, words are hashed twice from their bytes on. Prefix sums (a
polynomial modulo 2**64) are for values that are hashes already, as those of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

from rasterloom.llm.common import SPACE_BYTES, mix64

U = np.uint64
MASK = (1 << 64) - 1
#: Texts are worked on in runs of about so many bytes, which bounds the arrays beside them.
RUN_BYTES = 1 << 20
LONG_WORD = 64


@lru_cache(maxsize=8)
def base(seed: int) -> tuple[int, int, np.ndarray]:
    """An odd multiplier, its inverse modulo 2**64 and a random value for each byte."""
    rng = np.random.default_rng(1000 + seed)
    p = int(rng.integers(1 << 62, 1 << 63)) | 5
    return p, pow(p, -1, 1 << 64), rng.integers(1, 1 << 63, 256).astype(U) | U(1)


_powers: dict[int, np.ndarray] = {}


def powers(p: int, n: int) -> np.ndarray:
    """p**0 to p**(n-1) modulo 2**64; kept per process for the lengths that runs have."""
    have = _powers.get(p)
    if have is None or len(have) < n:
        steps = np.full(max(n, RUN_BYTES + 4096), p, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 8 * RUN_BYTES:
            _powers[p] = have
    return have[:n]


def prefix_hash(values: np.ndarray, seed: int) -> np.ndarray:
    """Sums over all prefixes, from the empty one."""
    p, _, _ = base(seed)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(p, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span lies."""
    _, q, _ = base(seed)
    return (prefix[end] - prefix[start]) * powers(q, len(prefix))[start]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def runs_of_texts(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each text."""
    n = len(raw)
    full = np.zeros(n + 2, bool)
    full[1:-1] = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    start = np.flatnonzero(full[1:] & (~full[:-1] | cut))
    end = np.flatnonzero(full[:-1] & (~full[1:] | cut))
    start = start[start < n]
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word's bytes; words of more than ``LONG_WORD`` bytes are hashed one by one."""
    size = end - start
    h = mix64(size.astype(U), seed)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(raw) + 1, U, padded.data, strides=(1,))  # the eight bytes from each place on
    for part in range(0, LONG_WORD, 8):
        some = np.flatnonzero((size > part) & (size <= LONG_WORD))
        if not len(some):
            break
        left = np.minimum(size[some] - part, 8).astype(U)
        value = at_byte[start[some] + part] & (U(MASK) >> (U(64) - U(8) * left))
        h[some] = mix64(h[some] ^ value, seed + part + 1)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), seed)
    return h


def joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mix64(mix64(a, seed) + b, seed + 1)


def run_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The hash of the ``n`` values from each place on, as far as there are so many; runs are doubled, then put together."""
    out, have, part, size, left = None, 0, hashes, 1, n
    while left:
        if left & 1:
            many = max(len(hashes) - have - size + 1, 0)
            out = part[:many] if out is None else joined(out[:many], part[have : have + many], seed + 5)
            have += size
        left >>= 1
        if left:
            part = joined(part[: max(len(part) - size, 0)], part[size:], seed)
            size *= 2
    return mix64(out, seed + n)


def gram_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (counted over all texts) and text of every n-gram that lies in one text."""
    many = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    first = np.cumsum(counts) - counts
    within = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return first[text] + within, text


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    return run_hashes(hashes, n, seed)[at]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted by hash, and the offsets of the sets.

    A text of fewer words has one shingle, all its words; one without words has none. Words are
    compared with A-Z in lower case.
    """
    sets, sizes = [], []
    for i, j in runs_of_texts(offsets):
        part, at = lower_ascii(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        start, end, counts = words(part, at)
        h = word_hashes(part, start, end, 0)
        first, text = gram_starts(counts, n)
        g = gram_hashes(h, first, n, 0)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            begin, own = (np.cumsum(counts) - counts)[short], np.zeros(len(short), U)
            for c in range(1, n):
                some = counts[short] == c
                own[some] = mix64(gram_hashes(h, begin[some], c, 0), 77)
            g, text = np.concatenate([g, own]), np.concatenate([text, short])
        order = np.lexsort((g, text))
        g, text = g[order], text[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        sets.append(g[keep])
        sizes.append(np.bincount(text[keep], minlength=j - i))
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    many = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return flat, np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
