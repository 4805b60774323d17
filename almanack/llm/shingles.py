"""Word shingles of whole texts as 64-bit hashes, and min-hash signatures of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from almanack.llm.common import mix64, spans_hash, text_bytes

#: Bytes of text whose words are hashed at a time, each word whole; the hashes don't depend on it.
BLOCK = 1 << 18

#: Bytes that separate words: space and \t to \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the place of each text's first word."""
    data, offsets = text_bytes(texts)
    data = LOWERED[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    # A text ends a word even if the next text goes on without a space.
    begins = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[begins] |= inside[1:-1][begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] |= inside[1:-1][ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    for run in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // BLOCK)) + 1) if len(starts) else ():
        a, b = run[0], run[-1] + 1
        low, high = starts[a], stops[b - 1]
        hashes[a:b] = spans_hash(data[low:high], starts[a:b] - low, stops[a:b] - low)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and where each text's shingles start.

    A text with fewer words than ``words`` has its whole sequence as one shingle; one without
    words has none.
    """
    hashes, places = word_hashes(texts)
    counts = np.diff(places)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(places[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    lengths = np.repeat(np.minimum(counts, words), sizes)
    with np.errstate(over="ignore"):
        total = mix64(lengths.astype(np.uint64))
        for j in range(words):
            there = lengths > j
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1) | 1)
            part = hashes[np.minimum(at + j, max(0, len(hashes) - 1))] * factor if len(hashes) else total
            total = total + np.where(there, mix64(part), np.uint64(0))
    return mix64(total), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, size: int, seed: int = 17) -> np.ndarray:
    """Min-hash signatures, a row of unsigned 32-bit per text; texts without shingles get the maximum.

    Works on short runs of texts, so that intermediate results stay in the processor's cache.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    factors = random.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flips = random.integers(0, 1 << 32, size, dtype=np.uint32)
    out = np.full((len(bounds) - 1, size), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    starts = bounds[full]
    group = (bounds[full + 1] - 1) // 32_768
    for rows in np.split(np.arange(len(full)), np.flatnonzero(np.diff(group)) + 1) if len(full) else ():
        low = starts[rows[0]]
        piece = short[low : bounds[full[rows[-1]] + 1]]
        cuts = starts[rows] - low
        for j in range(size):
            out[full[rows], j] = np.minimum.reduceat((piece ^ flips[j]) * factors[j], cuts)
    return out
