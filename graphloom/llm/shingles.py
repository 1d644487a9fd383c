"""Word shingles as 64-bit fingerprints, vectorised over slices of text."""

from __future__ import annotations

import numpy as np

from .common import SLICE_BYTES, Rolling, U, mix

#: The bytes that separate words (space, tab to carriage return).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of each word of a byte buffer; A-Z count as a-z. Long buffers go in blocks cut at spaces."""
    starts, prints, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and not SPACE[data[end]]:
            step = np.flatnonzero(SPACE[data[end : end + 4096]])
            end = end + int(step[0]) if len(step) else min(len(data), end + 4096)
        block = LOWER[data[at:end]]
        gap = np.ones(len(block) + 2, bool)
        gap[1:-1] = SPACE[block]
        first, last = np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        starts.append(first + at)
        prints.append(Rolling(block).spans(first, last))
        at = end
    return (np.concatenate(starts), np.concatenate(prints)) if starts else (np.zeros(0, np.int64), np.zeros(0, U))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingles of each text; fewer words make one shingle, none make an empty set."""
    data = np.frombuffer(b"\n".join(x or b"" for x in texts), np.uint8)
    lengths = np.array([len(x or b"") + 1 for x in texts])
    offsets = np.r_[0, np.cumsum(lengths)]
    starts, words = word_fingerprints(data)
    bounds = np.searchsorted(starts, offsets)
    chained = np.zeros(max(0, len(words) - size + 1), U)
    for j in range(size):
        chained += mix(words[j : j + len(chained)] + U(j + 1)) * U(2 * j + 3)
    chained = mix(chained)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            whole = np.sort(chained[a : b - size + 1])
            sets.append(whole[np.r_[True, whole[1:] != whole[:-1]]])
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=U)
            whole = np.add.reduce(mix(words[a:b] + place) * (place + place + U(1)), keepdims=True)
            sets.append(mix(whole ^ U(0x5BD1E995 + int(b - a))))
        else:
            sets.append(np.zeros(0, U))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit fingerprint of each set; 0 for empty ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out, full = np.zeros(len(sets), U), sizes > 0
    if full.any():
        values = np.concatenate(sets)
        first = np.r_[0, np.cumsum(sizes[full])[:-1]]
        sums, folded = np.add.reduceat(mix(values), first), np.bitwise_xor.reduceat(mix(values ^ U(0xA5A5A5A5A5A5A5A5)), first)
        out[full] = mix(sums * U(3)) + mix(folded * U(5)) + mix(sizes[full].astype(U) * U(7))
    return out.view(np.int64)
