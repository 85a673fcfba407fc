"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of characters other than ASCII white space, with A-Z in lower case.
All texts of a batch lie in one byte buffer and every step is one pass over it, so
the cost per byte does not depend on how many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 texts in runs of about ``limit`` bytes; a longer text is a run of its own."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        if run and size + len(data) > limit:
            yield run
            run, size = [], 0
        run.append(data)
        size += len(data)
    if run:
        yield run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin and end.

    Text ``i`` has the words ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, stop = edge[::2], edge[1::2]
    start = start[: len(stop)]
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # Prefix sums of c[i] * B**i give any word's polynomial by a difference.
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(
        (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:]
    )
    value = (total[stop] - total[start]) * _powers(_inverse(_BASE), len(data))[start]
    hashes = mix(value + (stop - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    return hashes, bounds


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: ``(hashes, bounds)``, ascending within a text.

    A text of fewer words has its whole sequence as its only shingle, a text
    without words has none.
    """
    hashes, bounds = word_hashes(texts)
    count = np.diff(bounds)
    per_text = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), per_text)
    first = np.concatenate([[0], np.cumsum(per_text)])
    at = bounds[:-1][owner] + (np.arange(first[-1]) - first[:-1][owner])
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    width = np.minimum(count[owner], words)
    value = width.astype(np.uint64)
    for k in range(words):
        value = value * _STEP + np.where(k < width, padded[at + k], np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
