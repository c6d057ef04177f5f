"""Sets of word shingles as sorted 64-bit hashes, many texts at a time.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text of five words or more has its distinct
five-word shingles; one of one to four words has its whole sequence as its only shingle; one without words has none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from parley.llm.common import mix, strings_bytes

WIDTH, LONGS = 5, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LETTER[65:91] = _LETTER[97:123]


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, per text, the number of words before it (rows + 1)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _powers(1 << int(len(raw)).bit_length())
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:-1]
    stops = ~space
    stops[:-1] &= space[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[:len(raw)], out=total[1:])
    value = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _STEP)
    return value, np.searchsorted(first, offsets)


def sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a string column."""
    value, before = words(*strings_bytes(column))
    n = len(value)
    grams = value.copy()
    for j in range(1, WIDTH):
        grams = grams[:n - j] * _STEP + value[j:] if n > j else grams[:0]
    grams = mix(grams)
    found = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= WIDTH:
            found.append(np.unique(grams[a:b - WIDTH + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in value[a:b]:
                short = mix(np.array([short]) * _STEP + w)[0]
            found.append(np.array([short], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def set_ids(found: list[np.ndarray]) -> list[bytes]:
    """128-bit name of every set: equal sets have equal names."""
    sizes = np.array([len(x) for x in found])
    out = [b"\0" * 16] * len(found)
    full = np.flatnonzero(sizes)
    if len(full):
        every = np.concatenate(found)
        at = (np.cumsum(sizes) - sizes)[full]
        one = mix(np.add.reduceat(mix(every ^ np.uint64(_BASE)), at) + sizes[full].astype(np.uint64))
        two = mix(np.add.reduceat(mix(every + _STEP), at) ^ one)
        names = np.stack([one, two], axis=1).astype(">u8")
        for i, row in zip(full.tolist(), names):
            out[i] = row.tobytes()
    return out


def parity(found: np.ndarray) -> bytes:
    """A bit sketch, at least two bits an element: each bit says whether an odd number of elements hash to it.

    The sketches of two sets differ in at most as many bits as the sets do in elements.
    """
    bits = 1 << max(6, int(2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def short_parity(found: np.ndarray) -> list[int]:
    """The same sketch in LONGS 64-bit words for sets of any size: for large ones it excludes less."""
    odd = np.bincount((found & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())
