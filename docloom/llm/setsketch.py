"""SetSketch registers of word shingles: mergeable, and alike where sets are alike.

Register i of a set is 1 - log_b of the least of its elements' exponential values under hash
i, cut to 16 bits. The exponential spacing (base ``BASE``) makes a register a truncated
minimum: two sketches merge by the larger register, registers of two sets agree with a
probability close to their Jaccard similarity, and how many are larger, smaller or equal
gives its maximum-likelihood estimate.
"""

from __future__ import annotations

import hashlib

import numpy as np

from docloom.llm.base import lowered, mixed, span_hashes, words

REGISTERS = 128
BASE = 1.001
RATE = 20.0
WIDTH = 5

_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEPS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_LAST = mixed(_SEEDS + np.uint64(7)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row.

    Words are runs without white space, A-Z lower-cased. A row of fewer than ``width`` words
    has its whole sequence as one shingle; a row without words has none.
    """
    small = lowered(data)
    starts, ends, counts = words(small, bounds)
    hashes = span_hashes(small, starts, ends)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _STEPS[k]
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            part = (hashes[at : at + n] * _STEPS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([part ^ np.uint64(0xA5A5A5A5A5A5A5A5)])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """Registers (sets x REGISTERS, unsigned 16 bits); an empty set has zeros."""
    least = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    first = 0
    while first < len(some):
        last, size = first, 0
        while last < len(some) and (last == first or size + len(sets[some[last]]) <= block):
            size += len(sets[some[last]])
            last += 1
        rows = some[first:last]
        values = np.concatenate([sets[i] for i in rows])
        edges = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows[:-1]])]).astype(np.int64)
        for low in range(0, len(values), block * 4):
            # A very large set goes through in parts: sketches merge.
            part = values[low : low + block * 4]
            cuts = edges if len(rows) > 1 else np.zeros(1, np.int64)
            v, w = np.empty_like(part), np.empty_like(part)
            for i in range(REGISTERS):
                np.multiply(part, _SEEDS[i], out=v)
                np.right_shift(v, np.uint64(32), out=w)
                np.bitwise_xor(v, w, out=v)
                np.multiply(v, _LAST[i], out=v)
                found = np.minimum.reduceat(v, cuts)
                least[rows, i] = np.minimum(least[rows, i], found)
        first = last
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if some:
        uniform = (least[some].astype(np.float64) + 0.5) / 2.0**64
        value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
        out[some] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535)
    return out


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers."""
    parts = registers.reshape(len(registers), -1, rows).astype(np.uint64)
    keys = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.broadcast_to(keys, parts.shape[:2])
    for k in range(rows):
        keys = mixed(keys + parts[:, :, k])
    return keys


def likely_similarity(
    larger: np.ndarray, smaller: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of known sizes.

    ``larger`` and ``smaller`` count the registers of a above and below those of b.
    """
    total = np.maximum(sizes_a + sizes_b, 1)
    u, v = sizes_a / total, sizes_b / total
    equal = REGISTERS - larger - smaller
    most = np.minimum(u / np.maximum(v, 1e-300), v / np.maximum(u, 1e-300))

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return (
            larger * np.log(np.maximum(up, tiny))
            + smaller * np.log(np.maximum(down, tiny))
            + equal * np.log(np.maximum(1 - up - down, tiny))
        )

    low, high = np.zeros_like(most), most
    for _ in range(28):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(a) < likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2
