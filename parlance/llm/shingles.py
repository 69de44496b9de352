"""Words, word shingles and bit votes, on Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from .common import mix

SEED = 42
_LANES = np.uint64(0x0001000100010001)
#: Shingles whose votes fit a lane of 16 bits.
_MOST = 65_535


def words(text: bytes) -> list[bytes]:
    """Runs of other bytes than space and \\x09-\\x0D, A-Z lower-cased."""
    return text.lower().split()


def shingle_hashes(parts: list[bytes], n: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``n`` words joined by spaces, repeats included.

    Fewer words are one shingle; no words give none.
    """
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= n:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(parts[i:] for i in range(n)), strict=False))
    return np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(parts) - n + 1)


def votes(hashes: list[np.ndarray], variants: int = 1) -> np.ndarray:
    """For each document (an array of hashes) how often each bit is set: (documents, 64 * variants).

    Variant 0 has the hashes' own bits, others bits of hashes derived from them.
    Sixteen lanes of a 64-bit word count at once, in prefix sums; longer
    documents are summed in parts.
    """
    out = np.zeros((len(hashes), 64 * variants), np.int64)
    parts = [(i, h[k : k + _MOST]) for i, h in enumerate(hashes) for k in range(0, len(h), _MOST)]
    if not parts:
        return out
    owner = np.array([i for i, _ in parts])
    flat = np.concatenate([p for _, p in parts])
    starts = np.concatenate([[0], np.cumsum([len(p) for _, p in parts])[:-1]])
    for variant in range(variants):
        h = flat if not variant else mix(flat ^ np.uint64(variant * 0x5851F42D4C957F2D & (2**64 - 1)))
        for bit in range(16):
            sums = np.add.reduceat((h >> np.uint64(bit)) & _LANES, starts)
            for lane in range(4):
                np.add.at(out[:, 64 * variant + 16 * lane + bit], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(documents, 64) of booleans as one signed 64-bit integer each; column i is bit i."""
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<i8").ravel()


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """SimHash: a bit is 1 if it is set in over half the hashes; without hashes all are 0."""
    n = np.array([len(h) for h in hashes], np.int64)[:, None]
    return pack_bits(2 * votes(hashes) > n)


def jaccard(a: Iterable[np.ndarray], b: np.ndarray) -> np.ndarray:
    """Similarity of the sorted distinct hashes ``b`` to each such array of ``a``; two empty ones are alike."""
    out = []
    for x in a:
        common = len(np.intersect1d(x, b, assume_unique=True))
        union = len(x) + len(b) - common
        out.append(common / union if union else 1.0)
    return np.array(out)
