"""Word shingles of texts as sets of 64-bit hashes, and their b-bit MinHash signatures."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

from medialog.llm.hashing import PIECE, WHITE, mixed, pieces, tokens

_KINDS = np.array([0 if bytes([b]) in (bytes([w]) for w in WHITE) else 1 for b in range(256)], np.uint8)
_VALUES = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the hashes of its words, A-Z as a-z, in their order."""
    parts, owner = pieces(texts)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    first = 0
    while first < len(parts):
        last, size = first + 1, len(parts[first])
        while last < len(parts) and size + len(parts[last]) < PIECE:
            size += len(parts[last]) + 1
            last += 1
        data = np.frombuffer(b"\n".join(parts[first:last]), dtype=np.uint8)
        begins, hashes = tokens(data, _KINDS, _VALUES)
        cut = np.searchsorted(begins, np.cumsum([0, *[len(p) + 1 for p in parts[first:last]]]))
        for k in range(first, last):
            found[owner[k]].append(hashes[cut[k - first] : cut[k - first + 1]])
        first = last
    return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; all words if they are fewer."""
    if not len(words):
        return words
    runs = max(1, len(words) - size + 1)
    total = np.zeros(runs, dtype=np.uint64)
    for k in range(min(size, len(words))):
        total = total * _STEP + words[k : k + runs]
    return np.unique(mixed(total + np.uint64(min(size, len(words)))))


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


@dataclass(frozen=True)
class Bands:
    """Numbers of minima and bands for a threshold.

    A band holds as many minima as still leave a pair at the threshold without a common band
    less often than once in ``1 / miss``.
    """

    threshold: float
    hashes: int = 200
    bits: int = 4
    miss: float = 1e-9

    @property
    def rows(self) -> int:
        fits = [r for r in range(1, 17) if (1 - self.threshold**r) ** (self.hashes // r) <= self.miss]
        return max(fits, default=1)

    @property
    def count(self) -> int:
        return self.hashes // self.rows

    @property
    def least_estimate(self) -> float:
        """Six standard deviations of the estimate below the threshold."""
        chance = 2.0**-self.bits
        p = self.threshold + (1 - self.threshold) * chance
        return self.threshold - 6 * math.sqrt(p * (1 - p) / self.hashes) / (1 - chance)


@lru_cache(maxsize=2)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240101)
    return made.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), made.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The least value of each hash function over each set (none of them empty)."""
    out = np.empty((len(sets), hashes), dtype=np.uint32)
    times, plus = _functions(hashes)
    first = 0
    while first < len(sets):
        last, size = first + 1, len(sets[first])
        while last < len(sets) and size + len(sets[last]) < 60_000:
            size += len(sets[last])
            last += 1
        values = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[first : last - 1]]])
        for k in range(hashes):
            out[first:last, k] = np.minimum.reduceat(_scramble(values * times[k] + plus[k]), starts)
        first = last
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint32(15))


def band_hashes(low: np.ndarray, bands: Bands) -> np.ndarray:
    """A signed 64-bit hash of the minima of each band, the band's number taken in."""
    total = np.zeros((len(low), bands.count), dtype=np.uint64) + np.arange(bands.count, dtype=np.uint64)
    cells = low[:, : bands.count * bands.rows].reshape(len(low), bands.count, bands.rows).astype(np.uint64)
    for k in range(bands.rows):
        total = mixed(total * _STEP + cells[:, :, k] + np.uint64(1))
    return total.view(np.int64)


def packed(low: np.ndarray, bands: Bands) -> np.ndarray:
    """The low bits of the minima, packed; a row of bytes per set."""
    bits = (low[:, :, None] >> np.arange(bands.bits, dtype=np.uint32)) & 1
    return np.packbits(bits.reshape(len(low), -1).astype(np.uint8), axis=1)


def estimates(a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
    """Similarities from packed rows: equal values are counted by bits, and those equal by chance
    taken off."""
    differ = a ^ b
    if bands.bits == 4:
        wrong = differ | (differ >> 1) | (differ >> 2) | (differ >> 3)
        equal = bands.hashes - np.bitwise_count(wrong & 0x11).sum(axis=-1, dtype=np.int64)
    else:
        cells = np.unpackbits(differ, axis=-1)[..., : bands.hashes * bands.bits]
        equal = (~cells.reshape(*differ.shape[:-1], bands.hashes, bands.bits).any(axis=-1)).sum(axis=-1)
    chance = 2.0**-bands.bits
    return (equal / bands.hashes - chance) / (1 - chance)
