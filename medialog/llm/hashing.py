"""Hashes of the tokens of many texts at once.

A token's hash is a polynomial in its bytes modulo 2^64, taken from one running sum over the
batch, so that no token becomes an object of its own.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: Bytes hashed at once, about.
PIECE = 1 << 20
WHITE = b" \t\n\v\f\r"


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)])


_tables: list[np.ndarray] = []


def _table(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n + 1:
        size = max(n, PIECE)
        _tables[:] = [_powers(_BASE, size), _powers(_BACK, size)]
    return _tables


def tokens(data: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin in ``data`` (bytes), and their hashes.

    ``kinds`` gives the kind of each byte value: runs of one kind are a token, those of kind 0 are
    none. ``values`` gives the number that each byte value counts as.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power, back = _table(len(data))
    kind = kinds[data]
    begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.concatenate([begins[1:], [len(data)]])
    real = kind[begins] > 0
    begins, ends = begins[real], ends[real]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)], dtype=np.uint64)])
    return begins, mixed((total[ends] - total[begins]) * back[begins])


def pieces(texts: list[bytes], most: int = PIECE) -> tuple[list[bytes], np.ndarray]:
    """Texts cut to ``most`` bytes or so at white space, and the place of the text each piece is of.

    A run of more than ``most`` bytes without white space is left whole.
    """
    out, owner = [], []
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            cut = max(text.rfind(bytes([w]), at + 1, at + most) for w in WHITE)
            if cut < 0:
                cut = min((c for w in WHITE if (c := text.find(bytes([w]), at + most)) >= 0), default=len(text))
            out.append(text[at:cut])
            owner.append(k)
            at = cut
        out.append(text[at:])
        owner.append(k)
    return out, np.array(owner, dtype=np.int64)
