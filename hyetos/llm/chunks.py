"""Words of many texts as numbers, and arrays of numbers in bytes."""

from __future__ import annotations

import numpy as np

#: An odd factor for the hash of a run, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def squeeze(values: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes as the largest needs; first bytes first, so that equal high bytes stand together."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def spread(data: bytes) -> np.ndarray:
    """The numbers that `squeeze` made bytes of."""
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<i8").ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (from 0 up) in order, and the place of each key among them; keys are sorted together with their places."""
    keys = keys.astype(np.uint64, copy=False)
    bits = len(keys).bit_length()
    drop = max(0, int(keys.max(initial=0)).bit_length() + bits - 64)
    mixed = np.sort(keys >> np.uint64(drop) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    at = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = keys[at]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = mixed >> np.uint64(bits)
    if drop and np.any(new[1:] & (head[1:] == head[:-1])):  # the dropped bits would part some keys
        return np.unique(keys, return_inverse=True)
    place = np.empty(len(keys), np.int64)
    place[at] = np.cumsum(new) - 1
    return ordered[new], place


def _power(factor: int, n: int) -> np.ndarray:
    if len(_powers.get(factor, ())) < n:
        row = np.full(max(n, 1 << 20), factor, np.uint64)
        row[0] = 1
        _powers[factor] = np.multiply.accumulate(row)
    return _powers[factor][:n]


def runs(units: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of every run of units that are inside. The hash is a polynomial's, from sums over all units."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _power(FACTOR, len(units)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(INVERSE, len(units) + 1)[starts]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return starts, ends, h ^ h >> np.uint64(31)


def cuts_of(where: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if not len(where):
        return []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
    return [(int(where[a]), int(a), int(z)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
