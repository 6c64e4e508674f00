"""Seating of Pitman-Yor restaurants, and packed arrays."""

from __future__ import annotations

import numpy as np
import zstandard

STRENGTH = 1.0


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform draws that depend on the seed and step only (splitmix64)."""
    with np.errstate(over="ignore"):
        x = seed + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def seat(customers: np.ndarray, base: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers; ``base`` is (strength + discount * tables) * parent probability."""
    tables = (customers > 0).astype(np.float64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        n = 1 if seated < 64 else seated // 16
        now = np.minimum(n, customers[active] - seated)
        b = base[active]
        share = now * b / (b + seated - discount * tables[active] + 1e-300)
        whole = np.floor(share)
        tables[active] += whole + (uniform(seed[active], seated) < share - whole)
        seated += n
        active = active[customers[active] > seated]
    return np.minimum(tables, customers)


def discount_of(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes first, so that bytes that are zero cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pack(planes)


def unpack_planes(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)
