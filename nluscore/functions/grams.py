"""Hashes of all stretches of a given length in a text, vectorised over many texts (numpy helpers of map steps)."""

from __future__ import annotations

import numpy as np

# code point beyond Unicode: closes every text, so that no stretch goes beyond it
CLOSE = 0x110000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by CLOSE, and where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[first[1:] - 1] = CLOSE
    return codes, first


def gram_hashes(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, the 64-bit hash of the stretch that starts at every code point (where it fits), as signed numbers.

    Stretches of a power of two are hashed from their halves; any other length from the two overlapping
    stretches of the greatest power of two that cover it.
    """
    out, level, size = {}, _mix(codes.astype(np.uint64) + np.uint64(1)), 1
    for length in sorted(set(lengths)):
        while size * 2 <= length:
            level = _mix(level[:-size] * np.uint64(0x9E3779B97F4A7C15) + level[size:]) if len(level) > size else level[:0]
            size *= 2
        apart = length - size
        whole = level if not apart else _mix(level[:-apart] * np.uint64(0xC2B2AE3D27D4EB4F) + level[apart:]) if len(level) > apart else level[:0]
        out[length] = (whole ^ np.uint64(length)).view(np.int64)
    return out
