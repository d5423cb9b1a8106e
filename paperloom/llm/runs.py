"""Sorted runs of 64-bit hashes in few bytes, dealt out by hash range."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, all first bytes first, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + planes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, 8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def packed_run(hashes: np.ndarray) -> bytes:
    """A sorted run by its differences, in six bytes each; in eight if one needs them."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    wide = bool((steps[1:] >> np.uint64(48)).any())
    return bytes([wide]) + int(hashes[0]).to_bytes(8, "little") + packed(steps[1:], 8 if wide else 6)


def unpacked_run(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u8", 1, 1).astype(np.uint64)
    return np.cumsum(np.concatenate((first, unpacked(data[9:], 8 if data[0] else 6))), dtype=np.uint64)


def edges(buckets: int) -> np.ndarray:
    """The least hash of each range but the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def ranges(hashes: np.ndarray, limits: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each hash range in which a sorted run has something."""
    cuts = [0, *np.searchsorted(hashes, limits).tolist(), len(hashes)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def summed(runs: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry of each run the sum of its hash's counts in all runs."""
    hashes, n = np.concatenate(runs), np.concatenate(counts).astype(np.int64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    totals = np.empty(len(hashes), np.int64)
    totals[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(hashes))))
    return np.split(totals, np.cumsum([len(x) for x in runs])[:-1])
