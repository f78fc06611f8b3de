"""Bytes of packed documents: little-endian arrays in base64, hashes of outputs."""

from __future__ import annotations

import base64
import hashlib

import numpy as np


def packed(values, kind: str) -> str:
    """kind: int8, int32, float32 or uint64."""
    return base64.b64encode(np.asarray(values, dtype=np.dtype(kind).newbyteorder("<")).tobytes()).decode()


def unpacked(text: str, kind: str) -> list:
    return np.frombuffer(base64.b64decode(text), dtype=np.dtype(kind).newbyteorder("<")).tolist()


def csr(n: int, edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(offsets of n + 1, targets) of distinct edges sorted by source and target."""
    pairs = np.array(sorted(set(edges)), dtype=np.int64).reshape(-1, 2)
    offsets = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    return offsets.tolist(), pairs[:, 1].tolist()


def epoch(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


# The fold's start and factor.
START, FACTOR = 1469598103934665603, 1099511628211


def combined(epochs: list[int]) -> int:
    """One number for a list, depending on its order: a multiply and an add for each, modulo 2**64."""
    acc = START
    for e in epochs:
        acc = (acc * FACTOR + e) % (1 << 64)
    return acc
