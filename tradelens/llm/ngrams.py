"""Hashed byte n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tradelens.llm.common import chunks

PIECE = 1 << 20


def _slots(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot of the n-gram that starts at each byte."""
    gram = data[:len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        gram = gram * np.uint32(257) + data[k:len(data) - n + 1 + k]
    return ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - bits)


def counts(text: bytes | None, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each slot occurs in the whole text; a long text is read in pieces, each with the bytes that its last grams need."""
    total = np.zeros(1 << bits, dtype=np.float32)
    data = b" " + (text or b"").lower() + b" "
    for n in sizes:
        for piece in chunks(data, PIECE, n - 1):
            if len(piece) >= n:
                total += np.bincount(_slots(np.frombuffer(piece, dtype=np.uint8), n, bits), minlength=1 << bits)
    return total


def unit(total: np.ndarray) -> np.ndarray:
    """Square roots of the shares: vectors of length 1, or 0 without grams."""
    return np.sqrt(total / np.maximum(total.sum(axis=-1, keepdims=True), 1)).astype(np.float32)


def passages(text: bytes | None, length: int, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """One unit vector per passage of ``length`` bytes of the whole text, in blocks of rows; a text without any has one empty passage."""
    for piece in chunks((text or b" ").lower() or b" ", PIECE // length * length):
        data = np.frombuffer(piece, dtype=np.uint8)
        n = -(-len(data) // length)
        total = np.zeros(n << bits, dtype=np.float32)
        for size in sizes:
            if len(data) >= size:
                slots = _slots(data, size, bits).astype(np.int64)
                total += np.bincount((np.arange(len(slots)) // length << bits) + slots, minlength=n << bits)
        yield unit(total.reshape(n, 1 << bits))
