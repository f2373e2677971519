"""A PNG image from rows of RGB bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode(pixels: np.ndarray) -> bytes:
    """PNG bytes of an array of shape (height, width, 3)."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
