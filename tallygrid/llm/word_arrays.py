"""Hashes of the words of many texts at once, the same as ``common.word_hashes``.

Words of up to 16 bytes are hashed together, by the arithmetic that XXH3 has for short inputs, on
their first and last bytes; the few longer ones go to the library one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_SECRET = np.frombuffer(bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
    "cb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), "<u8")
_LOW = U(0xFFFFFFFF)
_UP_TO_3 = (_SECRET[0] ^ _SECRET[0] >> U(32)) & _LOW
_UP_TO_8 = _SECRET[1] ^ _SECRET[2]
_UP_TO_16 = _SECRET[3] ^ _SECRET[4], _SECRET[5] ^ _SECRET[6]


def _mixed(h: np.ndarray, *steps: int) -> np.ndarray:
    """Shifts and factors by turns."""
    for k, step in enumerate(steps):
        h = h * U(step) if k % 2 else h ^ h >> U(step)
    return h


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit product, one over the other."""
    a0, a1, b0, b1 = a & _LOW, a >> U(32), b & _LOW, b >> U(32)
    cross = a0 * b1
    middle = (a0 * b0 >> U(32)) + (cross & _LOW) + a1 * b0
    return a * b ^ a1 * b1 + (cross >> U(32)) + (middle >> U(32))


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return h << U(bits) | h >> U(64 - bits)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 with 64 bits of the parts of ``data`` that start and are as long as given, not empty."""
    found = np.zeros(len(start), U)
    padded = np.append(data, np.zeros(8, np.uint8))
    view = lambda kind: np.ndarray(len(data) + 1, kind, padded, strides=(1,))
    four, eight = view("<u4"), view("<u8")

    part = np.flatnonzero(size <= 3)
    a, n = start[part], size[part]
    h = (data[a].astype(U) << U(16) | data[a + (n >> 1)].astype(U) << U(24)
         | data[a + n - 1].astype(U) | n.astype(U) << U(8))
    found[part] = _mixed(h ^ _UP_TO_3, 33, 0xC2B2AE3D27D4EB4F, 29, 0x165667B19E3779F9, 32)

    part = np.flatnonzero((size > 3) & (size <= 8))
    a, n = start[part], size[part]
    h = four[a + n - 4].astype(U) + (four[a].astype(U) << U(32)) ^ _UP_TO_8
    h = (h ^ _rotated(h, 49) ^ _rotated(h, 24)) * U(0x9FB21C651E98DF25)
    h = (h ^ (h >> U(35)) + n.astype(U)) * U(0x9FB21C651E98DF25)
    found[part] = _mixed(h, 28)

    part = np.flatnonzero((size > 8) & (size <= 16))
    a, n = start[part], size[part]
    low, high = eight[a] ^ _UP_TO_16[0], eight[a + n - 8] ^ _UP_TO_16[1]
    h = n.astype(U) + low.byteswap() + high + _folded(low, high)
    found[part] = _mixed(h, 37, 0x165667919E3779F9, 32)

    part = np.flatnonzero(size > 16)
    for k, a, n in zip(part.tolist(), start[part].tolist(), size[part].tolist(), strict=True):
        found[k] = xxhash.xxh3_64_intdigest(data[a:a + n].tobytes())
    return found


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, in order, and how many words each text has.

    Words stand between ASCII white space, A-Z counts as a-z; a NULL text has no words.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds or bytes(8), np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    data = data | ((data - np.uint8(ord("A")) < 26).view(np.uint8) << np.uint8(5))
    inside = (data != ord(" ")) & (data - np.uint8(9) >= 5)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Words end with their text.
    for found, edge in ((first, bounds[:-1]), (last, bounds[1:] - 1)):
        edge = edge[(edge >= 0) & (edge < len(data))]
        found[edge] = inside[edge]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    return hashes(data, start, size), np.diff(np.searchsorted(start, bounds))
