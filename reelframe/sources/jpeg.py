"""Baseline JPEG pictures: three full-size components, quantisers scaled by quality, Huffman tables fitted to the picture."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The standard's example quantisers for luma and chroma, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
# Full-range luma and chroma of r, g and b in picture files.
JFIF = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
#: Places of a block along its anti-diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Both tables for a quality of 1 to 100; 50 is the standard's own."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA))


def coefficients(image: np.ndarray, quality: int) -> np.ndarray:
    """Quantised coefficients in zigzag order, a row a block: luma and both chromas of each 8 x 8 pixels in turn."""
    h, w = image.shape[:2]
    padded = np.pad(image, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float)
    planes = padded @ np.array(JFIF).T - np.array([128.0, 0.0, 0.0])
    blocks = planes.reshape(padded.shape[0] // 8, 8, -1, 8, 3).transpose(0, 2, 4, 1, 3)
    luma, chroma = quantisers(quality)
    found = (DCT @ blocks @ DCT.T).reshape(-1, 3, 64) / np.stack([luma, chroma, chroma])
    return np.rint(found).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Code length by symbol; one code more than there are symbols, since none may be all ones."""
    symbols = [int(s) for s in np.flatnonzero(counts)]
    heap = [(int(counts[s]), s, (s,)) for s in symbols] + [(0, 256, (256,))]
    lengths = dict.fromkeys([*symbols, 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    if max(lengths.values()) > 16:  # too deep for the format: all codes alike
        lengths = dict.fromkeys(lengths, max((len(lengths) - 1).bit_length(), 1))
    longest = max(lengths, key=lambda s: (lengths[s], s == 256))
    lengths[longest], lengths[256] = lengths[256], lengths[longest]  # the spare code is a longest one, so the last
    del lengths[256]
    return lengths


def _table(counts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table's definition."""
    lengths = code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], sizes[s], last, code = code, lengths[s], lengths[s], code + 1
    per = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return codes, sizes, _part(0xC4, bytes([kind]) + per + bytes(order))


def _part(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(image: np.ndarray, quality: int = 95) -> bytes:
    """An RGB picture as a JPEG file."""
    h, w = image.shape[:2]
    z = coefficients(image, quality)
    chroma = np.arange(len(z)) % 3 > 0
    first = z[:, 0].reshape(-1, 3)
    z[:, 0] = np.diff(first, axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    # Every symbol with its block, a place that orders it within the block, and the bits that follow it.
    block, at = np.nonzero(z[:, 1:])
    at = at + 1
    fresh = np.diff(block, prepend=-1) != 0
    run = at - np.where(fresh, 0, np.concatenate([[0], at[:-1]])) - 1
    value = z[block, at]
    size = _sizes(value)
    last = np.zeros(len(z), np.int64)
    np.maximum.at(last, block, at)
    long, ends = np.repeat(np.arange(len(run)), run // 16), np.flatnonzero(last < 63)
    dc = _sizes(z[:, 0])
    where = np.concatenate([np.arange(len(z)), block[long], block, ends])
    place = np.concatenate([np.zeros(len(z), np.int64), at[long] * 2, at * 2 + 1, np.full(len(ends), 200)])
    symbol = np.concatenate([dc, np.full(len(long), 0xF0), (run % 16) * 16 + size, np.zeros(len(ends), np.int64)])
    n_bits = np.concatenate([dc, np.zeros(len(long), np.int64), size, np.zeros(len(ends), np.int64)])
    number = np.concatenate([z[:, 0], np.zeros(len(long), np.int64), value, np.zeros(len(ends), np.int64)])
    order = np.lexsort((place, where))
    where, place, symbol, n_bits, number = (v[order] for v in (where, place, symbol, n_bits, number))
    extra = np.where(number < 0, number + (1 << n_bits) - 1, number)
    which = chroma[where] * 2 + (place > 0)
    codes, lengths, tables = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), b""
    for k, kind in enumerate((0x00, 0x10, 0x01, 0x11)):
        own = which == k
        c, n, definition = _table(np.bincount(symbol[own], minlength=256), kind)
        codes[own], lengths[own], tables = c[symbol[own]], n[symbol[own]], tables + definition
    total = lengths + n_bits
    word = codes << n_bits | extra
    ends_at = np.cumsum(total)
    item = np.repeat(np.arange(len(total)), total)
    bits = word[item] >> (ends_at[item] - 1 - np.arange(len(item))) & 1
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    luma, both = quantisers(quality)
    return (
        b"\xff\xd8" + _part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _part(0xDB, b"\0" + bytes(luma[ZIGZAG].tolist())) + _part(0xDB, b"\1" + bytes(both[ZIGZAG].tolist()))
        + _part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
        + tables + _part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
    )
