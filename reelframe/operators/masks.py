"""Three forms of binary masks and their set operations.

``Bits``: up to 64 pixels in one BIGINT.  ``Places``: the places of set pixels as an ARRAY<BIGINT>, for small masks.
``Packed``: one bit a pixel in a BINARY, eight pixels a byte from the highest bit on, for frames of any size.
read, joined, share and write are the same operations on the values of one row, for folds that pass over rows in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Bits:
    kind, arrow = "bigint", pa.int64()
    empty = staticmethod(lambda: F.lit(0).cast("bigint"))
    union = staticmethod(lambda a, b: a.bitwiseOR(b))
    is_empty = staticmethod(lambda a: a == 0)
    collect = staticmethod(lambda pos: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.cast("int"))))
    union_all = staticmethod(F.bit_or)
    read = staticmethod(lambda a: a & 0xFFFFFFFFFFFFFFFF)
    joined = staticmethod(lambda a, b: a | b)
    share = staticmethod(lambda a, b: (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0)
    write = staticmethod(lambda a: a - (1 << 64) if a >> 63 else a)

    @staticmethod
    def iou(a: Column, b: Column) -> Column:
        both, any_ = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
        return F.when(any_ > 0, both / any_).otherwise(F.lit(0.0))


class Places:
    kind, arrow = "array<bigint>", pa.list_(pa.int64())
    empty = staticmethod(lambda: F.array().cast("array<bigint>"))
    union = staticmethod(lambda a, b: F.array_union(a, b))
    is_empty = staticmethod(lambda a: F.size(a) == 0)
    collect = staticmethod(lambda pos: F.array_sort(F.collect_set(pos.cast("bigint"))))
    union_all = staticmethod(lambda a: F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))))
    read = staticmethod(frozenset)
    joined = staticmethod(lambda a, b: a | b)
    share = staticmethod(lambda a, b: len(a & b) / len(a | b) if a or b else 0.0)
    write = staticmethod(sorted)

    @staticmethod
    def iou(a: Column, b: Column) -> Column:
        any_ = F.size(F.array_union(a, b))
        return F.when(any_ > 0, F.size(F.array_intersect(a, b)) / any_).otherwise(F.lit(0.0))


class Packed:
    """Masks of one size; masks of different sizes share nothing.  No mask at all is a null.

    Unions over many rows are made by folds, which hold one mask at a time; Catalyst has no operations on the bits.
    """

    kind, arrow = "binary", pa.binary()
    is_empty = staticmethod(lambda a: a.isNull())
    read = staticmethod(lambda a: np.frombuffer(a, np.uint8))
    write = staticmethod(lambda a: a.tobytes())

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a | b if len(a) == len(b) else a

    @staticmethod
    def share(a: np.ndarray, b: np.ndarray) -> float:
        if len(a) != len(b):
            return 0.0
        any_ = int(np.bitwise_count(a | b).sum(dtype=np.int64))
        return int(np.bitwise_count(a & b).sum(dtype=np.int64)) / any_ if any_ else 0.0

    @staticmethod
    def pack(mask: np.ndarray) -> bytes | None:
        return np.packbits(mask.ravel()).tobytes() if mask.any() else None

    @staticmethod
    def unpack(bits: bytes, width: int, height: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits, np.uint8), count=width * height).reshape(height, width).view(bool)

    @staticmethod
    def box(mask: np.ndarray) -> tuple[int, int, int, int]:
        """x, y, width and height of the set pixels' bounding box; one pixel at the origin if there are none."""
        rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(rows):
            return 0, 0, 1, 1
        return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)
