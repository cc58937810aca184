"""The delta block codec for ascending neighbour lists of unsigned 32-bit ids.

A list of n > 0 ids is the word n followed by blocks: a header word (delta width << 24 | number of values), the first
value, and the differences to the value before, each in 1, 2 or 4 bytes, padded to whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Fixed values of the format: the most values in a block, and the widths of deltas with the largest delta of each.
MAX_BLOCK = (1 << 24) - 1
WIDTHS = ((1, 0xFF), (2, 0xFFFF), (4, 0xFFFFFFFF))


@dataclass(frozen=True)
class CompressionOptions:
    """Deltas up to min_block values may widen a block; later ones close it. No block is longer than max_block."""

    min_block: int = 10
    max_block: int = 1000

    def __post_init__(self):
        if self.min_block > self.max_block:
            raise ValueError(f"min_block {self.min_block} is above max_block {self.max_block}")
        if self.max_block > MAX_BLOCK:
            raise ValueError(f"max_block {self.max_block} is above {MAX_BLOCK}")


# -- as columns --------------------------------------------------------------------------------------------------------


def pack(num_vals: Column, delta_size: Column) -> Column:
    """The header word of a block; an error for widths above 4 or more than MAX_BLOCK values."""
    bad = (delta_size > 4) | (num_vals > MAX_BLOCK)
    word = F.shiftleft(delta_size.cast("long"), 24).bitwiseOR(num_vals.cast("long"))
    return F.when(bad, F.raise_error(F.lit("no such block")).cast("long")).otherwise(word)


def unpack_num_vals(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(MAX_BLOCK)).cast("long")


def unpack_delta_size(packed: Column) -> Column:
    return F.shiftright(packed, 24).cast("int")


def delta_width(delta: Column) -> Column:
    """Bytes that a difference takes."""
    out = F.when(delta <= WIDTHS[0][1], F.lit(WIDTHS[0][0]))
    return out.when(delta <= WIDTHS[1][1], F.lit(WIDTHS[1][0])).otherwise(F.lit(WIDTHS[2][0]))


def block_words(num_vals: Column, delta_size: Column) -> Column:
    """Words of a block: header, first value, and the deltas padded to whole words."""
    return 2 + F.ceil(delta_size * (num_vals - 1) / 4)


# -- kernels -----------------------------------------------------------------------------------------------------------


def _blocks(widths: np.ndarray, o: CompressionOptions) -> list[tuple[int, int, int]]:
    """(first, values, width) of the blocks of a list; widths[i] is that of the delta before value i."""
    n, at, out = len(widths), 0, []
    while at < n:
        if n - at == 1:
            out.append((at, 1, 4))
            break
        end = min(n, at + o.max_block)
        free = min(end, at + max(1, o.min_block))
        width = int(widths[at + 1 : free].max(initial=1))
        wider = np.flatnonzero(widths[free:end] > width)
        end = free + int(wider[0]) if len(wider) else end
        out.append((at, end - at, width))
        at = end
    return out


def compress(values: np.ndarray, options: CompressionOptions = CompressionOptions()) -> np.ndarray:
    """The uint32 words of a list; none for an empty list. Raises ValueError if it isn't ascending or leaves 32 bits."""
    v = np.asarray(values, np.int64)
    if not len(v):
        return np.zeros(0, "<u4")
    d = np.diff(v)
    if (d < 0).any():
        raise ValueError("the list isn't ascending")
    if v[0] < 0 or v[-1] > 0xFFFFFFFF:
        raise ValueError("an id isn't an unsigned 32-bit integer")
    widths = np.concatenate([[0], np.where(d <= 0xFF, 1, np.where(d <= 0xFFFF, 2, 4))])
    parts = [np.array([len(v)], "<u4")]
    for first, n, width in _blocks(widths, options):
        deltas = d[first : first + n - 1].astype(f"<u{width}").tobytes()
        deltas += b"\0" * (-len(deltas) % 4)
        parts += [np.array([width << 24 | n, v[first]], "<u4"), np.frombuffer(deltas, "<u4")]
    return np.concatenate(parts)


def decompress(words: np.ndarray) -> np.ndarray:
    """The values of a list's words."""
    w = np.ascontiguousarray(words, "<u4")
    if not len(w):
        return np.zeros(0, np.int64)
    out, at = [], 1
    while at < len(w):
        width, n = int(w[at]) >> 24, int(w[at]) & MAX_BLOCK
        if width not in (1, 2, 4):
            raise ValueError(f"no block has deltas of {width} bytes")
        deltas = np.frombuffer(w[at + 2 : at + 2 - (-width * (n - 1) // 4)].tobytes()[: width * (n - 1)], f"<u{width}").astype(np.int64)
        out.append(int(w[at + 1]) + np.concatenate([[0], np.cumsum(deltas)]))
        at += 2 + -(-width * (n - 1) // 4)
    return np.concatenate(out)


@F.pandas_udf(ArrayType(LongType()))
def compress_column(neighbors: pd.Series) -> pd.Series:
    """array of ascending ids -> the words of their list, in blocks of 10 to 1000 values."""
    return neighbors.map(lambda x: compress(x).astype(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def decompress_column(words: pd.Series) -> pd.Series:
    return words.map(lambda x: decompress(np.asarray(x)))
