"""Hash expressions on 64-bit fingerprints held in BIGINT columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_BITS = (1 << 64) - 1


def signed(value: int) -> int:
    """The BIGINT with the same 64 bits as an unsigned number."""
    value &= ALL_BITS
    return value - (1 << 64) if value >> 63 else value


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sql_long(bits: int) -> str:
    """BIGINT literal with these 64 bits. The smallest one has no literal of its own."""
    value = signed(bits)
    return f"{value}L" if value > -(1 << 63) else "(-9223372036854775807L - 1L)"


def array_dhash(values: str, length: int, row_width: int | None = None) -> Column:
    """Difference hash of a grid stored row by row in the array column ``values``; first comparison is the highest bit.

    ``row_width`` None compares along the whole array; otherwise the last value
    of a row is not compared with the first of the next. The comparison is
    unrolled, so it stays in generated code.
    """
    width = row_width or length
    left = [i for i in range(length - 1) if (i + 1) % width]
    if len(left) > 64:
        raise ValueError("at most 64 comparisons fit in a fingerprint")
    top = len(left) - 1
    return F.expr(" | ".join(f"if({values}[{i}] > {values}[{i + 1}], {sql_long(1 << (top - k))}, 0L)" for k, i in enumerate(left)))


def block_masks(blocks: int, within: int = ALL_BITS) -> list[int]:
    """Cut the set bits of ``within`` into equal consecutive runs, low bits first."""
    bits = [i for i in range(64) if within >> i & 1]
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def block_combos(blocks: int, distance: int) -> list[tuple[int, ...]]:
    """Every choice of the blocks that must stay equal within ``distance`` flips."""
    return list(combinations(range(blocks), blocks - distance))


def band_keys(fp: str, distance: int = 5, blocks: int = 8) -> Column:
    """Array of (combo, value): the fingerprint under the mask of each choice of blocks.

    Two fingerprints within ``distance`` differ in at most ``distance`` blocks, so
    they share the value of at least one choice: joining on (combo, value) loses
    no pair.
    """
    masks = block_masks(blocks)
    return F.expr("array(" + ", ".join(
        f"named_struct('combo', {c}, 'value', {fp} & {sql_long(sum(masks[i] for i in combo))})"
        for c, combo in enumerate(block_combos(blocks, distance))) + ")")
