"""Distinct 64-bit codes by the piece keys that close codes share, with popular keys cut finer.

Close codes share one of the fifteen keys of ``pieces_keys``.  A key that many
codes have (of flat photos, say) would pair each of them with each; so a key
of more than ``POPULAR`` codes on the one side is cut by the 42 to 44 bits that
it does not fix.  These are divided into six pieces once more, of which close
codes share two again, which gives fifteen finer keys of some 14 bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.bits import DISTANCE, WIDTHS, distance
from shelfsight.llm.readings import dhash_bits

__all__ = ["close", "cut", "dhash_bits", "keyed", "pairs", "pieces"]

#: Codes of one key from which on it is cut finer.
POPULAR = 4096
FINER = (8, 8, 7, 7, 7, 7)
#: The key of what is not cut.
WHOLE = -1


def _bits(code: str, at: int, width: int) -> str:
    return f"(shiftrightunsigned({code}, {at}) & {(1 << width) - 1}L)"


def _rest(code: str, pair: tuple[int, int]) -> str:
    """SQL of the bits of a code outside of two pieces, moved together."""
    out, at, place = [], 0, 0
    for n, w in enumerate(WIDTHS):
        if n not in pair:
            out.append(f"shiftleft({_bits(code, at, w)}, {place})")
            place += w
        at += w
    return " | ".join(out)


def cut(df: DataFrame, key: str, code: str, many: str = "true") -> DataFrame:
    """``df`` with a row for each finer key ``fine`` of a code under one of its keys; for WHOLE alone where not ``many``.

    In steps, so that no expression is repeated within another.
    """
    cases = " ".join(f"WHEN {n} THEN {_rest(code, pair)}" for n, pair in enumerate(combinations(range(len(WIDTHS)), 2)))
    starts = [sum(FINER[:n]) for n in range(len(FINER))]
    parts = [f"{_bits('_rest', at, w)} AS _part{n}" for n, (at, w) in enumerate(zip(starts, FINER, strict=True))]
    keys = ", ".join(f"_part{a} + (_part{b} << 8) + {n << 16}L" for n, (a, b) in enumerate(combinations(range(len(FINER)), 2)))
    steps = df.selectExpr("*", f"CASE WHEN {many} THEN CASE shiftright({key}, 22) {cases} END END AS _rest").selectExpr("*", *parts)
    fine = f"explode(CASE WHEN _rest IS NULL THEN array({WHOLE}L) ELSE array({keys}) END) AS fine"
    return steps.selectExpr(*(f"`{c}`" for c in df.columns), fine)


def pieces(code: str) -> str:
    """SQL of the fifteen keys of a code, as ``pieces_keys`` gives them."""
    starts = [sum(WIDTHS[:n]) for n in range(len(WIDTHS))]
    keys = (f"{_bits(code, starts[a], WIDTHS[a])} + shiftleft({_bits(code, starts[b], WIDTHS[b])}, 11) + {n << 22}L" for n, (a, b) in enumerate(combinations(range(len(WIDTHS)), 2)))
    return f"array({', '.join(keys)})"


def keyed(codes: DataFrame, code: str, name: str) -> DataFrame:
    """(key, ``name``) of the distinct codes (bigint) of a column; nulls give nothing."""
    bits = codes.where(F.col(code).isNotNull()).select(F.col(code).alias(name)).distinct()
    return bits.selectExpr(f"explode({pieces(name)}) AS key", name)


def close(a: str, b: str, most: int = DISTANCE) -> Column:
    return distance(a, b) <= most


def pairs(left: DataFrame, right: DataFrame, a: str, b: str, popular: int = POPULAR, most: int | None = None) -> DataFrame:
    """Distinct close (a, b) of two tables (key, a) and (key, b) as ``keyed`` gives them.

    A key is cut finer if more than ``popular`` codes of the left table have
    it; so a code of the right one meets at most so many under a key.  Where
    the left table is known to have at most ``most`` codes and these are no
    more than ``popular``, no key needs to be counted.
    """
    if most is not None and most <= popular:
        return left.join(right, "key").where(close(a, b)).select(a, b).distinct()
    many = left.groupBy("key").agg((F.count("*") > popular).alias("many"))
    left, right = (cut(df.join(many, "key"), "key", code, "many").drop("many") for df, code in ((left, a), (right, b)))
    return left.join(right, ["key", "fine"]).where(close(a, b)).select(a, b).distinct()
