"""64-bit perceptual hashes: reading, distance and the pieces that close hashes share.

A code is cut into six pieces.  Two codes that differ in at most four bits are
equal in at least two pieces, so they share one of the fifteen keys made of
two pieces each; the keys have about 21 bits, and what shares a key is
compared exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCE = 4
WIDTHS = (11, 11, 11, 11, 10, 10)
BLANK = "0" * 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_hex(c: Column | str, digits: int) -> Column:
    """Trimmed and in lower case if it is exactly so many hexadecimal digits, else null."""
    x = F.lower(F.trim(_col(c)))
    return F.when(x.rlike(f"\\A[0-9a-f]{{{digits}}}\\z"), x)


def code(c: Column | str) -> Column:
    """A 16-digit hexadecimal hash as signed 64-bit integer; null for malformed and blank (all zero) ones."""
    x = valid_hex(c, 16)
    return F.when(x != BLANK, F.conv(x, 16, -10).cast("bigint"))


def distance(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def pieces_keys(x: Column) -> Column:
    """The fifteen keys of a 64-bit code, as array<bigint>."""
    pieces, at = [], 0
    for w in WIDTHS:
        pieces.append(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    pairs = combinations(range(len(WIDTHS)), 2)
    return F.array(*((pieces[a] + pieces[b] * F.lit(1 << 11) + F.lit(n << 22)).cast("bigint") for n, (a, b) in enumerate(pairs)))
