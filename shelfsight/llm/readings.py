"""The common readings of hashes, groups and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.functions.bits import BLANK, valid_hex

#: Fixed value of the data: the placeholder of a group.
NO_GROUP = "unknown-session"


def clean_hash(c: Column | str) -> Column:
    """64 lower-case hexadecimal characters, else null."""
    return valid_hex(c, 64)


def clean_dhash(c: Column | str) -> Column:
    """16 lower-case hexadecimal characters that aren't all zero, else null."""
    x = valid_hex(c, 16)
    return F.when(x != BLANK, x)


def clean_group(c: Column | str) -> Column:
    """Trimmed lower-case group; null for null, empty and the placeholder."""
    x = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when((x != "") & (x != NO_GROUP), x)


def dhash_bits(c: Column | str) -> Column:
    """A clean dhash as signed 64-bit integer."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(c, 16, -10).cast("bigint")
