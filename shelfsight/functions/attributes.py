"""Attributes of goods in descriptions: patterns, normal forms, compatibility."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: the patterns of the keys, in their order, and the words of the normal forms.
_NUMBER = r"\d+(?:[.,]\d+)?"
PATTERNS = (
    ("drive", r"\b(PH[0-3]|PZ[0-3]|PHILLIPS|PHILIPS|CROSS|KEMBANG|PLUS|FLATHEAD|FLAT|SLOTTED|MINUS|TORX)\b"),
    ("dimension", rf"\b{_NUMBER}\s*[xX×*]\s*{_NUMBER}(?:\s*[xX×*]\s*{_NUMBER})?\s*(?:MM|CM|M|INCH|IN|[\"″'’])?"),
    ("measurement", rf"\b{_NUMBER}\s*(?:MM|CM|M|INCH|IN)(?!\w)|\b{_NUMBER}\s*[\"″'’]"),
    ("length", r"\b(PANJANG|PENDEK|LONG|SHORT)\b"),
    ("size", rf"\b(?:SIZE|UKURAN|SZ)\s*[:=-]?\s*{_NUMBER}\b"),
    ("model", r"\b[A-Z]{1,6}[-_]?\d{2,8}(?:[-_]\d{1,2}[A-Z]?)?[A-Z]?\b"),
    ("quantity", r"\b\d+\s*(?:PCS|PC|PACK|SET|PAIR)\b"),
    ("color", r"\b(?:RED|BLUE|GREEN|BLACK|WHITE|YELLOW|MERAH|BIRU|HIJAU|HITAM|PUTIH|KUNING)\b"),
)
PHILLIPS_WORDS = ("PLUS", "PHILLIPS", "PHILIPS", "CROSS", "KEMBANG")
FLAT_WORDS = ("MINUS", "FLAT", "FLATHEAD", "SLOTTED")
DRIVE_FAMILIES = {"philips": ("PH0", "PH1", "PH2", "PH3", "PHILLIPS"), "flat": ("FLAT",), "pozidrive": ("PZ0", "PZ1", "PZ2", "PZ3"), "torx": ("TORX",)}

Normaliser = Callable[[Column], Column]


def plain(x: Column) -> Column:
    """Without white space, comma as point."""
    return F.replace(F.regexp_replace(x, r"(?U)\s+", ""), F.lit(","), F.lit("."))


def _inches(x: Column) -> Column:
    return F.regexp_replace(x, "['’]$", '"')


def _drive(x: Column) -> Column:
    return F.when(x.isin(*PHILLIPS_WORDS), "PHILLIPS").when(x.isin(*FLAT_WORDS), "FLAT").otherwise(x)


def _dimension(x: Column) -> Column:
    return _inches(F.translate(F.upper(plain(x)), "×*", "XX"))


def _measurement(x: Column) -> Column:
    return _inches(F.upper(plain(x)))


def _length(x: Column) -> Column:
    return F.when(x == "PANJANG", "LONG").when(x == "PENDEK", "SHORT").otherwise(x)


_NORMAL: dict[str, Normaliser] = {"drive": _drive, "dimension": _dimension, "measurement": _measurement, "length": _length}


class Rules:
    """An ordered, unchangeable table of rules: a name, the key it finds, its pattern (case-insensitive) and normal form.

    ``plus`` and ``only`` give new tables; the names of a table are distinct.
    """

    def __init__(self, *table: tuple[str, str, str, Normaliser]):
        self.table = table
        self.keys = tuple(dict.fromkeys(key for _, key, _, _ in table))

    def plus(self, name: str, key: str, pattern: str, normal: Normaliser = plain) -> Rules:
        """With one more rule behind the others; ValueError if its name is taken or its pattern is none."""
        taken = {n for n, *_ in self.table}
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{name}: {e}") from e
        if name in taken:
            raise ValueError(f"{name} is the name of another rule")
        return Rules(*self.table, (name, key, pattern, normal))

    def only(self, *keys: str) -> Rules:
        return Rules(*(r for r in self.table if r[1] in keys))

    def without(self, *keys: str) -> Rules:
        return Rules(*(r for r in self.table if r[1] not in keys))


RULES = Rules(*((k, k, p, _NORMAL.get(k, plain)) for k, p in PATTERNS))


def parse(text: Column | str, rules: Rules = RULES, limit: int | None = None) -> Column:
    """array<struct<key, value, raw, rule, source>> of all matches, rule by rule; empty for null.

    The whole text is read, or its first ``limit`` characters.  The source is
    always ``parser``.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    text = text if limit is None else F.substring(text, 1, limit)

    def records(name: str, key: str, pattern: str, normal: Normaliser) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(key).alias("key"), normal(F.upper(m)).alias("value"), m.alias("raw"), F.lit(name).alias("rule"), F.lit("parser").alias("source")))

    return F.flatten(F.array(*(records(*r) for r in rules.table)))


def values(text: Column | str, rules: Rules = RULES, limit: int | None = None) -> Column:
    """map<key, sorted distinct values> of the keys that were found."""
    found = parse(text, rules, limit)

    def of(k: str) -> Column:
        own = F.transform(F.filter(found, lambda x: x["key"] == k), lambda x: x["value"])
        return F.struct(F.lit(k).alias("key"), F.array_sort(F.array_distinct(own)).alias("value"))

    each = [of(k) for k in rules.keys]
    return F.map_from_entries(F.filter(F.array(*each), lambda x: F.size(x["value"]) > 0))


def with_trusted(parsed: Column, trusted: Column) -> Column:
    """Parsed values, replaced by the trusted ones key by key; a null side counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    parsed, trusted = F.coalesce(parsed, empty), F.coalesce(trusted, empty)
    return F.map_concat(F.map_filter(parsed, lambda k, _: ~F.array_contains(F.map_keys(trusted), k)), trusted)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _families(a: Column) -> Column:
    pairs = [F.when(F.arrays_overlap(a, F.array(*(F.lit(w) for w in words))), F.lit(name)) for name, words in DRIVE_FAMILIES.items()]
    return F.filter(F.array(*pairs), lambda x: x.isNotNull())


def drive_score(a: Column, b: Column) -> Column:
    """Jaccard of the values if they meet, else one half if their families do, else 0."""
    return F.when(F.size(F.array_intersect(a, b)) > 0, jaccard(a, b)).when(F.size(F.array_intersect(_families(a), _families(b))) > 0, 0.5).otherwise(0.0)


def compatibility(a: Column | str, b: Column | str) -> Column:
    """Mean over the keys that both maps have; null if they have none in common."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    scores = F.transform(keys, lambda k: F.when(k == "drive", drive_score(F.element_at(a, k), F.element_at(b, k))).otherwise(jaccard(F.element_at(a, k), F.element_at(b, k))))
    return F.when(F.size(keys) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(keys))
