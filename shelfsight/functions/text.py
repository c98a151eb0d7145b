"""Text functions: search terms, file names, messages, recognised words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_LIMIT, WORD_LENGTH, TEXT_LIMIT = 32, 80, 4000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(search: str) -> list[str]:
    """Lower-case terms of a search, split on any Unicode white space; none for an empty one."""
    return search.lower().split()


def matches_terms(search: str, *columns: str) -> Column:
    """Every term occurs in one of the columns, in any case; % and _ are wildcards, as in LIKE.

    A null column matches nothing; a search without terms matches all rows.
    """
    every = F.lit(True)
    for t in terms(search):
        some = F.lit(False)
        for c in columns:
            some = some | F.coalesce(F.lower(c).like(f"%{t}%"), F.lit(False))
        every = every & some
    return every


def stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(_col(path), r"([^/]*?)(\.[^./]*)?$", 1)


def numeric_stem(path: Column | str) -> Column:
    """The stem as number if it is all digits, else null."""
    s = stem(path)
    return F.when(s.rlike(r"\A[0-9]{1,18}\z"), s.cast("bigint"))


def extension(path: Column | str) -> Column:
    """Lower-case extension, jpeg as jpg; null if there is none."""
    e = F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))
    return F.when(e == "jpeg", "jpg").when(e != "", e)


def safe_sku(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\A[a-zA-Z0-9_-]+\z"), F.lit(False))


def one_line(c: Column | str, length: int = 200) -> Column:
    """The last ``length`` characters, white space collapsed."""
    return F.right(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), F.lit(length))


def error_detail(body: Column | str, length: int = 160) -> Column:
    """``detail`` of a JSON body, else the body itself; collapsed and cut."""
    body = _col(body)
    return F.substring(F.trim(F.regexp_replace(F.coalesce(F.get_json_object(body, "$.detail"), body), r"\s+", " ")), 1, length)


def names_id(message: Column | str, kind: str = "photo") -> Column:
    """The id that a message names after ``kind``; null if it names none."""
    x = F.regexp_extract(_col(message), rf"(?i)\b{kind}[ -]?#?(\d{{1,18}})", 1)
    return F.when(x != "", x.cast("bigint"))


def mentions(message: Column | str, *parts: str) -> Column:
    """One of the parts occurs, in any case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.lower(_col(message)).contains(p.lower())
    return F.coalesce(out, F.lit(False))


def token(c: Column | str) -> Column:
    """A recognised word in upper case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.upper(_col(c)), r"\s+", " "))


def recognised_words(tsv: Column | str, width: Column, height: Column, least: float = 0.0) -> Column:
    """array<struct<text, confidence, box>> of the word lines of a recogniser's tab-separated output.

    Lines of level 5 with text and a confidence from ``least`` to 100 count;
    at most 32 words of 80 characters; boxes are fractions of the image, null
    without its size or with no extent.
    """
    cells = F.transform(F.split(_col(tsv), r"\r?\n"), lambda line: F.split(line, "\t"))
    number = lambda x, i: F.get(x, F.lit(i)).try_cast("double")
    good = F.filter(cells, lambda x: (F.get(x, F.lit(0)) == "5") & number(x, 10).between(least, 100) & (F.length(F.trim(F.get(x, F.lit(11)))) > 0))

    def word(x: Column) -> Column:
        left, top, w, h = (number(x, i) for i in (6, 7, 8, 9))
        ok = (width > 0) & (height > 0) & (w > 0) & (h > 0) & (left >= 0) & (top >= 0) & (left + w <= width) & (top + h <= height)
        box = F.struct((left / width).alias("x"), (top / height).alias("y"), (w / width).alias("width"), (h / height).alias("height"))
        return F.struct(F.substring(token(F.get(x, F.lit(11))), 1, WORD_LENGTH).alias("text"), number(x, 10).alias("confidence"), F.when(ok, box).alias("box"))

    return F.transform(F.slice(good, 1, WORD_LIMIT), word)


def confidence_weight(mean: Column, least: float) -> Column:
    """(mean - least) / (100 - least) within [0, 1]; null stays null."""
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - least) / F.lit(max(1e-9, 100.0 - least)))))


def human_size(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))
