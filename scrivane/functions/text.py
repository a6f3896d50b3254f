"""Text cleaning and counting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points that count as white space, as a regular expression class.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Inline payloads, and runs of escaped blanks.
PAYLOAD = r"[A-Za-z0-9+/]{50,}={0,2}"
BLANKS = r"(?i)(&nbsp;){5,}"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(_SPACES))


def clean(c: Column) -> Column:
    """Without inline payloads, long blank runs as one space, stripped; null and empty text unchanged."""
    return F.when(c == "", c).otherwise(strip(F.regexp_replace(F.regexp_replace(c, PAYLOAD, ""), BLANKS, " ")))


def clean_pages(pages: Column, field: str = "page_content") -> Column:
    """An array of page structs with the content of each page cleaned."""
    return F.transform(pages, lambda p: p.withField(field, clean(p[field])))


def word_count(c: Column) -> Column:
    """Words between white space of any script; null text has none."""
    return F.coalesce(F.size(F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")), F.lit(0))


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def mask_secret(c: Column, visible: int = 4) -> Column:
    """The first ``visible`` characters, the others as stars; null as the empty text."""
    v = F.coalesce(c, F.lit(""))
    return F.concat(F.substring(v, 1, visible), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(v) - visible)))
