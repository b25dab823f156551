"""Scalar functions over columns: name keys, asset ids, number and date text, expiries."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of the name rules.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c))
ISO = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?)?\z"


def _plain_letters() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and combining marks, and what is left of them."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(128, min(sys.maxunicode, 0xFFFF)) if not 0xD800 <= i < 0xE000]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all("\u0300" <= m <= "\u036f" for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_FROM, _TO = _plain_letters()


def name_key(c: Column) -> Column:
    """Accent-insensitive key of a name. Symbols go after white space has been collapsed, so "a & b" keeps two spaces.

    Texts of one byte a character have no accents to look for.
    """
    c = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(F.translate(c, _FROM, _TO), r"[\u0300-\u036f]+", "")
    c = F.btrim(F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(bare)), F.lit(_SPACES))
    c = F.regexp_replace(c, f"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " ")
    return F.regexp_replace(c, "[^A-Za-z0-9_ -]+", "")


def url_asset_id(c: Column) -> Column:
    """The text between the first and second `/upload/`, without version and extension; null if there is none."""
    found = F.nullif(F.get(F.split(c, "/upload/"), F.lit(1)), F.lit(""))
    return F.nullif(F.regexp_replace(F.regexp_replace(found, "^v[0-9]+/", ""), r"\.[^/.]+\z", ""), F.lit(""))


def number_text(c: Column) -> Column:
    return c.cast("string")


def text_number(c: Column) -> Column:
    """Null where the text is no number."""
    return c.try_cast("double")


def iso_time(c: Column) -> Column:
    """A timestamp, or null where the text is no ISO date or time (a bare year is none)."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(c)).cast("timestamp_ntz")


def minutes_after(c: Column, minutes: int) -> Column:
    return c + F.expr(f"INTERVAL '{minutes}' MINUTE")


def new_or_old(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def money(c: Column, precision: int = 10) -> Column:
    """A double rounded once to storage, half away from zero; null where it does not fit."""
    return c.try_cast(f"decimal({precision},2)")
