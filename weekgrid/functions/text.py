"""Text folding, slugs and address white space."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekgrid.functions.base import WS_RUN, blank_null, constant_array, let, squeeze

HANGUL = r"[\uAC00-\uD7A3]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without U+0300-036F, from the Unicode tables of Python.

    Returns characters that become one character, their images, characters that
    vanish, and characters that become several.
    """
    source, image, gone, several = [], [], [], {}
    for point in range(0x80, 0x30000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        out = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)
        if out == char:
            continue
        if not out:
            gone.append(char)
        elif len(out) == 1:
            source.append(char)
            image.append(out)
        else:
            several[char] = out
    return "".join(source), "".join(image), "".join(gone), several


def _jamo(char: Column) -> Column:
    """A Hangul syllable to its two or three letters."""
    offset = F.ascii(char) - 0xAC00
    lead = constant_array(chr(0x1100 + i) for i in range(19))
    vowel = constant_array(chr(0x1161 + i) for i in range(21))
    tail = constant_array(["", *(chr(0x11A8 + i) for i in range(27))])
    return F.concat(
        F.get(lead, F.floor(offset / 588).cast("int")),
        F.get(vowel, F.floor(F.pmod(offset, F.lit(588)) / 28).cast("int")),
        F.get(tail, F.pmod(offset, F.lit(28))),
    )


def _spread(text: Column) -> Column:
    """Characters that become several, one by one; only rows that hold any come here."""
    several = _fold_tables()[3]
    members = F.lit("".join(several))

    def image(char: Column) -> Column:
        at = F.instr(members, char)
        return (
            F.when(char.rlike(HANGUL), _jamo(char))
            .when((F.length(char) > 0) & (at > 0), F.get(constant_array(several.values()), at - 1))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(text, ""), image), "")


def fold_marks(value: Column) -> Column:
    """Compatibility-decompose and drop combining accents; ASCII rows pass untouched.

    Each step runs once a row, however often the next one looks at its outcome.
    """
    source, image, gone, several = _fold_tables()

    def parted(single: Column) -> Column:
        spreads = single.rlike(HANGUL) | (F.translate(single, "".join(several), "") != single)
        return F.when(spreads, _spread(single)).otherwise(single)

    def folded(text: Column) -> Column:
        single = F.translate(text, source + gone, image)
        return F.when(text.rlike(r"[^\x00-\x7F]"), let(single, parted)).otherwise(text)

    return let(value, folded)


def search_fold(value: Column) -> Column:
    """Accent-, case- and space-insensitive form for keyword search."""
    return squeeze(F.lower(fold_marks(value)))


def slug_text(value: Column) -> Column:
    """ASCII slug of any length."""
    dashed = F.regexp_replace(fold_marks(F.lower(value)), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def slugify(value: Column) -> Column:
    """ASCII slug of at most 80 characters; for display and for names, not to tell rows apart."""
    return F.substring(slug_text(value), 1, 80)


def short_key(value: Column, most: int) -> Column:
    """A key of at most `most` characters (24 or more): the value itself, or its head and a digest of all of it."""
    tail = F.substring(F.sha2(value, 256), 1, 16)
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 17), F.lit("-"), tail))


def alnum_slug(value: Column) -> Column:
    """Slug that keeps every Unicode letter and digit, as the roll-up keys use."""
    return F.btrim(F.regexp_replace(F.lower(value), r"(?U)[^\p{Alnum}]+", "-"), F.lit("-"))


def clean_part(value: Column) -> Column:
    """One address part: single blanks, no trailing comma, empty as null."""
    single = F.regexp_replace(value, WS_RUN, " ")
    return blank_null(F.trim(F.regexp_replace(single, " *, *$", "")))


def collapse_address(value: Column) -> Column:
    single = F.regexp_replace(value, WS_RUN, " ")
    return blank_null(F.trim(F.regexp_replace(single, " *, *", ", ")))


def same_name(left: Column, right: Column) -> Column:
    """Equal but for case and accents; false when either side is empty."""
    equal = F.lower(fold_marks(left)) == F.lower(fold_marks(right))
    return F.coalesce((left != "") & (right != "") & equal, F.lit(False))
