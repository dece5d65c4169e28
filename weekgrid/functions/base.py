"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space as browsers define it; Java's \s alone is ASCII-only.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Runs of white space that are not one blank already; a range test passes over printable ASCII, which the class above
# tests sign by sign.
WS_RUN = f"(?=[^!-~])(?: (?=[^!-~]){WS}+|(?! ){WS}+)"
# A code point that no text holds.
MARK = "\uffff"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Like withColumns, but every value is computed exactly once.

    Filters and projections above are otherwise rewritten in terms of the columns below, which
    copies long expressions once per use. A one-row generator is a border they do not cross.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_CHARS))


def squeeze(value: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, WS_RUN, " "))


def blank_null(value: Column) -> Column:
    """Null for the empty text. A nullif evaluates its input twice in lambdas and branches, this once."""
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


def filled(value: Column) -> Column:
    """True where the text is neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def join_filled(separator: str, *values: Column) -> Column:
    """Join the non-empty texts; null when none is left."""
    return blank_null(F.concat_ws(separator, *[blank_null(v) for v in values]))


def extract(value: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null where the pattern or the group does not match."""
    return blank_null(F.regexp_extract(value, pattern, group))


def number(value: Column) -> Column:
    """Decimal text to double; anything else is null."""
    trimmed = strip(value)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def constant_array(items: Iterable[str]) -> Column:
    """Constant list of texts as one literal, whatever its length."""
    return F.split(F.lit("\u0001".join(items)), "\u0001")


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Small constant table; null for an unknown key."""
    text = "\u0001".join(f"{k}\u0002{v}" for k, v in table.items())
    return F.element_at(F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002")), key)


def split_before(value: Column, pattern: str) -> Column:
    """Pieces that begin where `pattern` matches, and what stands before the first.

    A mark is set before each match and split at: a split compiles its pattern anew for every row, unless it is one sign.
    """
    return F.split(F.regexp_replace(value, f"(?={pattern})", MARK), MARK)


def first_filled(values: Column) -> Column:
    """First non-null element of an array."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def fixed3(value: Column) -> Column:
    return F.format_string("%.3f", value)
