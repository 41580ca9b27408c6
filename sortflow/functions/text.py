"""Text expressions. Everything here is a built-in expression; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.vocabulary import (
    ERROR_PREVIEW_CHARS,
    EXTRACT_CHARS,
    RESULT_PREVIEW_CHARS,
)

# The 29 code points Python's str.split() takes for whitespace, inside a regex class.
WHITESPACE = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The same class for Java, laid out for speed: single Latin-1 characters are one bit test, and one
# range test settles all others.
_FAST_WHITESPACE = (
    r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)

# The same code points as a plain string, for trimming.
_WHITESPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode blanks included."""
    return F.btrim(c, F.lit(_WHITESPACE_CHARS))


def blank_run_pattern(extra: str = "") -> str:
    """Whitespace that is not already one plain blank.

    A single blank stays as it is; matching it only to put it back would cost a match per word.
    """
    blank = f"[{extra}{_FAST_WHITESPACE}]"
    return rf"{blank}(?:{blank}+|(?<! ))"


def _collapse(c: Column, extra: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), blank_run_pattern(extra), " "))


def collapse_whitespace(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim; null becomes empty."""
    return _collapse(c, "")


def normalize_text(c: Column) -> Column:
    """As :func:`collapse_whitespace`, with NUL counted as whitespace."""
    return _collapse(c, r"\x00")


def _shortest(c: Column, dtype: T.DataType) -> Column:
    """Scientific text with the fewest digits that read back as the same number."""
    kind, most, certain, denormal = ("float", 8, 5, 1e-37) if isinstance(dtype, T.FloatType) else ("double", 16, 14, 1e-307)
    wide = c.cast("double")

    def first_equal(fewest: int) -> Column:
        text = F.format_string(f"%.{most}e", wide)
        for digits in reversed(range(fewest, most)):
            shorter = F.format_string(f"%.{digits}e", wide)
            text = F.when(shorter.try_cast(kind) == c, shorter).otherwise(text)
        return text

    return F.when(wide < denormal, first_equal(0)).otherwise(first_equal(certain))


def _fraction_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a fraction: plain from 1e-4 to 1e16, else with an exponent of two digits at least."""
    text = _shortest(F.abs(c), dtype)
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), r"\.", ""), r"(?<=.)0+\z", "")
    # Null, NaN and infinity have no exponent; their text is settled below.
    exponent = F.substring_index(text, "e", -1).try_cast("int")
    n = F.char_length(digits)
    tail = lambda begin: F.substr(digits, begin, n)
    below_one = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, "0")
    plain = F.when(exponent < 0, below_one).otherwise(
        F.concat(whole, F.lit("."), F.when(n > exponent + 1, tail(exponent + 2)).otherwise("0"))
    )
    mantissa = F.when(n > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), tail(F.lit(2)))).otherwise(digits)
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    power = F.abs(exponent).cast("string")
    scientific = F.concat(mantissa, sign, F.lpad(power, F.greatest(F.char_length(power), F.lit(2)), "0"))
    size = F.abs(c.cast("double"))
    unsigned = F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)
    text = F.when(size == float("inf"), "inf").otherwise(unsigned)
    return F.when(F.isnan(c), "nan").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text))


def _number_text(c: Column, dtype: T.DataType) -> Column:
    """Decimal text of a number; zero and null become empty, fractions keep at least one digit."""
    text = _fraction_text(c, dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c.cast("string")
    return F.when(c == F.lit(0), "").otherwise(F.coalesce(text, F.lit("")))


def normalize_value(c: Column, dtype: T.DataType) -> Column:
    """Normalised text of a cell of any type; arrays are flattened at any depth, empty items dropped."""
    if isinstance(dtype, T.StringType):
        return normalize_text(c)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda item: normalize_value(item, dtype.elementType))
        return F.coalesce(F.array_join(F.filter(items, lambda item: item != ""), " "), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").otherwise("")
    if isinstance(dtype, T.NumericType):
        return _number_text(c, dtype)
    return normalize_text(c.cast("string"))


def present_fields(df: DataFrame, candidates: Sequence[str]) -> list[T.StructField]:
    """The candidate columns that ``df`` has, in candidate order, found without regard to case."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    return [fields[name.lower()] for name in candidates if name.lower() in fields]


def present_values(df: DataFrame, candidates: Sequence[str]) -> list[Column]:
    """Normalised candidate columns that ``df`` has; empty text is null."""
    found = present_fields(df, candidates)
    return [F.nullif(normalize_value(F.col(f"`{f.name}`"), f.dataType), F.lit("")) for f in found]


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First candidate column with text in it, else empty."""
    return F.coalesce(*present_values(df, candidates), F.lit(""))


def collect_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """All candidate columns with text in them, joined with blanks."""
    return F.concat_ws(" ", *present_values(df, candidates))


def extracted_text(c: Column, max_chars: int = EXTRACT_CHARS) -> Column:
    """What a text file hands to the classifier: a bounded head, cut first and stripped after."""
    return strip(F.substring(c, 1, max_chars))


def result_preview(c: Column) -> Column:
    return strip(F.substring(c, 1, RESULT_PREVIEW_CHARS))


def error_preview(c: Column) -> Column:
    return F.replace(F.substring(c, 1, ERROR_PREVIEW_CHARS), F.lit("\n"), F.lit(" "))


def percent_text(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(c * 100).cast("bigint").cast("string"), F.lit("%"))


def signed_delta(c: Column) -> Column:
    """``+0.0123`` style text, ``n/a`` for a missing value."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%+.4f", c))
