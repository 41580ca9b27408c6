"""File-name expressions, following POSIX path rules with a suffix of at least one character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sortflow.functions.text import collapse_whitespace, strip
from sortflow.functions.vocabulary import (
    DEFAULT_FALLBACK_SUFFIX,
    FALLBACK_SUFFIXES,
    MAX_NAME_CHARS,
)

# A suffix needs something before its dot and something after it.
_SPLIT_NAME = r"(?s)^(.+)\.([^.]+)\z"


def base_name(path: Column) -> Column:
    """Last path segment; trailing slashes and ``.`` segments do not count."""
    last = F.substring_index(F.regexp_replace(path, r"(/\.?)+\z", ""), "/", -1)
    return F.when(last == ".", "").otherwise(last)


def _has_suffix(name: Column) -> Column:
    return name.rlike(_SPLIT_NAME)


def stem(name: Column) -> Column:
    return F.when(_has_suffix(name), F.regexp_extract(name, _SPLIT_NAME, 1)).otherwise(name)


def extension(name: Column) -> Column:
    """Last suffix without its dot, empty if there is none."""
    return F.regexp_extract(name, _SPLIT_NAME, 2)


def featurize_name(path: Column) -> Column:
    """Lower-cased stem with blanks for ``_`` and ``-``, then an ``EXT_`` token if there is a suffix."""
    name = base_name(F.lower(path))
    words = F.translate(stem(name), "_-", "  ")
    return F.when(extension(name) != "", F.concat(words, F.lit(" EXT_"), extension(name))).otherwise(words)


def model_text_input(path: Column, content: Column) -> Column:
    """One string for models that read text: name features, then content."""
    return strip(
        F.concat(F.lit("[FILE] "), featurize_name(path), F.lit(" [CONTENT] "), collapse_whitespace(content))
    )


def path_suffixes(path: Column) -> Column:
    """Distinct lower-cased suffixes of the last segment, each with its dot."""
    name = base_name(F.lower(path))
    parts = F.split(F.regexp_replace(name, r"^\.+", ""), r"\.")
    dotted = F.transform(F.slice(parts, 2, 1_000_000), lambda part: F.concat(F.lit("."), part))
    return F.when(name.endswith("."), F.array().cast("array<string>")).otherwise(F.array_distinct(dotted))


def suffix_part(path: Column) -> Column:
    """The part of the name in which suffixes are looked for, empty if it cannot have any."""
    name = F.regexp_replace(base_name(F.lower(path)), r"^\.+", "")
    return F.when(name.endswith("."), "").otherwise(name)


def names_any_suffix(part: Column, suffixes: Sequence[str]) -> Column:
    """True if any suffix of a :func:`suffix_part` is listed: the suffix-set test, without building the set."""
    listed = "|".join(suffixes)
    return part.rlike(rf"\.(?:{listed})(?:\.|\z)")


def visible_name(path: Column) -> Column:
    """False for empty, hidden and temporary names."""
    name = base_name(path)
    return (name != "") & ~name.startswith(".") & ~name.startswith("~")


def bounded_name(name: Column) -> Column:
    return F.substring(strip(F.coalesce(name, F.lit(""))), 1, MAX_NAME_CHARS)


def ensure_filename(name: Column, label: Column, row_index: Column) -> Column:
    """The bounded name, or a made-up one from label and row index if it is blank."""
    bounded = bounded_name(name)
    suffix = F.lit(DEFAULT_FALLBACK_SUFFIX)
    for fixed_label, fixed_suffix in FALLBACK_SUFFIXES.items():
        suffix = F.when(label == fixed_label, fixed_suffix).otherwise(suffix)
    made_up = F.concat(F.lower(label), F.lit("_sample_"), row_index.cast("string"), F.lit("."), suffix)
    return F.when(bounded != "", bounded).otherwise(made_up)
