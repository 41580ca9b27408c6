"""Token and n-gram arrays as SQL expressions, usable in DataFrames and in ML ``SQLTransformer`` stages."""

from __future__ import annotations

from sortflow.functions.text import blank_run_pattern

# Word characters are letters, numbers and the underscore; ASCII ones are settled by range tests.
WORD_PATTERN = r"[a-zA-Z0-9_[\x{80}-\x{10FFFF}&&[\p{L}\p{N}]]]{2,}"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def word_tokens(column: str) -> str:
    """Runs of at least two word characters, lower-cased, in text order."""
    return f"regexp_extract_all(lower({column}), {_sql_text(WORD_PATTERN)}, 0)"


def unigrams_and_bigrams(tokens: str) -> str:
    """The tokens of an array column, then each pair of neighbours."""
    pairs = (
        f"zip_with(slice({tokens}, 1, size({tokens}) - 1), slice({tokens}, 2, size({tokens}) - 1), "
        "(a, b) -> concat(a, ' ', b))"
    )
    return f"concat({tokens}, if(size({tokens}) > 1, {pairs}, cast(array() as array<string>)))"


def blank_separated(column: str) -> str:
    """Lower-cased text with one blank for every run of whitespace."""
    return f"trim(regexp_replace(lower({column}), {_sql_text(blank_run_pattern())}, ' '))"


def padded_words(column: str) -> str:
    """Whitespace-separated lower-cased words, each with a blank on both sides."""
    words = f"split({blank_separated(column)}, ' ')"
    return f"transform(filter({words}, w -> w <> ''), w -> concat(' ', w, ' '))"


def padded_word_grams(word: str, low: int, high: int) -> str:
    """Character n-grams of one padded word; a word not longer than n is emitted once and ends the run."""
    parts = []
    for n in range(low, high + 1):
        grams = (
            f"transform(sequence(1, greatest(char_length({word}) - {n - 1}, 1)), "
            f"i -> substring({word}, i, {n}))"
        )
        empty = "cast(array() as array<string>)"
        parts.append(grams if n == low else f"if(char_length({word}) >= {n}, {grams}, {empty})")
    return f"concat({', '.join(parts)})"


def char_grams(column: str, low: int, high: int) -> str:
    """Character n-grams of all words of a text."""
    return f"flatten(transform({padded_words(column)}, p -> {padded_word_grams('p', low, high)}))"
