"""Column expressions shared by the operators. All run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, each counted once."""
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def best_of(scores: dict[str, Column]) -> Column:
    """(score, priority, name) of the highest score; on equal scores the first
    name. Each score is written into the plan once."""
    ranked = enumerate(scores.items())
    return F.greatest(
        *[
            F.struct(score.alias("score"), F.lit(-i).alias("priority"), F.lit(name).alias("name"))
            for i, (name, score) in ranked
        ]
    )


def any_word(words: list[str]) -> str:
    """Regex for one of the words as a whole word, without regard to case."""
    return rf"(?i)(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"


def has_word(text: Column, low: Column, words: list[str]) -> Column:
    """Whether one of the words occurs as a whole word. ``low`` is the text in
    lower case: a substring search rules most lines out before the regex runs."""
    stems = [w.lower() for w in words]
    stems = [w for w in stems if not any(o != w and o in w for o in stems)]
    return contains_any(low, stems) & text.rlike(any_word(words))


def matches_pattern(text: Column, low: Column, pattern: str) -> Column:
    """Search for a pattern made of literal pieces with optional blanks between.

    The pieces are looked for as substrings of ``low``; only where all occur and
    blanks matter does the regex itself run.
    """
    pieces = [re.sub(r"\\(.)", r"\1", p).lower() for p in re.split(r"\\s[+*]", pattern)]
    found = reduce(lambda a, b: a & b, [low.contains(p) for p in pieces if p])
    return found if len(pieces) == 1 else found & text.rlike(f"(?i){pattern}")


def matches_attack(text: Column, low: Column, category: str) -> Column:
    return reduce(
        lambda a, b: a | b,
        [matches_pattern(text, low, p) for p in dims.ATTACK_PATTERNS[category]],
    )


def first_match(c: Column, pattern: str) -> Column:
    """First match of the whole pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def line_timestamp(line: Column) -> Column:
    return first_match(line, dims.LINE_TIME)


def parse_line_timestamp(ts: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(ts, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def line_level(line: Column, low: Column) -> Column:
    return F.when(has_word(line, low, dims.ERROR_WORDS), F.lit("ERROR")).when(
        has_word(line, low, dims.WARNING_WORDS), F.lit("WARNING")
    )


def clean_line(line: Column) -> Column:
    """Digits out, other non-word characters to blanks, lower case, stripped."""
    bare = F.regexp_replace(line, r"\p{Nd}+", "")
    bare = F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.lower(bare))


def tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more word characters, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}{{2,}})"), F.lit(1))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(stop_words))


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours."""
    pairs = F.zip_with(
        words,
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    # zip_with pads the shorter side, so the last word stands alone: drop it.
    return F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def safe_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} ._-]", ""))


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def head(text: Column, chars: int | None) -> Column:
    """The first characters of a text, or all of it."""
    return text if chars is None else F.substring(text, 1, chars)
