"""Column expressions on text: cleaning, tokens, and the checks of the corpus grammar."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.postings import TERM_PATTERN

#: Runs of Unicode White_Space; the plain \s class of Java knows only the ASCII ones.
WHITE_SPACE = r"\p{IsWhite_Space}+"

#: Runs that the cleaner keeps. A positive class: negated ones are matched ten times slower.
KEPT = "([A-Za-z0-9]+)"


def words(value: Column) -> Column:
    """Array of the runs of ASCII letters and digits, the tokens of a cleaned text; null for null."""
    return F.regexp_extract_all(value, F.lit(KEPT), 1)


def clean_text(value: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one blank; outer blanks go. Null stays null."""
    return F.array_join(words(value), " ")


def tokens(value: Column) -> Column:
    """Array of the white-space separated tokens; empty for a blank text, null for null."""
    return F.filter(F.split(value, WHITE_SPACE), lambda t: t != "")


def is_term(token: Column) -> Column:
    """Whether a token keeps to the grammar: one or more ASCII letters and digits."""
    return token.rlike(TERM_PATTERN)


def is_query_term(term: str) -> bool:
    """The same for a term asked for."""
    return isinstance(term, str) and re.fullmatch(r"[A-Za-z0-9]+", term, re.ASCII) is not None


def check_query_term(term: str) -> str:
    """The term if it keeps to the grammar, else ValueError; runs before any plan is built."""
    if not is_query_term(term):
        raise ValueError("query must be one ASCII-alphanumeric word")
    return term
