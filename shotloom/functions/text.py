"""Tokenisation, token counting and SQL-text cleaning as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (also used verbatim by the DuckDB oracle).
WORD_RE = r"[\p{L}\p{N}_]+"
WORD_PUNCT_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """Word-or-punctuation tokens, case kept (question tokens)."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD_PUNCT_RE), 0)


def sql_tokens(col) -> Column:
    """Word-or-punctuation tokens of lower-cased SQL (query tokens)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(WORD_PUNCT_RE), 0)


def words(col) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD_RE), 0)


def token_count(col) -> Column:
    """Default token counter (T1): number of word-or-punctuation tokens."""
    return F.size(tokens(col)).cast("bigint")


# --- SQL text cleaning (C1-C6) -------------------------------------------------

def replace_cur_year(col) -> Column:
    """``YEAR(CURDATE())`` (any case, any inner spacing) -> ``2020``."""
    return F.regexp_replace(_c(col), r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)\s*", "2020")


def collapse_ws(col) -> Column:
    """Newlines to spaces, runs of whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def cut_comment(col) -> Column:
    """Keep the text before the first ``/*``."""
    return F.substring_index(_c(col), "/*", 1)


def strip_fences(col) -> Column:
    """C3 (X18 fixed): drop a leading code fence with its language tag and a trailing fence."""
    c = F.regexp_replace(F.trim(_c(col)), r"^(SELECT )?```(sql)?\s*", "")
    return F.trim(F.regexp_replace(c, r"\s*```$", ""))


def ensure_select(col) -> Column:
    """Prefix ``SELECT `` unless the statement already starts with SELECT or WITH."""
    c = _c(col)
    return F.when(F.lower(c).startswith("select") | F.lower(c).startswith("with"), c) \
        .otherwise(F.concat(F.lit("SELECT "), c))


def join_split_ops(col) -> Column:
    """``> =`` / ``< =`` / ``! =`` -> ``>=`` / ``<=`` / ``!=``."""
    return F.regexp_replace(_c(col), r"([<>!])\s+=", "$1=")


def double_to_single_quotes(col) -> Column:
    """``"word"`` -> ``'word'``."""
    return F.regexp_replace(_c(col), r'"([^"]*)"', "'$1'")


def postprocess_sql(col) -> Column:
    """C4: whitespace collapse, comment cut, fence strip, SELECT prefix."""
    return ensure_select(strip_fences(F.trim(cut_comment(collapse_ws(col)))))
