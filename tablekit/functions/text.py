"""Text expressions; null stays null in all of them."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, SparkSession, functions as F

from ..errors import InvalidParameter

# The characters that stripping removes by default, all that Unicode calls white space and four separators.
WHITESPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def title_case(c) -> Column:
    """Every run of letters starts with a capital, so ``o'neil-x`` gives ``O'Neil-X`` (``initcap`` looks at blanks)."""
    runs = F.regexp_extract_all(_text(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def capitalize(c) -> Column:
    c = _text(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def swap_case(c) -> Column:
    letters = F.split(_text(c), "")
    return F.array_join(F.transform(letters, lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def strip(c, chars: str | None = None) -> Column:
    """Remove any of ``chars`` (default: all whitespace) from both ends."""
    return F.btrim(_text(c), F.lit(WHITESPACE if chars is None else chars))


def replace_literal(c, old: str, new: str) -> Column:
    return F.replace(_text(c), F.lit(old), F.lit(new))


def matches(c, pattern: str) -> Column:
    return _text(c).rlike(java_regex(pattern))


def text_length(c) -> Column:
    return F.char_length(_text(c))


def java_regex(pattern: str) -> str:
    """A Python-style pattern as Spark's regex functions read it: named groups, the end-of-text anchor, and classes and
    case folding (``\\w``, ``\\d``, ``\\s``, ``\\b``, ``(?i)``) by Unicode."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


def java_replacement(replacement: str) -> str:
    """``\\1`` and ``\\g<1>`` become ``$1``; a plain ``$`` is protected."""
    replacement = replacement.replace("$", r"\$")
    replacement = re.sub(r"\\g<(\d+)>", r"$\1", replacement)
    replacement = re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", replacement)
    return re.sub(r"\\(\d+)", r"$\1", replacement)


def group_count(pattern: str) -> int:
    try:
        return re.compile(pattern).groups
    except re.error:  # valid for Java only, e.g. \\p{L}
        return len(re.findall(r"(?<!\\)\((?!\?)|\(\?P?<(?![=!])", pattern))


@functools.cache
def _compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).take(1)
    except Exception as e:
        if any(word in str(e).upper() for word in ("REGEX", "PATTERN")):
            return False
        raise
    return True


def check_regex(spark: SparkSession, pattern: str) -> str:
    """The pattern as Spark reads it; rejected while planning, on a literal, when it does not compile."""
    translated = java_regex(pattern)
    if not _compiles(spark, translated):
        raise InvalidParameter("pattern", pattern, "a valid regular expression")
    return translated
