"""Helpers over column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: inside other functions' steps it would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s+$", "")


BOUND = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: A letter or digit, or a class of them, that must stand there.
_WORD = re.compile(r"(?:[A-Za-z0-9]|\\d|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9])+\])(?![?*{])")


def ascii_bounds(pattern: str) -> str:
    """``pattern`` with every ``\\b`` spelt out by ``\\w``: Java's own takes letters beyond ASCII for words or not, by its
    version, while its ``\\w`` and RE2's ``\\b`` never do."""
    return re.sub(r"(?s)\\(.)", lambda m: m[0] if m[1] != "b" else r"(?<!\w)" if _WORD.match(pattern, m.end()) else BOUND, pattern)
