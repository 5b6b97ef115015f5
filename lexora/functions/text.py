"""Column functions on text: trimming, splitting, sentences, runs, percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexora.constants import BLANK, QUERY_KEPT, SCRIPTS, SENTENCE, TRIMMED


def trimmed(s: Column) -> Column:
    """s without Unicode white space and line ends on either side."""
    return F.regexp_replace(s, f"^[{TRIMMED}]+|[{TRIMMED}]+$", "")


def is_blank(s: Column) -> Column:
    return ~s.rlike(f"[^{BLANK}]")


def parts(s: Column, mark: str) -> Column:
    """The trimmed parts of s between marks, without empty ones."""
    return F.filter(F.transform(F.split(s, mark), trimmed), lambda x: x != "")


def sentences(s: Column) -> Column:
    """White space ends a sentence and is in none; an end mark closes one and is in it; a further mark is one of its own."""
    return F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(0))


def runs(s: Column, script: str = "han") -> Column:
    """The longest stretches of the script's characters."""
    return F.regexp_extract_all(s, F.lit(f"[{SCRIPTS[script]}]+"), F.lit(0))


def is_script(s: Column, script: str = "han") -> Column:
    """Whether s is one character of the script; false for null and empty text."""
    return F.coalesce(s.rlike(f"^[{SCRIPTS[script]}]$"), F.lit(False))


def percent_encoded(s: Column) -> Column:
    """s for the query part of a URL; "&", "+" and "=" stay as they are."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for c in QUERY_KEPT:
        if c not in "-._*":  # these are never encoded
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def quoted(s: Column) -> Column:
    """s as the inside of a JavaScript template literal."""
    for a, b in (("\\", "\\\\"), ("`", "\\`"), ("$", "\\$"), ("\r", "")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
