"""Date-mention extraction (E3) with the reference's three pattern sets.

Semantics of the reference extractor: each pattern is applied case-
insensitively, matches are scanned left to right without overlap, and a
pattern with a capture group yields only the group (so the month patterns
return the month word, e.g. ``May`` for "May 12, 2020").  ``mode='full'``
returns the whole match instead.  Results are sets of the original-case text.

Java regex classes are ASCII (``\\d`` = [0-9]); Python's are Unicode.  The
driver text has no non-ASCII digits, so the two agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# The three date pattern sets, as written in the reference.
MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
PATTERN_SETS = {
    # factuality checker
    "loose": [
        r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
        r"\d{4}",
        MONTHS + r"[a-z]*\s+\d{1,2},?\s+\d{4}",
    ],
    # temporal-consistency loss
    "strict": [
        r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
        r"\b\d{4}\b",
        MONTHS + r"[a-z]*\s+\d{1,2},?\s+\d{4}",
    ],
    # configuration list (adds day-first dates)
    "extended": [
        r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
        r"\d{4}",
        MONTHS + r"[a-z]*\s+\d{1,2},?\s+\d{4}",
        r"\d{1,2}\s+" + MONTHS + r"[a-z]*\s+\d{4}",
    ],
}


def _group(pattern: str, mode: str) -> int:
    return 1 if (mode == "reference" and "(" in pattern) else 0


def _flagged(pattern: str) -> str:
    """Case-insensitive flag, only where the pattern has letters to fold
    (digit-only patterns match the same either way, and faster without)."""
    return "(?i)" + pattern if any(c.isalpha() for c in pattern.replace("\\d", "").replace("\\s", "")
                                   .replace("\\b", "")) else pattern


def date_mentions(text, patterns: str = "loose", mode: str = "reference",
                  distinct: bool = True) -> Column:
    """Array of date mentions; a set (``array_distinct``) unless ``distinct``
    is False, which keeps every mention in pattern order."""
    t = col_(text)
    parts = [F.regexp_extract_all(t, F.lit(_flagged(p)), F.lit(_group(p, mode)))
             for p in PATTERN_SETS[patterns]]
    allm = F.concat(*parts)
    return F.array_distinct(allm) if distinct else allm


def date_match_parts(text, patterns: str = "loose") -> Column:
    """Full matches of each pattern: ``array<array<string>>``, one scan per
    pattern.  Both modes derive from it (``mentions_from_parts``), so a text
    needing full and reference-mode mentions is scanned once."""
    t = col_(text)
    return F.array(*[F.regexp_extract_all(t, F.lit(_flagged(p)), F.lit(0)) for p in PATTERN_SETS[patterns]])


def mentions_from_parts(parts: str, patterns: str = "loose", mode: str = "reference",
                        distinct: bool = True) -> Column:
    """Mentions from a materialised ``date_match_parts`` column.  A capture
    group is re-extracted from each (short) full match: the pattern matches
    its own full match from the first character, so the group is the same."""
    def regroup(p: str, g: int):
        return lambda m: F.regexp_extract(m, _flagged(p), g)

    cols = []
    for i, p in enumerate(PATTERN_SETS[patterns]):
        part = F.col(parts)[i]
        g = _group(p, mode)
        cols.append(part if g == 0 else F.transform(part, regroup(p, g)))
    allm = F.concat(*cols)
    return F.array_distinct(allm) if distinct else allm


def date_mentions_sql(x: str, patterns: str = "loose", mode: str = "reference",
                      distinct: bool = True) -> str:
    """The same extraction as DuckDB SQL (for oracle queries)."""
    parts = [f"regexp_extract_all({x}, '{_flagged(p)}', {_group(p, mode)})" for p in PATTERN_SETS[patterns]]
    allm = "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]
    if len(parts) > 2:
        allm = parts[0]
        for p in parts[1:]:
            allm = f"list_concat({allm}, {p})"
    return f"list_distinct({allm})" if distinct else allm
