"""Column builders for text: words, ROUGE tokens, n-grams, multiset tags.

All of these are built-in Spark expressions evaluated per row inside the
executor, so none of them shuffles.  Callers that reuse a derived array more
than once (``sorted_tags``) must materialise it with ``withColumn`` first so the
optimizer keeps one evaluation per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace split used for word counts (``str.split()`` in Python terms).
WS = r"\s+"
# ROUGE tokenizer: lower-case, anything outside [a-z0-9] is a separator.
ROUGE_NON_ALNUM = "[^a-z0-9]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Whitespace tokens without empties (Python ``str.split()``)."""
    return F.filter(F.split(col_(text), WS), lambda w: w != "")


def word_count(text) -> Column:
    """Number of whitespace words; 0 for '', null for null (pandas gives NaN)."""
    t = col_(text)
    return F.when(t.isNull(), F.lit(None)).otherwise(F.size(words(t)))


def rouge_tokens(text) -> Column:
    """ROUGE tokenisation: lower, non-alphanumeric -> space, split, drop empty."""
    t = F.regexp_replace(F.lower(col_(text)), ROUGE_NON_ALNUM, " ")
    return F.filter(F.split(t, " "), lambda w: w != "")


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams joined by a space; empty when fewer than n tokens.

    ``tokens`` should name a materialised column: it is read inside the
    lambda, and Spark does not share sub-expressions across lambda calls.
    """
    t = col_(tokens)
    if n == 1:
        return t
    k = F.size(t) - (n - 1)
    return F.when(
        k > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                    lambda i: F.array_join(F.slice(t, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def bigrams(tokens) -> Column:
    """Adjacent word pairs joined by a space (``tokens`` materialised)."""
    t = col_(tokens)
    k = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, k), F.slice(t, 2, k), lambda a, b: F.concat(a, F.lit(" "), b))


def all_ngrams(tokens, max_n: int) -> Column:
    """Every 1..max_n gram of a token array (used for dictionary lookups)."""
    parts = [bigrams(tokens) if n == 2 else ngrams(tokens, n) for n in range(1, max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def truncate_chars(text, n: int) -> Column:
    """Python ``s[:n]`` in code points."""
    return F.substring(col_(text), 1, n)


#: Characters that a preview shows.
PREVIEW_CHARS = 200


def preview(text, n: int = PREVIEW_CHARS) -> Column:
    """First n characters followed by '...' (always appended)."""
    return F.concat(truncate_chars(text, n), F.lit("..."))
