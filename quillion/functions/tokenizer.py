"""Text to terms: maximal runs of letters and digits, lower-cased after the split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    sorted(
        "if in into is it as at an a are and be but by for was with will there these then they their the this that to such or on of no not".split(),
        key=lambda w: (len(w), w),
    )
)
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def terms(text: Column | str, remove_stopwords: bool = True) -> Column:
    """The array of terms of a text, in order; a null or empty text has none.

    Letters are lowered one by one, so a capital sigma is never a final one.  The
    text is lowered before it is split, at once; only a text with a dotted capital I,
    whose lower case holds a separator, is split first.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = lambda t: F.lower(F.when(F.contains(t, F.lit("Σ")), F.replace(t, F.lit("Σ"), F.lit("σ"))).otherwise(t))
    parts = F.when(F.contains(text, F.lit("İ")), F.transform(F.split(text, SEPARATORS), low)).otherwise(F.split(low(text), SEPARATORS))
    if remove_stopwords:
        return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOPWORDS))
    return F.filter(parts, lambda t: t != "")


def query_terms(query: str, remove_stopwords: bool = True) -> list[str]:
    """The distinct terms of a query string, in the order in which they first occur."""
    import regex

    found = ("".join(c.lower() for c in t) for t in regex.findall(r"[\p{Alphabetic}\p{N}]+", query))
    return list(dict.fromkeys(t for t in found if not (remove_stopwords and t in STOPWORDS)))


def distinct_terms(query: Column | str, remove_stopwords: bool = True) -> Column:
    """The distinct terms of a column of queries."""
    return F.array_distinct(terms(query, remove_stopwords))
