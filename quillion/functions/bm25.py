"""BM25 as column expressions; literals are doubles, never decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75
#: Scores are rounded before they are ordered, so that equal documents tie whatever the order of summation.
DECIMALS = 6


def _c(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def idf(n: Column | str, df: Column | str) -> Column:
    return F.log(F.lit(1.0) + (_c(n) - _c(df) + 0.5) / (_c(df) + 0.5))


def contribution(idf: Column | str, tf: Column | str, length: Column | str, average: Column | str) -> Column:
    """One term's part of a document's score; it grows with tf and falls with the length where idf is not negative."""
    tf = _c(tf)
    return _c(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * _c(length) / _c(average)))


def average_length(total: Column | str, n: Column | str) -> Column:
    """The mean length; 1 where there is no term at all."""
    return F.when(_c(total) == 0, F.lit(1.0)).otherwise(_c(total) / _c(n))


def rounded(score: Column) -> Column:
    return F.round(score, DECIMALS)
