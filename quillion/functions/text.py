"""Scalar functions on ids, links and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 200


def snippet(body: Column | str) -> Column:
    return F.substring(body, 1, SNIPPET)


def content_hash(title: Column | str, body: Column | str) -> Column:
    """A 64-bit hash that differs when either field does."""
    return F.xxhash64(title, body)


def percent_encode(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``-._~`` only."""
    out = F.url_encode(text)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def result_url(template: str, id: Column, title: Column) -> Column:
    """The template with ``{id}`` and ``{title}`` filled in."""
    out = F.replace(F.lit(template), F.lit("{id}"), percent_encode(id))
    return F.replace(out, F.lit("{title}"), percent_encode(title))


def bits_needed(value: Column) -> Column:
    """The width of a whole number that is not negative; 0 needs none."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("long")


def partition_cost(degree: Column, n: Column) -> Column:
    """Bits that the gaps of a term cost which occurs in ``degree`` of ``n`` documents."""
    return F.when(degree == 0, 0.0).otherwise(degree * F.log2(n.cast("double") / (degree + 1)))
