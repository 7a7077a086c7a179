"""Text functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(html: str) -> Column:
    """Text of a page without its tags, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.col(html), "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def ngrams(text: str, n: int) -> Column:
    """Distinct character n-grams. The text is cut into characters once; substring() in a loop would scan it each time."""
    chars = F.split(F.col(text), "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == n))
