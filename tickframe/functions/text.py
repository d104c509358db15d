"""Tokens and n-grams as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_col

# A token is a run of two or more letters, digits or underscores, in any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _accent_map() -> tuple[str, str]:
    """Single characters that decompose to one base character plus marks."""
    src, dst = [], []
    for code in [*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c) -> Column:
    src, dst = _accent_map()
    return F.regexp_replace(F.translate(as_col(c), src, dst), r"[̀-ͯ]", "")


def tokens(text, accents: bool = True) -> Column:
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.regexp_extract_all(low if accents else strip_accents(low), F.lit(TOKEN), F.lit(0))


def unigrams_bigrams(words) -> Column:
    """The words followed by all pairs of neighbours.

    The words are bound to a lambda variable, so they are split only once per text.
    """

    def both(w: Column) -> Column:
        following = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
        pairs = F.zip_with(w, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, F.array_compact(pairs))

    return F.element_at(F.transform(F.array(as_col(words)), both), 1)


def term_frequencies(terms) -> Column:
    """array<struct<term, tf>> of an array of terms.

    Counted inside the row by sorting: runs of equal neighbours. No text has to be
    exploded, hashed by (text, term) and put together again just to count its words.
    """

    def runs(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(1), n),
                          lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        return F.element_at(F.transform(F.array(starts), lambda s: F.zip_with(
            s, F.concat(F.slice(s, F.lit(2), n), F.array(n + 1)),
            lambda a, b: F.struct(F.get(t, a - 1).alias("term"), (b - a).alias("tf")))), 1)

    some = F.element_at(F.transform(F.array(F.sort_array(as_col(terms))),
                                    lambda t: F.when(F.size(t) > 0, runs(t))), 1)
    return some
