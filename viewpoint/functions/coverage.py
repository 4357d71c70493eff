"""Set-based extraction coverage expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewpoint.functions import text as T


def coverage(summary_set: Column, source_set: Column) -> Column:
    """|S ∩ P| / |S| for a summary token set S and source token set P; 0 when
    S is empty. Both inputs are distinct-token arrays."""
    n = F.size(summary_set)
    return F.when(n > 0, F.size(F.array_intersect(summary_set, source_set)) / n).otherwise(F.lit(0.0))


def ext_cov(source_text, summary_text, remove: Column | None = None) -> Column:
    """Coverage of a summary text by a source text, optional remove-list."""
    s = F.array_distinct(T.word_tokens(summary_text))
    p = F.array_distinct(T.word_tokens(source_text))
    if remove is not None:
        s, p = F.array_except(s, remove), F.array_except(p, remove)
    return coverage(s, p)


def ignore_as_coded(first_chars: Column, toks: Column) -> Column:
    """Characters of normalised passage 0 union the tokens of passages 1..n."""
    rest = F.flatten(F.slice(toks, 2, F.size(toks) - 1))
    return F.array_union(first_chars, F.array_distinct(rest))


def ignore_shared(toks: Column) -> Column:
    """Tokens present in every passage (all of them for a single passage)."""
    return F.aggregate(F.slice(toks, 2, F.size(toks) - 1), F.get(toks, 0), lambda acc, t: F.array_intersect(acc, t))
