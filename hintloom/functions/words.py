"""Words, word shingles and set similarity as column expressions.

A word is a maximal run of letters and digits, lower-cased. Every function maps null to null or to an empty array as stated and works on
whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null for null, empty for a text without words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def word_text(text: Column) -> Column:
    """The words of ``text`` joined by single blanks: the form in which texts count as equal."""
    return F.array_join(words(text), " ")


def runs(word_array: Column, k: int) -> Column:
    """64-bit hashes of the runs of ``k`` words, in order; empty if there are fewer than ``k`` words.

    The shifted arrays are zipped, so the words are evaluated a fixed number of times and not once per run.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    size = F.size(word_array)
    shifted = [word_array if i == 0 else F.slice(word_array, i + 1, size) for i in range(k)]
    zipped = F.slice(F.arrays_zip(*shifted), 1, size - F.lit(k - 1))
    return F.when(size >= k, F.transform(zipped, lambda run: F.xxhash64(run))).otherwise(F.array().cast("array<bigint>"))


def shingles(word_array: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``k`` words."""
    return F.array_distinct(runs(word_array, k))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays of distinct values; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def at_least(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity is at least ``threshold``; sizes that rule it out are tested first, without the intersection."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (small > 0) & (small >= large * F.lit(threshold)) & (jaccard(a, b) >= F.lit(threshold) - F.lit(1e-12))
