"""How well a source entry serves as the base of a target entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A candidate is accepted above this score.
THRESHOLD = 25
#: Candidates lie fewer than this many entries ahead of the last match.
LOOK_AHEAD = 20


def sizes_within_two(a: Column, b: Column) -> Column:
    """The compatible size test: one size is at least half of the other, or both are 0."""
    return ((a == 0) & (b == 0)) | ((a > 0) & (b > 0) & (2 * F.least(a, b) >= F.greatest(a, b)))


def sizes_within_fifth(a: Column, b: Column) -> Column:
    """The true tolerance: the smaller size is at least 80 % of the larger, or both are 0."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def size_percent(a: Column, b: Column) -> Column:
    """The smaller size as a whole percentage of the larger; 100 if both are 0."""
    big = F.greatest(a, b)
    return F.when(big == 0, 100).otherwise(F.floor(100 * F.least(a, b) / F.nullif(big, F.lit(0)))).cast("bigint")


def score(similar: Column, distance: Column, match: Column) -> Column:
    """10 for similar sizes, 21 less the distance from the last match, 10 if at most one component differs."""
    return F.when(similar, 10).otherwise(0) + (LOOK_AHEAD + 1 - distance) + F.when(match < 3, 10).otherwise(0)
