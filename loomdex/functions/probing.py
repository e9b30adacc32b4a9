"""Number of comparisons of a binary search, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings that end any search among at most 2^32 terms.
STEPS = 33


def comparisons(terms: Column, rank: Column, found: Column) -> Column:
    """Terms looked at by a halving search among ``terms`` sorted ones for the one at ``rank``.

    ``rank`` is the number of terms below the one sought, ``found`` whether that one is
    there; the search stops when it meets it. 0 for an empty dictionary.
    """
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("lo"), terms.cast("bigint").alias("hi"), zero.alias("n"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        middle = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("bigint")
        hit = found & (middle == rank)
        below = middle < rank
        then = F.struct(
            F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | hit, s["hi"]).otherwise(middle).alias("hi"),
            (s["n"] + 1).alias("n"),
            hit.alias("done"),
        )
        return F.when(s["done"] | (s["lo"] >= s["hi"]), s).otherwise(then)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, lambda s: s["n"])
