"""Association measures over counts: f of the pair, fx and fy of its words, n of the corpus. A zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delta_p(f: Column, fx: Column, fy: Column, n: Column) -> Column:
    """How much likelier y is with x than without; delta_p(f, fy, fx, n) is the other direction."""
    return F.try_divide(f, fx) - F.try_divide(fy - f, n - fx)


def log_dice(f: Column, counts: Column) -> Column:
    """14 + log2(k f / sum) over the array of the k positive counts of the words."""
    found = F.filter(counts, lambda x: x > 0)
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)
    return 14 + F.log2(F.try_divide(F.size(found) * f, total))
