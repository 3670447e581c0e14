"""Features of a stored tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import decode_msd


def features_of(msd: Column, ud: bool) -> Column:
    return F.str_to_map(msd, F.lit(r"\|"), F.lit("=")) if ud else decode_msd(msd)


def common_features(maps: Column) -> Column:
    """The entries that all maps of an array share, in the order of the first."""
    return F.map_filter(F.get(maps, F.lit(0)), lambda k, v: F.forall(maps, lambda m: F.coalesce(F.try_element_at(m, k) == v, F.lit(False))))


def common_tag(tags: Column) -> Column:
    """A positional tag with the characters that all tags of an array share, and - elsewhere; as long as the shortest."""
    shortest = F.array_min(F.transform(tags, F.length))
    first = F.get(tags, F.lit(0))
    at = lambda i: F.when(F.forall(tags, lambda t: F.substr(t, i, F.lit(1)) == F.substr(first, i, F.lit(1))), F.substr(first, i, F.lit(1))).otherwise("-")
    return F.when(shortest > 0, F.array_join(F.transform(F.sequence(F.lit(1), shortest), at), "")).otherwise("")
