"""Expressions over the arrays of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it: Catalyst shares nothing inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def children_of(tokens: Column, links: Column) -> Column:
    """Per token the array of its links (link_ix, dep, label), in their order; links with an end outside the sentence are left out.

    The links are sorted by head together with a mark per token, and cut at the marks: n log n in the sentence's length.
    """
    inside = lambda x: x["head"].between(0, F.size(tokens) - 1) & x["dep"].between(0, F.size(tokens) - 1)
    found = F.transform(F.filter(F.transform(links, lambda x, i: F.struct(x["head"].alias("head"), i.alias("link_ix"), x["dep"].alias("dep"), x["label"].alias("label"))), inside), lambda x: x)
    marks = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda t: F.struct(t.alias("head"), F.lit(-1).alias("link_ix"), F.lit(None).cast("int").alias("dep"), F.lit(None).cast("string").alias("label")))

    def cut(all_links: Column) -> Column:
        starts = F.filter(F.transform(all_links, lambda x, i: F.when(x["link_ix"] == -1, i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, t: F.slice(all_links, at + 2, F.coalesce(F.get(s, t + 1), F.size(all_links)) - at - 1)))

    return let(F.sort_array(F.concat(marks, found)), cut)
