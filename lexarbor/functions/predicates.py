"""Restrictions of the pattern language as boolean columns over a token struct."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import named_feature, tag_feature
from ..plans.structures import Component, Restriction


def morphology(token: Column, features, ud: bool) -> Column:
    """Each feature is present with one of its values, or, negated, not present with one. The root never passes.

    In the positional system keys are in lower case and the negation of POS is not heeded. Features are looked for in
    the tag itself, so no token has to carry a map of them.
    """
    out = ~token["is_root"] & (token["msd"] != "")
    for key, values, negated in features:
        found = named_feature(token["msd"], key, values) if ud else tag_feature(token["msd"], key.lower(), values)
        out &= ~found if negated and (ud or key.lower() != "pos") else found
    return out


def lexis(token: Column, lemmas) -> Column:
    return token["lemma"].isin(*lemmas)


def space(token: Column, kinds) -> Column:
    before, after = token["previous_glue"], token["glue"]
    tests = {"neither": ~before & ~after, "left": before & ~after, "right": ~before & after, "both": before & after}
    return reduce(or_, (tests[k] for k in kinds))


def restriction(token: Column, r: Restriction, ud: bool) -> Column:
    if r.kind == "morphology":
        return morphology(token, r.features, ud)
    values = {k: v for k, v, _ in r.features}
    return lexis(token, values["lemma"]) if r.kind == "lexis" else space(token, values["contact"])


def accepts(component: Component, token: Column, ud: bool) -> Column:
    """All restrictions of a component, or any of them where they are alternatives; none: every token, the root too."""
    tests = [restriction(token, r, ud) for r in component.restrictions]
    return reduce(or_ if component.any_of else and_, tests) if tests else F.lit(True)


def in_order(order: str, head: Column, dep: Column) -> Column:
    if order == "from-to":
        return head["int_id"] < dep["int_id"]
    return head["int_id"] > dep["int_id"] if order == "to-from" else F.lit(True)
