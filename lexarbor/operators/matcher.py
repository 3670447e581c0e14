"""Tree patterns as one expression over the arrays of a sentence row.

A pattern is tried at every token that may be its root; below it, the links of a token are those of its own list, so a
required, optional or forbidden child is a filter, a product or a test on short arrays. Nothing is joined, shuffled or
read twice, however large the pattern and however many patterns: a catalogue is one scan and one explode.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import children_of, let
from ..functions.predicates import accepts, in_order
from ..plans.structures import Catalogue, Component, Structure
from ..sources.corpus import KEY, Corpus


def slot(cid: str) -> str:
    return "c_root" if cid == "#" else f"c_{cid}"


class _Sentence:
    """Compiles the components of a pattern for one sentence; embeddings are structs of token places (c_*) and link orders (o_*)."""

    def __init__(self, tokens: Column, children: Column, ud: bool):
        self.tokens, self.children, self.ud = tokens, children, ud

    def below(self, component: Component, at: Column) -> tuple[Column, list[str]]:
        """The embeddings of a component and all below it, with the component at a token, and the names of their fields."""
        names = [slot(component.cid)]
        own = F.array(F.struct(at.alias(names[0])))
        for child in component.children:
            theirs, new = self.child(child, at)
            if child.status == "forbidden":
                none = F.size(theirs) == 0
                own = F.filter(own, lambda p: none)  # noqa: B023
                continue
            own = let(theirs, self._product(own, names, new, child.status == "optional"))
            names = names + new
        return own, names

    def child(self, child: Component, head: Column) -> tuple[Column, list[str]]:
        """The embeddings below the links of a head that fit the child."""
        token = lambda i: F.get(self.tokens, i)
        fits = lambda x: x["label"].isin(*child.labels) & in_order(child.order, token(head), token(x["dep"])) & accepts(child, token(x["dep"]), self.ud)
        links = F.filter(F.get(self.children, head), fits)
        place = F.array(*map(F.lit, child.labels))
        order = f"o_{child.cid}"
        step = lambda x: (F.array_position(place, x["label"]) * (1 << 40) + x["link_ix"]).cast("long").alias(order)
        if not child.children:
            return F.transform(links, lambda x: F.struct(step(x), x["dep"].alias(slot(child.cid)))), [order, slot(child.cid)]
        fields: list[str] = []

        def deeper(x: Column) -> Column:
            found, fields[:] = self.below(child, x["dep"])
            return F.transform(found, lambda e: F.struct(step(x), *(e[n].alias(n) for n in fields)))

        theirs = F.flatten(F.transform(links, deeper))
        return theirs, [order, *fields]

    @staticmethod
    def _product(own: Column, names: list[str], new: list[str], optional: bool):
        bound, fresh = ([n for n in x if n.startswith("c_")] for x in (names, new))
        differ = lambda p, e: reduce(and_, (p[a].isNull() | e[b].isNull() | (p[a] != e[b]) for a in bound for b in fresh))
        merged = lambda p, e: F.struct(*(p[n].alias(n) for n in names), *(e[n].alias(n) for n in new))
        absent = lambda p: F.struct(*(p[n].alias(n) for n in names), *(F.lit(None).cast("long" if n.startswith("o_") else "int").alias(n) for n in new))

        def body(theirs: Column) -> Column:
            found = F.flatten(F.transform(own, lambda p: F.transform(F.filter(theirs, lambda e: differ(p, e)), lambda e: merged(p, e))))
            return F.when(F.size(theirs) == 0, F.transform(own, absent)).otherwise(found) if optional else found

        return body

    def matches(self, structure: Structure) -> Column:
        """array<struct<structure_ix, tok, steps, words>> of a structure's embeddings."""
        root, fields = structure.root, []
        roots = F.filter(F.sequence(F.lit(0), F.size(self.tokens) - 1), lambda t: accepts(root, F.get(self.tokens, t), self.ud))

        def grown(t: Column) -> Column:
            found, fields[:] = self.below(root, t)
            return found

        found = F.flatten(F.transform(roots, grown))
        orders, slots = ([n for n in fields if n.startswith(x)] for x in ("o_", "c_"))

        def told(e: Column) -> Column:
            steps = F.array(*(F.coalesce(e[o], F.lit(0).cast("long")) for o in orders)) if orders else F.array().cast("array<long>")
            entries = F.array(*(F.struct(F.lit("#" if s == "c_root" else s[2:]).alias("key"), F.get(self.tokens, e[s]).alias("value")) for s in slots))
            return F.struct(F.lit(structure.ix).alias("structure_ix"), e[slots[0]].alias("tok"), steps.alias("steps"), F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("words"))

        return F.transform(found, told)


def _match(corpus: Corpus, structures: tuple[Structure, ...]) -> DataFrame:
    def all_of(tokens: Column):
        def with_children(children: Column) -> Column:
            sentence = _Sentence(tokens, children, corpus.ud)
            return F.concat(*map(sentence.matches, structures))

        return with_children

    found = let(F.col("tokens"), lambda tokens: let(children_of(tokens, F.col("links")), all_of(tokens)))
    ids = F.create_map(*(F.lit(x) for s in structures for x in (s.ix, s.id)))
    rows = corpus.sentences.select(*KEY, F.explode(found).alias("m"))
    order = F.struct("file_ix", F.col("m.structure_ix").alias("structure_ix"), "sent_ix", F.col("m.tok").alias("tok"), F.col("m.steps").alias("steps"))
    return rows.select(*KEY, ids[F.col("m.structure_ix")].alias("structure_id"), F.col("m.structure_ix").alias("structure_ix"), order.alias("found"), F.col("m.words").alias("words"))


def match_structure(corpus: Corpus, structure: Structure) -> DataFrame:
    """The embeddings of one structure: KEY, structure_id, structure_ix, found (their order) and words map<cid, token>."""
    return _match(corpus, (structure,))


def fixed_order(matches: DataFrame) -> DataFrame:
    """Only embeddings whose component numbers ascend with their words; # does not count."""
    numbered = F.filter(F.map_entries("words"), lambda e: e["key"] != "#")
    by_place = F.transform(F.array_sort(F.transform(numbered, lambda e: F.struct(e["value"]["int_id"].alias("at"), e["key"].cast("int").alias("cid")))), lambda x: x["cid"])
    return matches.where(by_place == F.array_sort(by_place))


def match_catalogue(corpus: Corpus, catalogue: Catalogue, *, ordered: bool = False) -> DataFrame:
    """All embeddings of all structures, in one pass over the sentences."""
    out = _match(corpus, catalogue.structures)
    return fixed_order(out) if ordered else out
