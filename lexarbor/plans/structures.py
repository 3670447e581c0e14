"""The pattern catalogue: XML to frozen plan objects, compiled on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace
from xml.etree import ElementTree

# Relations whose dependent carries meaning of its own.
CONTENT_RELATIONS = frozenset("advmod amod compound conj fixed flat iobj nmod nsubj nummod obj obl".split())
SPACES = frozenset(("both", "right", "left", "neither"))


@dataclass(frozen=True)
class Restriction:
    """kind: morphology, lexis or space. features: (key, allowed values, negated)."""

    kind: str
    features: tuple[tuple[str, tuple[str, ...], bool], ...]


@dataclass(frozen=True)
class Representation:
    """kind: lemma, lexis, all, any, msd or agreement."""

    kind: str
    lexis: str | None = None
    msd: tuple[tuple[str, str], ...] = ()
    agreement: tuple[str, ...] = ()
    head: str | None = None
    lowercase: bool = False


@dataclass(frozen=True)
class Component:
    cid: str
    core: bool
    status: str = "required"
    restrictions: tuple[Restriction, ...] = ()
    any_of: bool = False
    representations: tuple[Representation, ...] = ()
    labels: tuple[str, ...] = ()
    order: str = "any"
    children: tuple[Component, ...] = ()
    pair: bool = False

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


@dataclass(frozen=True)
class Structure:
    """root is what is matched at every word; components are in depth-first order, the artificial root left out."""

    id: str
    ix: int
    root: Component
    components: tuple[Component, ...]


@dataclass(frozen=True)
class Catalogue:
    structures: tuple[Structure, ...]
    width: int
    ud: bool


def _restriction(tag) -> Restriction:
    kind = tag.get("type")
    if kind not in ("morphology", "lexis", "space"):
        raise NotImplementedError(f"restriction of type {kind}")
    found: dict[str, tuple[tuple[str, ...], bool]] = {}
    for feature in tag:
        given = dict(feature.items())
        negated = given.pop("filter", None) is not None
        if kind == "morphology" and len(given) != 1:
            raise ValueError("a morphology feature has one key")
        for key, value in given.items():
            found[key] = (tuple(value.split("|")), negated)
    needed = {"morphology": "POS", "lexis": "lemma", "space": "contact"}[kind]
    if needed not in found:
        raise ValueError(f"a {kind} restriction needs {needed}")
    if kind == "space" and not SPACES.issuperset(found["contact"][0]):
        raise ValueError("contact is both, left, right or neither")
    return Restriction(kind, tuple((k, v, n) for k, (v, n) in found.items()))


def _representation(tag) -> Representation:
    out = Representation("lemma")
    for feature in tag:
        given = dict(feature.items())
        if "rendition" in given:
            kinds = {"lemma": "lemma", "word_form": "any", "lexis": "lexis"}
            if given["rendition"] not in kinds:
                raise NotImplementedError(f"rendition {given['rendition']}")
            out = replace(out, kind=kinds[given["rendition"]], lexis=given.get("string"))
        elif "selection" in given:
            chosen = given.pop("selection")
            if chosen == "msd":
                out = replace(out, kind="agreement" if out.kind == "agreement" else "msd", msd=tuple(given.items()))
            elif chosen == "all":
                out = replace(out, kind="all")
            elif chosen == "agreement":
                out = replace(out, kind="agreement", agreement=tuple(given["msd"].split("+")), head=given["head_cid"])
            else:
                raise NotImplementedError(f"selection {chosen}")
        elif "format" in given:
            out = replace(out, lowercase=given["format"] == "lowercase")
    return out


def _priority(component: Component) -> int:
    """How little of its own meaning a word class has, 0 to 4, by the morphology restrictions of the positional tag set."""
    best = 4
    for r in component.restrictions:
        if r.kind != "morphology":
            continue
        features = {k: v for k, v, _ in r.features}
        if len(features["POS"]) != 1 or features["POS"][0] in ("adjective", "noun", "adverb"):
            got = 0
        elif features["POS"][0] == "verb":
            got = {"auxiliary": 3, "main": 1}.get(features.get("type", ("",))[0], 2) if len(features) > 1 else 2
        else:
            got = 4
        best = min(best, got)
    return best


def _core_pair(components: list[Component], ud: bool, sid: str) -> set[str]:
    core = [c for c in components if c.core]
    if ud:
        pair = [c.cid for c in core if c.labels == ("#",) or "|".join(c.labels) in CONTENT_RELATIONS or not c.labels]
        if len(pair) != 2:
            raise ValueError(f"structure {sid} has {len(pair)} core words of full meaning, not 2")
        return set(pair)
    ranked = sorted(core, key=_priority)
    if len(ranked) > 2 and _priority(ranked[1]) == _priority(ranked[2]):
        raise ValueError(f"structure {sid}: its two core words can't be told")
    return {c.cid for c in ranked[:2]}


def parse_structure(tag, ix: int, ud: bool, statistics: bool = True) -> Structure:
    sid = tag.get("id") or tag.get("tempId")
    components, dependencies, definition = list(tag)
    given = {c.get("cid"): c for c in components}
    restrictions: dict[str, tuple[tuple[Restriction, ...], bool]] = {}
    renditions: dict[str, tuple[Representation, ...]] = {}
    for entry in definition:
        own, any_of = [], False
        groups = [e for e in entry if e.tag.startswith("restriction")]
        if groups and groups[0].tag == "restriction_or":
            own, any_of = [_restriction(r) for r in groups[0]], True
        else:
            own = [_restriction(r) for r in groups]
        for e in entry:
            if not e.tag.startswith(("restriction", "representation")):
                raise NotImplementedError(f"unknown definition {e.tag} in structure {sid}")
        restrictions[entry.get("cid")] = (tuple(own), any_of)
        renditions[entry.get("cid")] = tuple(_representation(e) for e in entry if e.tag.startswith("representation"))
    statuses = {None: "required", "obligatory": "required", "optional": "optional", "forbidden": "forbidden"}
    ways = {None: "any", "from-to": "from-to", "to-from": "to-from"}
    seen: set[str] = set()

    def grow(cid: str) -> tuple[Component, ...]:
        out = []
        for dep in dependencies:
            if dep.get("from") != cid:
                continue
            to = dep.get("to")
            if to in seen:
                raise ValueError(f"structure {sid}: component {to} has two heads")
            seen.add(to)
            own, any_of = restrictions.get(to, ((), False))
            out.append(Component(to, given[to].get("type") == "core", statuses[given[to].get("status")], own, any_of, renditions.get(to, ()), tuple(dep.get("label").split("|")), ways[dep.get("order")], grow(to)))
        return tuple(out)

    tops = grow("#")
    rooted = any(d.get("label") == "modra" for d in dependencies)
    every = [c for top in tops for c in top.walk()]
    pair = _core_pair(every, ud, sid) if statistics else set()

    def mark(c: Component) -> Component:
        return replace(c, pair=c.cid in pair, children=tuple(map(mark, c.children)))

    tops = tuple(map(mark, tops))
    root = Component("#", False, children=tops) if rooted else tops[0]
    return Structure(sid, ix, root, tuple(c for top in tops for c in top.walk()))


def parse_catalogue(xml: str, statistics: bool = True) -> Catalogue:
    """The structures that a corpus is searched for: collocations without formal descendants, and formal ones."""
    tree = ElementTree.XML(xml)
    if "system_type" not in tree.attrib:
        raise ValueError("the catalogue has no system_type")
    ud = tree.attrib["system_type"] == "UD"
    wanted = [s for s in tree.iter("syntactic_structure") if s.get("type") == "formal" or (s.get("type") == "collocation" and "formal_descendants" not in s.attrib)]
    structures = tuple(parse_structure(s, i, ud, statistics) for i, s in enumerate(wanted))
    return Catalogue(structures, max((len(s.components) for s in structures), default=0), ud)
