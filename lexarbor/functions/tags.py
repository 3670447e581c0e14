"""Positional morphosyntactic tags and relation labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The positional tag set. Per category its name, then per position the feature and the value of each character.
_GENDER, _NUMBER = {"m": "masculine", "f": "feminine", "n": "neuter"}, {"s": "singular", "p": "plural", "d": "dual"}
_CASE = {"n": "nominative", "g": "genitive", "d": "dative", "a": "accusative", "l": "locative", "i": "instrumental"}
_DEGREE, _PERSON, _YES = {"p": "positive", "c": "comparative", "s": "superlative"}, {"1": "first", "2": "second", "3": "third"}, {"n": "no", "y": "yes"}
TAGS = {
    "N": ("noun", (("type", {"c": "common", "p": "proper"}), ("gender", _GENDER), ("number", _NUMBER), ("case", _CASE), ("animate", _YES))),
    "V": ("verb", (("type", {"m": "main", "a": "auxiliary"}), ("aspect", {"e": "perfective", "p": "progressive", "b": "biaspectual"}), ("vform", {"n": "infinitive", "u": "supine", "p": "participle", "r": "present", "f": "future", "c": "conditional", "m": "imperative"}), ("person", _PERSON), ("number", _NUMBER), ("gender", _GENDER), ("negative", _YES))),
    "A": ("adjective", (("type", {"g": "general", "s": "possessive", "p": "participle"}), ("degree", _DEGREE), ("gender", _GENDER), ("number", _NUMBER), ("case", _CASE), ("definiteness", _YES))),
    "R": ("adverb", (("type", {"g": "general", "r": "participle"}), ("degree", _DEGREE))),
    "P": ("pronoun", (("type", {"p": "personal", "s": "possessive", "d": "demonstrative", "r": "relative", "x": "reflexive", "g": "general", "q": "interrogative", "i": "indefinite", "z": "negative"}), ("person", _PERSON), ("gender", _GENDER), ("number", _NUMBER), ("case", _CASE), ("owner_number", _NUMBER), ("owned_gender", _GENDER), ("clitic", {"y": "yes", "b": "bound"}))),
    "M": ("numeral", (("form", {"d": "digit", "r": "roman", "l": "letter"}), ("type", {"c": "cardinal", "o": "ordinal", "p": "pronominal", "s": "special"}), ("gender", _GENDER), ("number", _NUMBER), ("case", _CASE), ("definiteness", _YES))),
    "S": ("preposition", (("case", _CASE),)),
    "C": ("conjunction", (("type", {"c": "coordinating", "s": "subordinating"}),)),
    "Q": ("particle", ()),
    "I": ("interjection", ()),
    "Y": ("abbreviation", ()),
    "X": ("residual", (("type", {"f": "foreign", "t": "typo", "p": "program", "w": "web", "e": "emo", "h": "hashtag", "a": "at"}),)),
    "Z": ("punctuation", ()),
}
# The native spelling of the tag set. Per native category its English letter, then per position the native characters and the English ones.
_OF_GENDER, _OF_NUMBER, _OF_CASE = ("mzs", "mfn"), ("edm", "sdp"), ("irdtmo", "ngdali")
_OF_DEGREE, _OF_PERSON, _OF_YES = ("nps", "pcs"), ("pdt", "123"), ("nd", "ny")
NATIVE = {
    "S": ("N", (("ol", "cp"), _OF_GENDER, _OF_NUMBER, _OF_CASE, _OF_YES)),
    "G": ("V", (("gp", "ma"), ("dnv", "epb"), ("nmdspgv", "nuprfcm"), _OF_PERSON, _OF_NUMBER, _OF_GENDER, _OF_YES)),
    "P": ("A", (("psd", "gsp"), _OF_DEGREE, _OF_GENDER, _OF_NUMBER, _OF_CASE, _OF_YES)),
    "R": ("R", (("sd", "gr"), ("nrs", "pcs"))),
    "Z": ("P", (("oskzpcvnl", "psdrxgqiz"), _OF_PERSON, _OF_GENDER, _OF_NUMBER, _OF_CASE, _OF_NUMBER, _OF_GENDER, ("kz", "yb"))),
    "K": ("M", (("abr", "dlr"), ("gvzd", "cops"), _OF_GENDER, _OF_NUMBER, _OF_CASE, _OF_YES)),
    "D": ("S", (_OF_CASE,)),
    "V": ("C", (("pd", "cs"),)),
    "L": ("Q", ()),
    "M": ("I", ()),
    "O": ("Y", ()),
    "N": ("X", (("j", "f"),)),
    "U": ("Z", ()),
}
# Per category the features that all forms of a lexeme share; the others are those of a form.
LEXEME = {"N": ("type", "gender"), "V": ("type", "aspect"), "A": ("type",), "R": ("type",), "P": ("type",), "M": ("form", "type"), "S": ("case",), "C": ("type",), "X": ("type",)}
# Dependency labels of the positional system, in English and as stored.
LABELS = {"Root": "modra", "Atr": "dol", "PPart": "del", "Coord": "prir", "Conj": "vez", "MWU": "skup", "Sb": "ena", "Obj": "dve", "AdvM": "tri", "AdvO": "štiri"}


def decode_msd(msd: Column) -> Column:
    """map<string,string> of a positional tag: pos and the named features; `-` and unknown characters are left out, an unknown category gives an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = empty
    for letter, (name, positions) in TAGS.items():
        pairs = [F.struct(F.lit("pos").alias("key"), F.lit(name).alias("value"))]
        for i, (feature, values) in enumerate(positions, 2):
            at, value = F.substring(msd, i, 1), F.lit(None).cast("string")
            for char, meaning in values.items():
                value = F.when(at == char, meaning).otherwise(value)
            pairs.append(F.struct(F.lit(feature).alias("key"), value.alias("value")))
        entries = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
        out = F.when(F.substring(msd, 1, 1) == letter, F.map_from_entries(entries)).otherwise(out)
    return out


def split_msd(msd: Column) -> Column:
    """struct<lexeme,form> of decode_msd()'s map: pos and the features of LEXEME, and the others. Both are empty for an unknown category."""
    own = F.array(F.lit("pos"))
    for letter, names in LEXEME.items():
        own = F.when(F.substring(msd, 1, 1) == letter, F.array(*map(F.lit, ("pos", *names)))).otherwise(own)
    feats = decode_msd(msd)
    return F.struct(F.map_filter(feats, lambda k, _: F.array_contains(own, k)).alias("lexeme"), F.map_filter(feats, lambda k, _: ~F.array_contains(own, k)).alias("form"))


def translate_msd(msd: Column) -> Column:
    """A tag in native spelling as it is stored, position by position; what NATIVE doesn't know stays as it is."""
    out = msd
    for native, (letter, positions) in NATIVE.items():
        said = [F.translate(F.substring(msd, i, 1), own, english) for i, (own, english) in enumerate(positions, 2)]
        rest = F.substr(msd, F.lit(len(positions) + 2))
        out = F.when(F.substring(msd, 1, 1) == native, F.concat(F.lit(letter), *said, rest)).otherwise(out)
    return out


def named_feature(msd: Column, key: str, values) -> Column:
    """Whether a tag of named features (k=v|k=v) has the feature with one of the values."""
    held = F.concat(F.lit("|"), msd, F.lit("|"))
    return reduce(or_, (held.contains(f"|{key}={v}|") for v in values))


def tag_feature(msd: Column, key: str, values) -> Column:
    """Whether a positional tag has the feature (pos: its category) with one of the values."""
    tests = [F.lit(False)]
    for letter, (name, positions) in TAGS.items():
        of = F.substring(msd, 1, 1) == letter
        if key == "pos" and name in values:
            tests.append(of)
        for i, (feature, chars) in enumerate(positions, 2):
            if feature == key and (good := [c for c, v in chars.items() if v in values]):
                tests.append(of & F.substring(msd, i, 1).isin(*good))
    return reduce(or_, tests)


def translate_label(label: Column) -> Column:
    """An English label as it is stored; a label that is none of them raises an error."""
    out = F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string")
    for en, stored in LABELS.items():
        out = F.when(label == en, stored).otherwise(out)
    return out
