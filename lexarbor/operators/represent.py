"""Representative forms of collocation components.

All work is on long rows (collocation_id, cid, rep, found, w), one per matched word; the catalogue's few renditions are a
broadcast table, as a catalogue is a bounded plan object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.structures import Catalogue
from ..sources.lexicon import find_forms, find_lemma_tags
from .wordfeats import common_features, common_tag, features_of

SPEC = "structure_id string, cid string, rep int, kind string, lexis string, need map<string,string>, agreement array<string>, head string, lower boolean"
BY = ("collocation_id", "cid", "rep")
#: The rank of a head's last candidate, which has only what all its words have in common.
LAST = 1 << 30


def specs(spark, catalogue: Catalogue) -> DataFrame:
    rows = []
    for s in catalogue.structures:
        for c in s.components:
            for i, r in enumerate(c.representations):
                rows.append((s.id, c.cid, i, r.kind, r.lexis, dict(r.msd), list(r.agreement), r.head, r.lowercase))
                if r.kind == "agreement":
                    heads = [h for h in s.components if h.cid == r.head]
                    if not heads or len(heads[0].representations) != 1:
                        raise NotImplementedError(f"structure {s.id}: component {c.cid} agrees with {r.head}, which needs exactly one representation")
    return spark.createDataFrame(rows, SPEC)


def long_rows(matches: DataFrame) -> DataFrame:
    return matches.select("collocation_id", "structure_id", "found", F.explode("words").alias("cid", "w"))


def most_frequent_forms(words: DataFrame) -> DataFrame:
    """(lemma, msd, text): the most frequent form of each; of equally frequent ones the first by code point."""
    return words.groupBy("lemma", "msd").agg(F.min_by("text", F.struct(-F.col("frequency"), "text")).alias("text"))


def meets(feats: Column, need: Column, ud: bool) -> Column:
    """Whether a word has the features that a rendition needs; the positional system passes words that lack one."""
    def one(k: Column, v: Column) -> Column:
        got = F.try_element_at(feats, k if ud else F.lower(k))
        return F.coalesce(got == v, F.lit(not ud))
    return F.forall(F.map_entries(F.coalesce(need, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: one(e["key"], e["value"]))


def lemmas(rows: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """The lemma and tag of the first word; with a lexicon its tag of the lemma, where it has one."""
    found = first_lemmas(rows)
    if lexicon is None:
        return found
    return find_lemma_tags(found.withColumnRenamed("text", "lemma"), lexicon).select(*BY, F.col("lemma").alias("text"), F.coalesce("lemma_msd", "msd").alias("msd"))


def first_lemmas(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BY).agg(F.min_by(F.struct("w.lemma", "w.msd"), "found").alias("x")).select(*BY, F.col("x.lemma").alias("text"), F.col("x.msd").alias("msd"))


def lexemes(rows: DataFrame, ud: bool) -> DataFrame:
    return rows.groupBy(*BY).agg(F.first("lexis").alias("text")).withColumn("msd", F.lit("POS=PART" if ud else "Q"))


def all_forms(rows: DataFrame) -> DataFrame:
    """Distinct forms in lower case, in order, joined by /, with the tag of the first word of each."""
    forms = rows.groupBy(*BY, F.lower("w.form").alias("form")).agg(F.min_by("w.msd", "found").alias("msd"))
    listed = forms.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("form", "msd"))).alias("x"))
    return listed.select(*BY, F.array_join("x.form", "/").alias("text"), F.array_join("x.msd", "/").alias("msd"))


def candidates(rows: DataFrame, ud: bool) -> DataFrame:
    """(collocation_id, cid, rep, msd, lemma, feats, rank) of the words that a rendition may show, most frequent tag first.

    Of equally frequent ones the lower sum of the lemma's code points over 100,000 goes first, then tag and lemma.
    """
    counted = rows.where((F.col("kind") == "any") | meets(features_of(F.col("w.msd"), ud), F.col("need"), ud)).groupBy(*BY, "w.msd", "w.lemma").agg(F.count("*").alias("n"))
    counted = counted.withColumn("feats", features_of(F.col("msd"), ud))
    points = F.aggregate(F.transform(F.filter(F.split("lemma", ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, x: a + x)
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*BY).orderBy(-F.col("n") + points / 1e5, "msd", "lemma")))


def common_candidates(rows: DataFrame, ud: bool) -> DataFrame:
    """candidates() of what all words of a head have in common, without tag and lemma. A component has few distinct tags."""
    tags = rows.groupBy(*BY).agg(F.collect_set("w.msd").alias("tags"))
    shared = common_features(F.transform("tags", lambda t: features_of(t, True))) if ud else features_of(common_tag(F.col("tags")), False)
    return tags.select(*BY, F.lit(None).cast("string").alias("msd"), F.lit(None).cast("string").alias("lemma"), F.lit(0).cast("long").alias("n"), shared.alias("feats"), F.lit(LAST).alias("rank"))


def lexicon_forms(rows: DataFrame, found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(BY, text, msd) of components none of whose words has the features that their rendition needs, by their first lemma."""
    own = rows.groupBy(*BY).agg(F.min_by("w.lemma", "found").alias("lemma"), F.first("need").alias("need")).join(found.select(*BY), list(BY), "left_anti")
    asked = own.select(*BY, "lemma", F.transform_values(F.transform_keys("need", lambda k, _: F.lower(k)), lambda _, v: F.lower(v)).alias("need"))
    return find_forms(asked, lexicon, last_resort=True).where("form IS NOT NULL").select(*BY, F.col("form").alias("text"), F.col("form_msd").alias("msd"))


def agreeing(found: DataFrame, rows: DataFrame, agrees: DataFrame, words: DataFrame, ud: bool, lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the winning candidate of each head, the forms of the components that agree with it).

    Heads try their candidates by rank; the first for which every agreeing component has a form wins. A form has the
    component's lemma and word class, equal agreement features, and the features that its rendition needs; the most
    frequent goes first, forms of the lexicon after those of the corpus. Where no candidate wins, the components that
    fit the last one (common_candidates) still show their forms, and the head shows none.
    """
    own = agrees.groupBy(*BY).agg(F.min_by(F.struct("w.lemma", "w.pos"), "found").alias("x"), F.first("head").alias("head"), F.first("agreement").alias("agreement"), F.first("need").alias("need"))
    own = own.select("collocation_id", F.col("cid").alias("a_cid"), F.col("rep").alias("a_rep"), F.col("x.lemma").alias("a_lemma"), F.col("x.pos").alias("a_pos"), "head", "agreement", "need")
    wanted = own.groupBy("collocation_id", "head").agg(F.count("*").alias("wanted"))
    forms = words.select(F.col("lemma").alias("a_lemma"), F.col("pos").alias("a_pos"), F.col("msd").alias("a_msd"), F.col("text").alias("a_text"), "frequency")
    if lexicon is not None:
        forms = forms.unionByName(lexicon.select(F.col("lemma").alias("a_lemma"), F.substring("msd", 1, 1).alias("a_pos"), F.col("msd").alias("a_msd"), F.col("form").alias("a_text"), (-F.col("rank")).cast("long").alias("frequency")))
    pairs = found.alias("f").join(own.alias("o"), (F.col("f.collocation_id") == F.col("o.collocation_id")) & (F.col("f.cid") == F.col("o.head"))).select("f.*", "o.a_cid", "o.a_rep", "o.a_lemma", "o.a_pos", "o.head", "o.agreement", "o.need")
    offered = pairs.join(forms, ["a_lemma", "a_pos"]).withColumn("a_feats", features_of(F.col("a_msd"), ud))
    name = (lambda k: F.initcap(k)) if ud else (lambda k: k)
    same = F.forall("agreement", lambda k: F.coalesce(F.try_element_at("feats", name(k)) == F.try_element_at("a_feats", name(k)), F.lit(False)))
    fitting = offered.where(same & meets(F.col("a_feats"), F.col("need"), ud))
    best = fitting.groupBy("collocation_id", "head", "rank", "a_cid", "a_rep").agg(F.min_by(F.struct("a_text", "a_msd"), F.struct(-F.col("frequency"), "a_text")).alias("a"))
    full = best.groupBy("collocation_id", "head", "rank").agg(F.count("*").alias("got")).join(wanted, ["collocation_id", "head"]).where((F.col("got") == F.col("wanted")) & (F.col("rank") < LAST))
    winner = full.groupBy("collocation_id", "head").agg(F.min("rank").alias("rank"))
    chosen = best.join(winner, ["collocation_id", "head", "rank"])
    left = best.where(F.col("rank") == LAST).join(winner, ["collocation_id", "head"], "left_anti")
    shown = chosen.unionByName(left).select("collocation_id", F.col("a_cid").alias("cid"), F.col("a_rep").alias("rep"), F.col("a.a_text").alias("text"), F.col("a.a_msd").alias("msd"))
    free = found.join(wanted.select("collocation_id", F.col("head").alias("cid")), ["collocation_id", "cid"], "left_anti").where("rank = 1")
    bound = found.join(winner.withColumnRenamed("head", "cid"), ["collocation_id", "cid", "rank"])
    return free.unionByName(bound.select(*free.columns)), shown


def representations(matches: DataFrame, catalogue: Catalogue, words: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(collocation_id, cid, text, msd): text and msd are null where no word can be shown.

    A lexicon (lemma, msd, form, rank) of the positional system gives the tags of lemmas, forms that the corpus lacks,
    and forms for agreement; the UD system reads none.

    Several renditions of a component are joined by a space, those without a form as empty texts.
    """
    table = specs(matches.sparkSession, catalogue)
    lexicon = None if catalogue.ud else lexicon
    rows = long_rows(matches).join(F.broadcast(table), ["structure_id", "cid"])
    kinds = {r.kind for s in catalogue.structures for c in s.components for r in c.representations}
    parts = []
    if "lemma" in kinds:
        parts.append(lemmas(rows.where("kind = 'lemma'"), lexicon))
    if "lexis" in kinds:
        parts.append(lexemes(rows.where("kind = 'lexis'"), catalogue.ud))
    if "all" in kinds:
        parts.append(all_forms(rows.where("kind = 'all'")))
    if kinds & {"any", "msd", "agreement"}:
        found = candidates(rows.where("kind IN ('any', 'msd')"), catalogue.ud)
        shown = None
        if "agreement" in kinds:
            last = common_candidates(rows.where("kind = 'msd'"), catalogue.ud)
            best, shown = agreeing(found.unionByName(last), rows, rows.where("kind = 'agreement'"), words, catalogue.ud, lexicon)
        else:
            best = found.where("rank = 1")
        forms = most_frequent_forms(words)
        parts.append(best.select(*BY, "lemma", "msd").join(forms, ["lemma", "msd"], "left").select(*BY, "text", "msd"))
        if lexicon is not None and "msd" in kinds:
            parts.append(lexicon_forms(rows.where("kind = 'msd'"), found, lexicon))
        if shown is not None:
            parts.append(shown)
    asked = rows.groupBy(*BY).agg(F.first("lower").alias("lower"))
    made = None
    for p in parts:
        made = p if made is None else made.unionByName(p)
    if made is None:
        return asked.select("collocation_id", "cid", F.lit("").alias("text"), F.lit("").alias("msd")).limit(0)
    joined = asked.join(made, list(BY), "left").withColumn("text", F.when(F.col("lower"), F.lower("text")).otherwise(F.col("text")))
    lists = joined.groupBy("collocation_id", "cid").agg(F.sort_array(F.collect_list(F.struct("rep", "text", "msd"))).alias("x"), F.max(F.col("text").isNotNull()).alias("any"))
    spell = lambda f: F.when(F.col("any"), F.array_join(F.transform("x", lambda r: F.coalesce(r[f], F.lit(""))), " "))
    return lists.select("collocation_id", "cid", spell("text").alias("text"), spell("msd").alias("msd"))
