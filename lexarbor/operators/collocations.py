"""Collocations, corpus counts and dispersions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from .prefix import sums_before

# Before these letters the preposition is s, and before those h.
S_BEFORE, H_BEFORE = tuple("cčfhkpsšt"), ("g", "k")


def collocation_key(words: Column, lang: str = "sl") -> Column:
    """array<struct<cid,lemma>> by cid as text; in Slovenian s/z and k/h follow the next lemma, except at either end of the structure's key."""
    plain = F.array_sort(F.transform(F.map_entries(words), lambda e: F.struct(e["key"].alias("cid"), e["value"]["lemma"].alias("lemma"))))
    if lang != "sl":
        return plain

    def settle(x: Column, i: Column) -> Column:
        after = F.substring(F.get(plain, i + 1)["lemma"], 1, 1)
        lemma = F.when(x["lemma"].isin("s", "z"), F.when(after.isin(*S_BEFORE), "s").otherwise("z")).when(x["lemma"].isin("k", "h"), F.when(after.isin(*H_BEFORE), "h").otherwise("k"))
        return F.struct(x["cid"].alias("cid"), F.when(i < F.size(plain) - 1, F.coalesce(lemma, x["lemma"])).otherwise(x["lemma"]).alias("lemma"))

    return F.transform(plain, settle)


def with_keys(matches: DataFrame, lang: str = "sl") -> DataFrame:
    """Matches with their key, and with the text of words whose preposition was settled."""
    keyed = matches.withColumn("key", collocation_key(F.col("words"), lang))
    if lang != "sl":
        return keyed
    settled = F.map_from_entries(F.transform("key", lambda x: F.struct(x["cid"], x["lemma"])))
    words = F.transform_values("words", lambda c, w: F.when(w["lemma"].isin("s", "z", "k", "h") & (F.size("key") > 1) & (c != F.element_at("key", -1)["cid"]), w.withField("form", F.element_at(settled, c))).otherwise(w))
    return keyed.withColumn("words", words)


def collocations(matches: DataFrame) -> DataFrame:
    """(structure_id, structure_ix, key, collocation_id, frequency, first): ids are dense from 1, in the order of first embeddings by file, structure and place.

    An id is the number of collocations before it, by prefix sums over ranges, so no task sees all collocations.
    """
    grouped = matches.groupBy("structure_id", "structure_ix", "key").agg(F.count("*").alias("frequency"), F.min_by(F.struct("words", "found", "file_ix", "sent_ix"), "found").alias("first"))
    out = sums_before(grouped, [F.col("first.file_ix"), F.col("structure_ix"), F.col("first.found")], {"before": F.lit(1)})
    return out.select("structure_id", "structure_ix", "key", (F.col("before") + 1).alias("collocation_id"), "frequency", "first")


def uniq_words(corpus: Corpus) -> DataFrame:
    return corpus.tokens.where("NOT is_root").groupBy("lemma", "msd", "pos", F.col("form").alias("text")).agg(F.count("*").alias("frequency"))


def lowercase_forms(words: DataFrame, share: float = 0.1) -> DataFrame:
    """A capitalised form takes its lower case where that occurs at least `share` as often, and no oftener. Rows stay apart."""
    first = F.substring("text", 1, 1)
    low = words.select(F.col("lemma").alias("l"), F.col("msd").alias("m"), F.col("text").alias("t"), F.col("frequency").alias("f"))
    upper = (first == F.upper(first)) & (first != F.lower(first))
    on = (F.col("lemma") == F.col("l")) & (F.col("msd") == F.col("m")) & (F.lower("text") == F.col("t")) & upper
    both = words.join(low, on, "left")
    return both.withColumn("text", F.when((F.col("f") <= F.col("frequency")) & (F.col("f") >= F.col("frequency") * share), F.lower("text")).otherwise(F.col("text"))).drop("l", "m", "t", "f")


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("lemma", "pos").agg(F.sum("frequency").alias("frequency"))


def corpus_size(corpus: Corpus) -> DataFrame:
    """One row: n, the number of tokens, artificial roots among them."""
    return corpus.sentences.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n"))


def dispersions(found: DataFrame, min_freq: int = 0) -> DataFrame:
    """(structure_id, cid, lemma, dispersion): in how many frequent enough collocations a component has a lemma."""
    parts = found.where(F.col("frequency") >= min_freq).select("structure_id", F.explode("key").alias("k"))
    return parts.groupBy("structure_id", "k.cid", "k.lemma").agg(F.count("*").alias("dispersion"))
