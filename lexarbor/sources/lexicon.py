"""The form lexicon: build from a list, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import decode_msd


def read_form_list(spark: SparkSession, path: str) -> DataFrame:
    """lemma|msd|form|frequency with a header line; an empty frequency is 0."""
    rows = spark.read.csv(path, sep="|", header=True, schema="lemma string, msd string, form string, frequency string", quote="")
    return rows.withColumn("frequency", F.coalesce(F.col("frequency").try_cast("long"), F.lit(0)))


# Broken tags of form lists, in the native spelling of the positional system, and what they stand for.
REPAIRS = {
    "Rdn": "Rd", "Gp-spdzd": "Gp-spdzn", "Gp-spmzn": "Gp-spm-n", "Gp-spmzd": "Gp-spm-d", "Gp-ppdzn": "Gp-ppd-n", "Gp-ppdzd": "Gp-ppd-d", "Gp-ppmzn": "Gp-ppm-n",
    "Gp-ppmzd": "Gp-ppm-d", "Gp-pdd-d": "Gp-pdd-n", "Gp-pdm-d": "Gp-pdm-n", "Gp-ptd-d": "Gp-ptd-n", "Kagmei": "Kag", "Kbgmei": "Kbgmdi",
}


def repaired(msd: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in REPAIRS.items() for x in pair)), msd), msd)


def build_lexicon(forms: DataFrame) -> DataFrame:
    """(lemma, msd, form, frequency, rank): per lemma and tag the commonest form, and per lemma the commonest row whose form is the lemma.

    Of equal frequencies the lesser form, then tag, goes first. rank counts a lemma's rows from its most frequent.
    """
    forms = forms.withColumn("msd", repaired(F.col("msd")))
    best = F.row_number().over(Window.partitionBy("lemma", "msd").orderBy(F.desc("frequency"), "form"))
    per_tag = forms.withColumn("n", best).where("n = 1").drop("n")
    own = F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("frequency"), "msd"))
    per_lemma = forms.where("form = lemma").withColumn("n", own).where("n = 1").drop("n")
    rows = per_tag.unionByName(per_lemma).dropDuplicates(["lemma", "msd", "form"])
    rank = F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("frequency"), "msd", "form"))
    return rows.withColumn("rank", rank)


def find_forms(asked: DataFrame, lexicon: DataFrame, last_resort: bool = False) -> DataFrame:
    """asked (lemma, need map<string,string>, ...) with the commonest form that has all needed features: form and form_msd, null if none.

    With last_resort a known lemma without a fitting form gets its last one.
    """
    known = lexicon.select("lemma", F.col("form").alias("x_form"), F.col("msd").alias("x_msd"), "rank", decode_msd(F.col("msd")).alias("x_feats"))
    rows = asked.withColumn("__row", F.monotonically_increasing_id())
    fits = F.forall(F.map_entries("need"), lambda e: F.coalesce(F.try_element_at("x_feats", e["key"]) == e["value"], F.lit(False)))
    met = rows.join(known, "lemma").withColumn("fits", fits)
    met = met if last_resort else met.where("fits")
    order = F.when(F.col("fits"), F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), (-F.col("rank")).alias("b")))
    hits = met.groupBy("__row").agg(F.min_by(F.struct("x_form", "x_msd"), order).alias("x"))
    return rows.join(hits, "__row", "left").select(*asked.columns, F.col("x.x_form").alias("form"), F.col("x.x_msd").alias("form_msd"))


def find_lemma_tags(asked: DataFrame, lexicon: DataFrame) -> DataFrame:
    """asked (lemma, ...) with the tag of the first entry whose form is the lemma, else of the lemma's first entry; null for an unknown lemma."""
    own = lexicon.groupBy("lemma").agg(F.min_by("msd", F.struct((F.col("form") != F.col("lemma")).alias("other"), "rank")).alias("lemma_msd"))
    return asked.join(own, "lemma", "left")
