"""The corpus pipeline: stages over documents, each calling one operator of lexarbor.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again
before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarbor.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join
from lexarbor.llm.common import staged, table

#: (code points below, least regression value): below it no language fits. A short text has few n-grams to go by, and the
#: distinct n-grams of a very long one outgrow any model, so both reach lower values than texts between (random letters reach 0.2 at most).
LANGUAGE_LIMITS = ((60, 0.08), (300, 0.15), (1_000_000, 0.2), (1 << 62, 0.1))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a language that fits; lang becomes the predicted one."""
    found = language_id.predict(docs, language_id.train(docs), lang_as="__lang", score_as="__score")
    limit = F.coalesce(*(F.when(F.length("text") < chars, least) for chars, least in LANGUAGE_LIMITS))
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= limit))
    return kept.withColumn("lang", F.col("__lang")).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that many documents share; n_chars follows the text. A null text stays null."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows without an id stay."""
    found = ngram_join.jaccard_components(docs)
    first = staged(found.where("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct(), "pipeline-first")
    return docs.join(first.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_bytes, ids_sha256, decoded_sha256): the token ids and the digests of a round trip."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("mix", mix_to_weights),
    ("byte_bpe", encode_tokens),
]
#: Language ID, the similarity groups and the merges can't be said in SQL; tests/llm/test_pipeline.py holds run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
