"""File-incremental counting: new files add to staged partial counts, which are additive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def count_new_documents(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Counts the words of Parquet files that appear in a folder of documents, as partial counts per micro-batch.

    The checkpoint is the manifest: a file is taken once. A batch that is repeated after a failure overwrites its own part.
    """
    from ..operators.collocations import uniq_words
    from ..sources.corpus import documents_corpus

    def add(batch: DataFrame, batch_id: int) -> None:
        uniq_words(documents_corpus(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("lemma", "msd", "pos", "text").agg(F.sum("frequency").alias("frequency"))
