"""Sinks: the report as separated text, in one file or one folder per structure; the sentence map; corpora as CoNLL-U and TEI."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .corpus import KEY, Corpus


@F.pandas_udf(StringType())
def five_decimals(x: pd.Series) -> pd.Series:
    """Exact decimals of the binary value, ties to even, which the JVM's formatter doesn't give (it rounds ties up)."""
    return x.map(lambda v: "%.5f" % v, na_action="ignore")


def as_text(report: DataFrame, decimal: str = ".") -> list[Column]:
    """Columns as text: blanks for null, five decimals for doubles, exact ties rounded to even. Only this sink uses Python."""
    out = []
    for name, kind in report.dtypes:
        text = F.replace(five_decimals(F.col(name)), F.lit("."), F.lit(decimal)) if kind == "double" else F.col(name).cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return out


def write_report(report: DataFrame, path: str, *, separator: str = "\t", decimal: str = ".", per_structure: bool = False, single_file: bool = True) -> None:
    """Lines without quoting below a header. per_structure writes one file with header for each structure; single_file gathers the report in one file."""
    head = separator.join(report.columns)
    lines = report.select(F.col("Structure_ID").alias("structure"), F.concat_ws(separator, *as_text(report, decimal)).alias("value"))
    if per_structure:
        rows = lines.withColumn("at", F.monotonically_increasing_id() + 1)
        heads = report.select(F.col("Structure_ID").alias("structure")).distinct().select("structure", F.lit(head).alias("value"), F.lit(0).cast("long").alias("at"))
        rows.unionByName(heads).repartition("structure").sortWithinPartitions("structure", "at").drop("at").write.mode("overwrite").partitionBy("structure").text(path)
        return
    first = report.sparkSession.createDataFrame([(head,)], "value string")
    out = first.coalesce(1).unionByName(lines.select("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def write_map(sentence_map: DataFrame, path: str) -> None:
    """Separated text with a header; a map with a column Structure_ID gets a folder for each structure."""
    writer = sentence_map.write.mode("overwrite")
    if "Structure_ID" in sentence_map.columns:
        writer = sentence_map.repartition("Structure_ID").sortWithinPartitions("Structure_ID", "Collocation_id").write.mode("overwrite").partitionBy("Structure_ID")
    writer.csv(path, sep="\t", header=True, quote="")


def _words(corpus: Corpus, said) -> Column:
    """The words of a sentence, each with the link that ends in it, as said(token, link) has it; its links are in the order of its words."""
    return F.transform(F.arrays_zip(F.slice("tokens", F.lit(2), F.size("tokens")).alias("t"), F.col("links").alias("x")), lambda p: said(p["t"], p["x"]))


def write_conllu(corpus: Corpus, path: str) -> None:
    """CoNLL-U files of a corpus in which every word ends one link, the links in the order of the words."""

    def line(t: Column, x: Column) -> Column:
        feats = F.regexp_replace(t["msd"], r"\|?POS=[^|]*$", "")
        tag = (F.lit("_"), F.when(feats == "", "_").otherwise(feats)) if corpus.ud else (t["msd"], F.lit("_"))
        return F.concat_ws("\t", t["tok"], t["form"], t["lemma"], t["pos"], *tag, x["head"], x["label"], F.lit("_"), F.when(t["glue"], "SpaceAfter=No").otherwise("_"))

    text = F.concat_ws("\n", F.concat(F.lit("# sent_id = "), "sentence_id"), _words(corpus, line))
    corpus.sentences.select(text.alias("value")).write.option("lineSep", "\n\n").text(path)


def write_tei(corpus: Corpus, path: str, buckets: int) -> None:
    """Gzipped TEI documents of a UD corpus as for write_conllu, one per bucket of file numbers. A document is written row by row in the order of its sentences, after a sort that spills, so no task holds it."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))
    name = lambda i: F.when(i == 0, F.col("sentence_id")).otherwise(F.concat_ws(".", "sentence_id", i))

    def word(t: Column, x: Column) -> Column:
        feats = F.regexp_replace(t["msd"], r"\|?POS=[^|]*$", "")
        tag = F.concat_ws("|", F.concat(F.lit("UPosTag="), t["pos"]), F.nullif(feats, F.lit("")))
        return F.concat(F.lit('<w xml:id="'), name(t["tok"]), F.lit('" lemma="'), safe(t["lemma"]), F.lit('" msd="'), safe(tag), F.when(t["glue"], F.lit('" join="right">')).otherwise('">'), safe(t["form"]), F.lit("</w>"))

    link = lambda t, x: F.concat(F.lit('<link ana="ud-syn:'), x["label"], F.lit('" target="#'), name(x["head"]), F.lit(" #"), name(x["dep"]), F.lit('"/>'))
    sentence = F.concat(F.lit('<s xml:id="'), F.col("sentence_id"), F.lit('">'), F.array_join(_words(corpus, word), ""), F.lit("<linkGrp>"), F.array_join(_words(corpus, link), ""), F.lit("</linkGrp></s>"))
    bucket = lambda c: c.cast("long").alias("bucket")
    rows = corpus.sentences.select(bucket(F.xxhash64("file_ix") % buckets), F.lit(1).alias("part"), *KEY, sentence.alias("value"))
    head, foot = F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>'), F.lit("</p></body></text></TEI>")
    for part, text in ((0, head), (2, foot)):  # the remainder has the sign of the hash
        ends = corpus.sentences.sparkSession.range(1 - buckets, buckets, 1, 1)
        rows = rows.unionByName(ends.select(bucket(F.col("id")), F.lit(part).alias("part"), *(F.lit(0).alias(k) for k in KEY), text.alias("value")))
    sorted_rows = rows.repartition(2 * buckets - 1, "bucket").sortWithinPartitions("bucket", "part", *KEY)
    sorted_rows.select("bucket", "value").write.partitionBy("bucket").option("maxRecordsPerFile", 0).option("compression", "gzip").text(path)
