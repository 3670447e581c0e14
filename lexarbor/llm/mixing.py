"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key; a source's documents are taken in key order up to the source's budget, whole
epochs first. The cut is found by distributed prefix sums over key ranges: sums of 1,024 ranges per source, then of the
1,024 ranges inside the range that holds the cut, then the sorted rows of that last range. No row is moved for it but
those of the last range (one 2**20th of a source), so a source with a third of all rows costs what its rows cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import sums_before
from .common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS, RANGE_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns as text, nulls as empty texts."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target) of slim rows (source, size): a row per source.

    Sources by code point, null last, weigh as in weights, repeating. Water-filling: with sources sorted by cap/weight,
    level_i = (all - caps before i) / (weights from i on) rises up to the first source below its cap and falls after it,
    so the largest level is the one at which everything is handed out. Ranks and sums are prefix sums over ranges of
    sources, so no task sees them all; the driver gets two totals and the level.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums_before(per_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    placed = sums_before(capped, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")})
    size, weighs = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size) - F.col("caps")).cast("double") / (F.lit(weighs) - F.col("weights"))
    highest = F.lit(placed.agg(F.max(level)).first()[0]).cast("double")
    return placed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * highest).alias("target"))


def _crossing(rows: DataFrame, cuts: DataFrame, shift: int) -> DataFrame:
    """cuts narrowed to the key range of 2**shift keys in which each source's running sum crosses what is left of its budget."""
    inside = rows.join(cuts, rows["source"].eqNullSafe(cuts["cut_source"])).where(F.shiftright("key", shift + RANGE_BITS) == F.col("range"))
    sums = inside.groupBy("cut_source", "epochs", "left", F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("here"))
    running = sums.withColumn("upto", F.sum("here").over(Window.partitionBy("cut_source").orderBy("at")))
    first = F.row_number().over(Window.partitionBy("cut_source").orderBy("at"))
    return running.where(F.col("upto") > F.col("left")).withColumn("n", first).where("n = 1").select("cut_source", "epochs", (F.col("left") - (F.col("upto") - F.col("here"))).alias("left"), F.col("at").alias("range"))


def source_cuts(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(cut_source, source_size, target, epochs, cut_key, tied, extra) of slim rows (source, size, key).

    A document is taken `epochs` times, and once more if its key is below cut_key; of the `tied` rows that have cut_key,
    which are alike, `extra` are taken once more. A row is taken if half of it fits into what is left, so a source misses
    its target by at most half of one document, however many rows are alike. An empty source has 0 epochs and no cut_key.
    """
    targets = staged(source_targets(sizes, weights, max_repeat), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.select(F.col("source").alias("cut_source"), "source_size", "target", epochs.alias("epochs"))
    cuts = budgets.select("cut_source", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("range"))
    for shift in range(KEY_BITS - RANGE_BITS, KEY_BITS - 3 * RANGE_BITS, -RANGE_BITS):
        cuts = _crossing(sizes, cuts, shift)
    shift = KEY_BITS - 2 * RANGE_BITS
    cuts = staged(cuts, "mix-ranges")
    last = sizes.join(cuts, sizes["source"].eqNullSafe(cuts["cut_source"])).where(F.shiftright("key", shift) == F.col("range"))
    keys = last.groupBy("cut_source", "left", "key").agg(F.sum("size").alias("here"), F.count("*").alias("tied"))
    upto = F.sum("here").over(Window.partitionBy("cut_source").orderBy("key"))
    crossing = keys.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    first = crossing.groupBy("cut_source").agg(F.min_by(F.struct("key", "tied", "here", "left", "upto"), "key").alias("x"))
    fits = F.floor((F.col("x.left") - (F.col("x.upto") - F.col("x.here"))) * F.col("x.tied") / F.col("x.here") + 0.5)
    exact = first.select(F.col("cut_source").alias("s"), F.col("x.key").alias("cut_key"), F.col("x.tied").alias("tied"), F.greatest(F.lit(0), F.least(fits, F.col("x.tied"))).cast("long").alias("extra"))
    return budgets.join(exact, budgets["cut_source"].eqNullSafe(exact["s"]), "left").drop("s")


def _times(rows: DataFrame, n: Column, name: str, chunk: int = 65_536) -> DataFrame:
    """Each row n times with its number from 1 on: a row that comes very often is dealt out in chunks first."""
    dealt = rows.withColumn("__n", n).where("__n > 0").withColumn("__from", F.explode(F.sequence(F.lit(1), F.col("__n"), F.lit(chunk).cast("long")))).repartition("__from")
    return dealt.withColumn(name, F.explode(F.sequence("__from", F.least(F.col("__from") + chunk - 1, F.col("__n"))))).drop("__n", "__from")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row per input row.

    size is the number of words (null text: 0, taken 0). Null sources form one source. The key is one of id and text;
    rows of one source alike in both are cut by their number. Empty input gives no rows; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), F.col(text_col)).alias("key"))
    sizes = staged(slim, "mix-sizes")
    cuts = staged(source_cuts(sizes, weights, max_repeat), "mix-cuts")
    rows = sizes.join(cuts, sizes["source"].eqNullSafe(cuts["cut_source"]))
    many = F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("tied") > 1), F.lit(False))
    copies = F.col("epochs") + F.coalesce((F.col("key") < F.col("cut_key")).cast("long"), F.lit(0)) + F.when(F.col("key") == F.col("cut_key"), F.col("extra")).otherwise(0)
    out = ["doc_id", "source", "size", "source_size", "target"]
    single = rows.where(~many).select(*out, (F.col("size") * copies).alias("taken"))
    alike = rows.where(many).groupBy(*out, "epochs", "extra").agg(F.count("*").alias("n"))
    numbered = _times(alike, F.col("n"), "i").select(*out, (F.col("size") * (F.col("epochs") + (F.col("i") <= F.col("extra")).cast("long"))).alias("taken"))
    return single.unionByName(numbered)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, *, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with all their columns. Rows without words are not taken.

    The key is one of all columns, so rows of one key are alike in all of them.
    """
    key = random_key(*map(F.col, docs.columns))
    slim = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    cuts = staged(source_cuts(staged(slim, "mix-sizes"), weights, max_repeat), "mix-cuts")
    cuts = cuts.select(F.struct("cut_source", "epochs", "cut_key", "tied", "extra").alias("__cut"))
    rows = docs.join(cuts, docs[source_col].eqNullSafe(F.col("__cut.cut_source"))).where(F.col(text_col).rlike(WORD)).withColumn("__key", key)
    many = F.coalesce((F.col("__key") == F.col("__cut.cut_key")) & (F.col("__cut.tied") > 1), F.lit(False))
    copies = F.col("__cut.epochs") + F.coalesce((F.col("__key") < F.col("__cut.cut_key")).cast("long"), F.lit(0)) + F.when(F.col("__key") == F.col("__cut.cut_key"), F.col("__cut.extra")).otherwise(0)
    single = rows.where(~many).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    alike = rows.where(many).groupBy(*docs.columns, "__cut").agg(F.count("*").alias("__rows"))
    numbered = _times(alike, F.col("__rows") * F.col("__cut.epochs") + F.col("__cut.extra"), "__copy")
    return single.select(*docs.columns).unionByName(numbered.select(*docs.columns))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS key
    FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap,
           row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per_source),
levelled AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levelled),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
placed AS (
    SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING) AS upto
    FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
