"""Line dedup: explode normalised lines, hash them, count documents per hash, drop common lines, put the rest together by position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged, table

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased, or None if that has under min_chars code points.

    bytes.strip() and bytes.lower() touch exactly 0x20, 0x09-0x0D and A-Z.
    """
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def line_hashes(min_chars: int):
    """mapInArrow: (doc_id, text) to (doc_id, digest), a row per distinct key of each text; a digest is 128 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                found = {xxhash.xxh3_128_digest(key) for line in lines if (key := line_key(line, min_chars))}
                ids += [doc_id] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], schema=schema)

    return run


def drop_lines(fields: pa.Schema, text_at: int, min_chars: int):
    """mapInArrow: rows with a last column of digests to the rows without those lines, n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, dropped in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True):
                text, gone = text.as_py(), set(dropped.as_py() or ())
                lines = (text or "").encode().split(b"\n")
                kept = lines if not gone else [x for x in lines if (key := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(key) not in gone]
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [*batch.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            columns[text_at] = pa.array(texts, fields.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with text_col rewritten, and n_lines and n_dropped (or _n_lines, ... where docs has such columns).

    A key of at least min_chars code points in at least min_docs different documents loses its lines in all of them but
    the one with the largest id. Null and empty texts are one empty line; an untouched text stays as it is, null
    included. Rows with one id are one document in the count, and each of them is rewritten. Rows with a null id belong
    to one more document, which is below every other.

    Two shuffles of (hash, id), pre-aggregated, one of the ids with something to drop, and one of the texts. The common
    lines are staged, so they are broadcast only if they are small; else the join is by sort-merge, whose skewed side (a
    line that a third of the documents share) adaptive execution splits. The texts are joined by sort-merge at every size,
    as the ids with something to drop grow with the corpus.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = source.mapInArrow(line_hashes(min_chars), "doc_id long, digest binary")
    counted = lines.groupBy("digest", "doc_id").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    common = staged(counted.where(F.col("n") >= min_docs).select("digest", "keeper"), "line-common")
    hits = lines.join(common, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    per_doc = staged(hits.groupBy(F.col("doc_id").alias("__doc_id")).agg(F.collect_set("digest").alias("__dropped")), "line-dropped")
    joined = docs.join(per_doc.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")), "left").select(*docs.columns, "__dropped")
    taken = set(docs.columns)
    extra = ["_" * (name in taken) + name for name in ("n_lines", "n_dropped")]
    out = docs.select("*", *(F.lit(0).cast("long").alias(x) for x in extra)).schema
    return joined.mapInArrow(drop_lines(to_arrow_schema(out), docs.columns.index(text_col), min_chars), out)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
