"""Language ID by string kernels.

The kernel of two texts counts the distinct n-grams of 1 to 3 code points that both have, divided by the geometric mean
of their own counts (blended-spectrum presence kernel). Texts are mapped to their kernels with landmark texts (Nyström),
and a kernel ridge regression per language (one versus the rest) is fitted there. As the kernel is linear in the
presence of n-grams, landmarks, Nyström map and regression fold into one matrix of landmark n-grams by languages, and
scoring is its product with a batch's presence matrix, which is sparse: the rows of the n-grams that are present are
summed, so a text costs what it holds and not what the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

N_MAX = 3
#: Bounds of the fit: labelled texts per language, landmarks among them, and code points of a text that it may learn from.
TRAIN_PER_LANG, LANDMARKS_PER_LANG, TRAIN_CHARS = 300, 60, 20_000
#: Bound of the model and so of its broadcast; more languages raise an error.
MAX_LANGUAGES = 200
#: Numbers of the model that are gathered at once.
GATHERED = 1 << 22
RIDGE = 0.05
BATCH = 64
PIECE = 500_000
LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text in lower case, sorted; n code points in 21 bits each, so different n-grams are different numbers."""
    text = text.lower()
    out = np.empty(0, np.uint64)
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE + N_MAX - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        parts = [codes]
        for _ in range(N_MAX - 1):
            parts.append((parts[-1][:-1] << np.uint64(21)) | codes[len(parts) :])
        found = np.unique(np.concatenate(parts))
        out = found if not len(out) else np.union1d(out, found)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """vocabulary: sorted n-grams of the landmarks; weights: float32 (n-grams, languages)."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        """A row per text: its regression values. batch: the n-grams of each."""
        out, step = np.zeros((len(batch), len(self.languages))), max(1, GATHERED // max(1, len(self.languages)))
        for row, own in zip(out, batch, strict=True):
            at = np.searchsorted(self.vocabulary, own)
            at[at == len(self.vocabulary)] = 0
            at = at[self.vocabulary[at] == own]
            for start in range(0, len(at), step):
                row += self.weights[at[start : start + step]].sum(0, dtype=float)
        norms = np.sqrt(np.maximum([len(x) for x in batch], 1))
        return out / norms[:, None]


def fit(texts: list[str], labels: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> LanguageModel:
    """texts in a fixed order; the first landmarks_per_lang of each language are the landmarks. No texts: a model without languages."""
    languages = sorted(set(labels))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is bounded to {MAX_LANGUAGES}")
    if not languages:
        return LanguageModel([], np.zeros(1, np.uint64), np.zeros((1, 0), np.float32))
    own = [grams(t) for t in texts]
    chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:landmarks_per_lang]]
    vocabulary = np.unique(np.concatenate([own[i] for i in chosen]))
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[np.searchsorted(vocabulary, own[i]), k] = 1 / np.sqrt(len(own[i]))
    kernel = np.empty((len(own), len(chosen)))
    for i, x in enumerate(own):
        at = np.searchsorted(vocabulary, x)
        at[at == len(vocabulary)] = 0
        kernel[i] = marks[at[vocabulary[at] == x]].sum(0) / np.sqrt(len(x))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values[-1]
    nystroem = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ nystroem
    targets = np.array([[float(x == lang) for lang in languages] for x in labels])
    solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ targets)
    return LanguageModel(languages, vocabulary, (marks @ (nystroem @ solved)).astype(np.float32))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, held_out: Column, per_lang: int = TRAIN_PER_LANG, max_chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """At most per_lang labelled texts of each language, those whose ids hash lowest, of 1 to max_chars code points.

    Ids are chosen first, on (language, id) alone and with a limit per task, and only then are the chosen texts read. Of
    rows that share an id, the least (language, text) is taken.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.length(text_col).between(1, max_chars) & ~held_out & F.col(id_col).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    chosen = [r["id"] for r in ids.select("id").distinct().collect()]
    rows = usable.where(F.col(id_col).isin(chosen)).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))).alias("row")).orderBy("id").collect()
    return [r["row"]["text"] for r in rows], [r["row"]["lang"] for r in rows]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    return fit(*training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_out=is_held_out(F.col(id_col))))


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the predicted language and its score (the regression value of the language, cut to 0..1).

    `und` and 0 for a null text, one without a letter, and where the model has no languages; of equal scores the first
    language by code point. Columns of docs that are called lang_as or score_as are replaced. No shuffle; the model is
    broadcast: its size is bounded by the landmarks' number and length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang_as, score_as)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            column = batch.column(0).field(place)
            for chunk in batched(range(batch.num_rows if own.languages else 0), BATCH):
                texts = {i: t for i in chunk if (t := column[i].as_py()) is not None and LETTER.search(t)}
                if not texts:
                    continue
                values = own.scores([grams(t) for t in texts.values()])
                for i, best, value in zip(texts, values.argmax(1).tolist(), values.max(1).tolist(), strict=True):
                    lang[i], score[i] = own.languages[best], min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang", "score"])

    rows = docs.select(F.struct(*(F.col(c) for c in kept), F.col(text_col).alias("__text")).alias("row")) if text_col not in kept else docs.select(F.struct(*kept).alias("row"))
    place = len(kept) if text_col not in kept else kept.index(text_col)
    out = rows.mapInArrow(run, rows.select("row", F.lit("").alias("lang"), F.lit(0.0).alias("score")).schema)
    return out.select(*(F.col("row")[c].alias(c) for c in kept), F.col("lang").alias(lang_as), F.col("score").alias(score_as))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
