"""Quality rules: base counts of words and lines, and compression bands.

Bands: the zstandard ratio (compressed / plain bytes) of the whole text and of its fixed chunks, the rest at its end too,
must lie inside limits that depend on the length, as short texts compress less, and on the script, as mostly ASCII prose
compresses more than prose of several bytes a letter. Below a band the text repeats itself; above it, it is noise
(random or already compressed characters), which prose of any script is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CHUNK = 4096
#: (bytes up to, least ratio, greatest ratio): the lower limit falls with the length as a longer prose text repeats more of its own words; the upper one, too.
BANDS = ((512, 0.35, 0.95), (2048, 0.30, 0.85), (8192, 0.30, 0.80), (65536, 0.25, 0.75), (1 << 62, 0.20, 0.75))
#: The same for text of which ASCII_SHARE of the bytes or more are ASCII. Greatest ratios of prose (sf0.1 in four languages; dense Markdown): 0.78 at 300 bytes, 0.75 at 512, 0.70 up to 1,024, 0.66 up to 2,048, 0.58 up to 8,192, 0.48 above.
ASCII_BANDS = ((256, 0.35, 0.95), (384, 0.35, 0.85), (512, 0.35, 0.80), (1024, 0.30, 0.75), (2048, 0.30, 0.70), (8192, 0.30, 0.62), (65536, 0.25, 0.55), (1 << 62, 0.20, 0.50))
ASCII_SHARE = 0.8
#: Share of a text's chunks that may lie outside the band of their length.
MAX_BAD_CHUNKS = 0.2
#: A rest of fewer bytes belongs to the chunk before it, as its own ratio says little.
MIN_REST = 256


def in_band(ratio: float, n_bytes: int, bands=BANDS) -> bool:
    low, high = next((low, high) for most, low, high in bands if n_bytes <= most)
    return low <= ratio <= high


def bands_of(data: bytes):
    """The bands for the script of a text."""
    return ASCII_BANDS if np.count_nonzero(np.frombuffer(data, np.uint8) < 128) >= ASCII_SHARE * len(data) else BANDS


def compression_verdict(data: bytes, pack, bands=None, chunk: int = CHUNK, max_bad: float = MAX_BAD_CHUNKS) -> tuple[bool, float, int]:
    """Whether the text passes, its whole ratio and the number of chunks outside their band (by script if bands is None). An empty text fails with ratio 0."""
    if not data:
        return False, 0.0, 0
    ratio = len(pack(data)) / len(data)
    starts = list(range(0, len(data), chunk))
    if len(starts) > 1 and len(data) - starts[-1] < min(MIN_REST, chunk):
        starts.pop()
    chunks = [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)] if len(starts) > 1 else []
    bad = sum(not in_band(len(pack(x)) / len(x), len(x), bands or bands_of(x)) for x in chunks)
    return in_band(ratio, len(data), bands or bands_of(data)) and bad <= max_bad * len(chunks), ratio, bad


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, every occurrence counted."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    windows = pairs[:-1] * np.int64(len(ids)) + code[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() parts at exactly 0x20 and 0x09-0x0D."""
    data = text.encode()
    words = data.split()
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def quality_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands=None, chunk: int = CHUNK, level: int = 3) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, bad_chunks, kept): a row per input row.

    A null text has no words, so it fails. A text is one task's work whatever its length; memory is a few times that of
    the longest text. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                passed, ratio, bad = compression_verdict(text.encode(), pack, bands, chunk)
                rows.append((*counts, failed, ratio, bad, passed and not failed))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(chain([batch.column(0)], columns), schema, strict=True)], schema=schema)

    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, kept boolean"
    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) doc_id", f"`{text_col}` text").mapInArrow(run, names)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
