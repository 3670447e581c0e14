"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Encoding: a task parts its texts into pre-tokens and writes them per block of texts as positions in the block's word
list (each distinct word of a block leaves it once, however common it is). The words are dealt out by hash, so that each
distinct word of the corpus is in one task and encoded once there; its ids go back to the blocks that asked for it,
where texts are put together by position. Words travel packed, a row per (block, bucket); positions stay where they are,
in a table with buckets by block. Decoding joins the token-byte
table, which is as large as the vocabulary and so broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged_buckets, table

#: A block ends after so many characters; a text is never split over blocks.
BLOCK_CHARS = 6_000_000
#: Above this length the pre-tokens of one text are read one by one, so that only their numbers are in memory.
LONG_TEXT = 1_000_000
#: A task forgets its encoded words beyond this number; a word that comes again is then encoded again.
MEMO_WORDS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack_bytes(items: list[bytes]) -> bytes:
    """Byte strings as one compressed value; unpack_bytes() undoes it."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items))


def unpack_bytes(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.frombuffer(raw, "<u4", n, 4).astype(np.int64).cumsum() + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=False)]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32, bytes of one weight together so that the high ones vanish."""
    wide = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(wide).tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


BLOCK_SCHEMA = "block long, doc_ids array<long>, lengths binary, positions binary, words array<struct<bucket:int, packed:binary>>"


def split_blocks(pattern: str, n_buckets: int, block_chars: int = BLOCK_CHARS):
    """mapInArrow: (doc_id, text) to blocks. positions number the words in the order of the buckets' lists, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, place = regex.compile(pattern), TaskContext.get().partitionId()
        n_blocks, words, ids, parts, size = 0, {}, [], [], 0

        def block() -> pa.RecordBatch:
            names = [w.encode() for w in words]
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in names), np.int64, len(names))
            order = np.argsort(bucket, kind="stable")
            place_of = np.empty(len(names), np.uint32)
            place_of[order] = np.arange(len(names), dtype=np.uint32)
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()
            packed = [{"bucket": b, "packed": pack_bytes([names[i] for i in order[cuts[b] : cuts[b + 1]]])} for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            lengths = np.array([len(p) for p in parts], np.uint32)
            positions = place_of[np.concatenate(parts)] if words else np.empty(0, np.uint32)
            row = {"block": (place << 32) + n_blocks, "doc_ids": ids, "lengths": pack_numbers(lengths), "positions": pack_numbers(positions), "words": packed}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("positions", pa.binary()), ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())])))]))

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                found = find.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in find.finditer(text))
                parts.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32))
                ids.append(doc_id)
                size += len(text)
                if size >= block_chars:
                    yield block()
                    n_blocks, words, ids, parts, size = n_blocks + 1, {}, [], [], 0
        if ids:
            yield block()

    return run


def encode_words(ranks):
    """mapInArrow: (block, bucket, packed words) to (block, bucket, packed ids of each word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        memo: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for packed in batch.column(2):
                ids = []
                for word in unpack_bytes(packed.as_py()):
                    if (got := memo.get(word)) is None:
                        if len(memo) > MEMO_WORDS:
                            memo.clear()
                        got = memo[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(pack_bytes(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "packed"])

    return run


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_ids, lengths, positions, coded) of a block to (doc_id, ids)."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = [x for part in sorted(row["coded"] or [], key=lambda c: c["bucket"]) for x in unpack_bytes(part["packed"])]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
            positions, at = unpack_numbers(row["positions"]), 0
            rows, pending = [], 0
            for doc_id, n in zip(row["doc_ids"], unpack_numbers(row["lengths"]).tolist(), strict=True):
                words = positions[at : at + n]
                at += n
                counts = size[words]
                ends = np.cumsum(counts)
                total = int(ends[-1]) if n else 0
                where = np.arange(total) + np.repeat(start[words] - (ends - counts), counts)
                rows.append((doc_id, flat[where].astype(np.int32)))
                pending += total
                if pending > 100_000:
                    yield _id_rows(rows)
                    rows, pending = [], 0
            if rows:
                yield _id_rows(rows)


def _id_rows(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for _, x in rows])))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), ids], names=["doc_id", "ids"])


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>): a row per input row, as an encoder of the rank file gives for ordinary text.

    Null and empty texts have no ids. Special tokens in a text are ordinary characters. Rows with one id stay separate
    rows. Other columns are not read. A block's words and positions are one task's memory; a longer text is a block.
    """
    return _encoded_blocks(docs, ranks_path, pattern, id_col, text_col, block_chars).mapInArrow(assemble, "doc_id long, ids array<int>")


def _encoded_blocks(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_ids, lengths, positions, coded) of each block, as assemble() takes it."""
    spark = docs.sparkSession
    n_buckets = partitions(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = staged_buckets(texts.mapInArrow(split_blocks(pattern, n_buckets, block_chars), BLOCK_SCHEMA), "bpe-blocks", "block", n_buckets)
    asked = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.packed")
    coded = asked.repartition(n_buckets, "bucket").mapInArrow(encode_words(ranks), "block long, bucket int, packed binary")
    coded = coded.groupBy("block").agg(F.collect_list(F.struct("bucket", "packed")).alias("coded"))
    return blocks.select("block", "doc_ids", "lengths", "positions").join(coded, "block", "left").select("doc_ids", "lengths", "positions", "coded")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_bytes, decoded) of (doc_id, ids): the ids as little-endian 32-bit numbers and the bytes they stand for.

    Null ids are no ids. An id outside the vocabulary raises an error. The token-byte table is broadcast: it has an
    entry per token of the vocabulary.
    """
    run = decode_ids(encoded.sparkSession, ranks_path)
    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


DECODED = "doc_id long, n_tokens long, ids_bytes binary, decoded binary"


def decode_ids(spark, ranks_path: str):
    """mapInArrow: (doc_id, ids) to DECODED."""
    ranks = load_ranks(ranks_path)
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    tokens = spark.sparkContext.broadcast(by_id)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_bytes", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.value.__getitem__
        for batch in batches:
            arrays = [np.empty(0, np.int32) if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in batch.column(1)]
            packed = [x.astype("<u4").tobytes() for x in arrays]
            decoded = [b"".join(map(of, x.tolist())) for x in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in arrays], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

    return run


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_bytes, ids_sha256, decoded_sha256) of docs by the public 50k byte-level vocabulary.

    Texts are put together and decoded in one Python process of a task, so ids don't go through the JVM in between.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decode = decode_ids(docs.sparkSession, path)
    out = _encoded_blocks(docs, path, public_tokenizers.PATTERN).mapInArrow(lambda batches: decode(assemble(batches)), DECODED)
    return out.select("doc_id", "n_tokens", "ids_bytes", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).drop("ids_bytes")
