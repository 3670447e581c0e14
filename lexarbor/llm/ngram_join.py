"""N-gram Jaccard join by T-occurrence search (DivideSkip).

1. A shingle that one set alone has takes part in no overlap. Blocks of texts send their shingles, packed, to buckets by
   hash range, which count the sets of each and send back those that two or more have, with their frequency. Of a shingle
   that many sets of a block have only one entry with their number goes, so a bucket gets few entries of a block for it.
2. A set of n shingles needs T = ceil(0.75 n) in common with any partner, so sets with fewer shared shingles are done.
3. The rest, ordered by their least shingle, is cut into index chunks of bounded size. In a chunk a set is looked up in
   the inverted lists of its rarest shingles, which are merged and counted (short lists); candidates are then probed for
   the frequent ones by binary search (long lists, DivideSkip). Members of a component that the set is already linked
   with are skipped, so a group of copies costs its size, not its square.
4. What the chunks have not met: a set visits each other chunk where a set of another component has one of its rarest
   shingles (prefix filter: a pair above the threshold shares one). Twice a few sets per component go to the heaviest
   component that a shingle has, then all that still have somewhere to go, from lighter to heavier components.
Links are exact on 48-bit shingle hashes (two sets of 1,000 shingles have a false one in common once in 10**8 pairs); only links that connect something new are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, staged, table
from .components import components

WORDS, PERCENT = 5, 75
BLOCK_SHINGLES, CHUNK_SETS = 2_000_000, 512
#: A shingle that so many sets of a block have is sent once, under this mark instead of a set.
OFTEN, MARK = 8, 0xFFFFFFFF
#: Visitors of a chunk that are one row.
VISITORS = 4096
#: A set must meet a candidate in this many of its short lists (fewer if it needs fewer at all).
SHORT_HITS = 3
HUBS = 4
HASH_BITS = 48
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash, as a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word n-grams, sorted. bytes.lower() and bytes.split() take A-Z and 0x20, 0x09-0x0D."""
    parts = text.encode().lower().split()
    n = min(words, len(parts))
    if not n:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    mixed = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ own[i : len(own) - n + 1 + i]) * ODD[i % len(ODD)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers below 256**width, compressed with bytes of one weight together."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :width] = raw.T
    return wide.view("<u8").ravel()


def six_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))])
SENT_SQL = "bucket int, block long, hashes binary, sets binary, counts binary, ids array<long>"


def send_blocks(n_buckets: int, words: int, block_shingles: int):
    """mapInArrow: (doc_id, text) to packed shingles for each bucket, one row that tells of the block itself and one that keeps its frequent shingles.

    The first has, in place of hashes, sizes (hashes), the first row with the same shingles (sets) and ids; the second
    has no ids and which sets have the frequent ones. Of rows with the same shingles only the one with the least id sends
    them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, place = WordHashes(), TaskContext.get().partitionId()
        state = {"n": 0}

        def fresh():
            state.update(ids=[], sizes=[], same=[], first={}, held=[], total=0)

        def close() -> Iterator[pa.RecordBatch]:
            block = (place << 32) + state["n"]
            held = [(i, x) for i, x in enumerate(state["held"]) if x is not None]
            h = np.concatenate([x for _, x in held]) if held else np.empty(0, np.uint64)
            of = np.repeat(np.array([i for i, _ in held], np.uint64), [len(x) for _, x in held])
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            runs = np.diff(np.append(first, len(h)))
            often = np.repeat(runs >= OFTEN, runs)
            kept = {"bucket": block % n_buckets, "block": block, "hashes": pack(h[often], 6), "sets": pack(of[often], 4), "ids": []}
            again = first[runs >= OFTEN]
            weight = np.append(np.ones(len(h) - often.sum(), np.uint64), np.minimum(runs[runs >= OFTEN], 255).astype(np.uint64))
            h, of = np.append(h[~often], h[again]), np.append(of[~often], np.full(len(again), MARK, np.uint64))
            order = np.argsort(h, kind="stable")
            h, of, weight = h[order], of[order], weight[order]
            bucket = ((h >> np.uint64(16)) * np.uint64(n_buckets)) >> np.uint64(HASH_BITS - 16)
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64)).tolist()
            rows = [{"bucket": b, "block": block, "hashes": pack(h[cuts[b] : cuts[b + 1]], 6), "sets": pack(of[cuts[b] : cuts[b + 1]], 4), "counts": pack(weight[cuts[b] : cuts[b + 1]], 1)} for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            rows.append(kept)
            rows.append({"bucket": block % n_buckets, "block": block, "hashes": pack(np.array(state["sizes"], np.uint64), 6), "sets": pack(np.array(state["same"], np.uint64), 4), "ids": state["ids"]})
            yield pa.RecordBatch.from_pylist(rows, schema=SENT)
            state["n"] += 1
            fresh()

        fresh()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingles(value.as_py() or "", cache, words)
                at = len(state["ids"])
                state["ids"].append(doc_id)
                state["sizes"].append(len(own))
                state["held"].append(None)
                state["same"].append(at)
                if not len(own) or doc_id is None:
                    continue
                key = xxhash.xxh3_128_digest(own)
                other = state["first"].setdefault(key, at)
                if other == at:
                    state["held"][at] = own >> np.uint64(64 - HASH_BITS)
                    state["total"] += len(own)
                elif state["ids"][other] <= doc_id:
                    state["same"][at] = other
                else:
                    state["first"][key] = at
                    state["held"][at], state["held"][other] = state["held"][other], None
                    state["same"] = [at if x == other else x for x in state["same"]]
                if state["total"] >= block_shingles:
                    yield from close()
        if state["ids"]:
            yield from close()

    return run


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow, rows sorted by bucket: shared shingles back to their blocks, with their number of sets (255: that or more)."""

    def counted(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([unpack(r["hashes"], 6) for r in rows])
        of = np.concatenate([unpack(r["sets"], 4) for r in rows])
        weight = [unpack(r["counts"], 1) for r in rows]
        block, weight = np.repeat(np.arange(len(rows)), list(map(len, weight))), np.concatenate(weight).astype(np.int64)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        runs = np.diff(np.append(first, len(h)))
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(np.add.reduceat(weight[order], first), runs)
        shared = count >= 2
        cuts = np.concatenate([[0], np.cumsum(np.bincount(block[shared], minlength=len(rows)))]).tolist()
        h, of, count = h[shared], of[shared], np.minimum(count[shared], 255)
        out = [{"bucket": bucket, "block": r["block"], "hashes": pack(h[a:b], 6), "sets": pack(of[a:b], 4), "counts": pack(count[a:b], 1)} for r, a, b in zip(rows, cuts, cuts[1:], strict=False) if a < b]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SENT)

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                yield pa.RecordBatch.from_pylist([row], schema=SENT)
                continue
            if rows and rows[0]["bucket"] != row["bucket"]:
                yield from counted(rows[0]["bucket"], rows)
                rows = []
            rows.append(row)
    if rows:
        yield from counted(rows[0]["bucket"], rows)


SET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("same_as", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("shared", pa.binary())])
SET_SQL = "doc_id long, same_as long, n long, least long, shared binary"


def gather_sets(percent: int):
    """mapInArrow: blocks with what came back to (doc_id, same_as, n, least, shared), shared from rare to frequent; null if too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(1):
                parts = parts.as_py()
                about, kept = next(p for p in parts if p["ids"]), next(p for p in parts if p["ids"] == [])
                back = [p for p in parts if p["ids"] is None]
                sizes, same = unpack(about["hashes"], 6).tolist(), unpack(about["sets"], 4).tolist()
                ids = about["ids"]
                h = np.concatenate([unpack(p["hashes"], 6) for p in back]) if back else np.empty(0, np.uint64)
                of = np.concatenate([unpack(p["sets"], 4) for p in back]).astype(np.int64) if back else np.empty(0, np.int64)
                count = np.concatenate([unpack(p["counts"], 1) for p in back]) if back else np.empty(0, np.uint64)
                often, marked = unpack(kept["hashes"], 6), of == MARK
                known = np.argsort(h[marked])
                frequency = count[marked][known][np.searchsorted(h[marked][known], often)] if len(often) else often
                h, of, count = np.append(h[~marked], often), np.append(of[~marked], unpack(kept["sets"], 4).astype(np.int64)), np.append(count[~marked], frequency)
                order = np.lexsort((h, count, of))
                h, of = h[order], of[order]
                cuts = np.searchsorted(of, np.arange(len(ids) + 1)).tolist()
                least, shared = [None] * len(ids), [None] * len(ids)
                for i in range(len(ids)):
                    own = h[cuts[i] : cuts[i + 1]]
                    if len(own) and 100 * len(own) >= percent * sizes[i]:
                        least[i], shared[i] = int(own.min()), six_bytes(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[x] for x in same], pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.int64()), pa.array(shared, pa.binary())], schema=SET_SCHEMA)

    return run


class Chunk:
    """Inverted lists over the shared shingles of some sets. sets: arrays from rare to frequent; sizes: their full sizes."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int):
        self.percent, self.sizes = percent, np.array(sizes, np.int64)
        self.sorted = [np.sort(x) for x in sets]
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(h, kind="stable")
        self.keys, self.starts = np.unique(h[order], return_index=True)
        self.starts = np.append(self.starts, len(h))
        self.of = of[order]
        self.roots = np.arange(len(sets))

    def search(self, own: np.ndarray, size: int, skip: np.ndarray | None = None) -> Iterator[int]:
        """One set of each root that the given one is linked with; skip tells by set which are of no interest."""
        need = -(-self.percent * size // 100)
        hits = min(SHORT_HITS, need)
        short = max(0, len(own) - need + hits)
        at = np.searchsorted(self.keys, own[:short])
        at = at[at < len(self.keys)]
        at = at[np.isin(self.keys[at], own[:short])]
        if not len(at):
            return
        met = np.bincount(np.concatenate([self.of[a:b] for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True)]), minlength=len(self.sizes))
        fits = (met >= hits) & (100 * self.sizes >= self.percent * size) & (self.percent * self.sizes <= 100 * size)
        if skip is not None:
            fits &= ~skip
        found = np.flatnonzero(fits)
        linked: set[int] = set()
        for i in found[np.argsort(-met[found], kind="stable")].tolist():
            if self.roots[i] in linked:
                continue
            theirs = self.sorted[i]
            where = np.searchsorted(theirs, own)
            where[where == len(theirs)] = 0
            both = int((theirs[where] == own).sum())
            if (100 + self.percent) * both >= self.percent * (size + int(self.sizes[i])):
                linked.add(self.roots[i])
                yield i

    def link_all(self, sets: list[np.ndarray]) -> None:
        """Sets roots to the least index of each set's component inside the chunk."""
        for i, own in enumerate(sets):
            skip = (self.roots == self.roots[i]) | (np.arange(len(sets)) > i)
            for j in list(self.search(own, int(self.sizes[i]), skip)):
                a, b = sorted((self.roots[i], self.roots[j]))
                self.roots[self.roots == b] = a


CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("roots", pa.list_(pa.int64())), ("shared", pa.list_(pa.binary()))])
CHUNK_SQL = "chunk long, nodes array<long>, sizes array<long>, roots array<long>, shared array<binary>"


def build_chunks(percent: int, chunk_sets: int):
    """mapInArrow: (node, n, shared) in an order that brings likely partners together, to searched chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, rows = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            sets = [from_six_bytes(r["shared"]) for r in rows]
            own = Chunk(sets, [r["n"] for r in rows], percent)
            own.link_all(sets)
            nodes = [r["node"] for r in rows]
            least: dict[int, int] = {}
            for root, node in zip(own.roots.tolist(), nodes, strict=True):
                least[root] = min(node, least.get(root, node))
            return pa.RecordBatch.from_pylist([{"chunk": place + n, "nodes": nodes, "sizes": [r["n"] for r in rows], "roots": [least[r] for r in own.roots.tolist()], "shared": [r["shared"] for r in rows]}], schema=CHUNK_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == chunk_sets:
                    yield close()
                    n, rows = n + 1, []
        if rows:
            yield close()

    return run


RARE_SQL = "h long, label long, weight long, chunk long, low long, high long, reach long, going array<struct<node:long,n:long,top:long>>"


def rare_lists(percent: int, hubs: int | None):
    """mapInArrow: (chunk, nodes, sizes, shared, roots, labels) to a row per rare shingle, component and chunk.

    Rare are the rarest shingles of a set of which one is shared with any partner. The rarest that a pair shares has all
    that they share from it on, so its place in a set of n bounds the size of the partner: `left` shingles from it on
    must be the overlap of n and that size at least (top). low and high bound the sizes of the sets that have it here,
    reach their tops; going are those that may visit other chunks: with hubs, about so many of a component.
    """
    schema = pa.schema([(x, pa.int64()) for x in ("h", "label", "weight", "chunk", "low", "high", "reach")] + [("going", pa.list_(pa.struct([(x, pa.int64()) for x in ("node", "n", "top")])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = {x["root"]: (x["label"], x["weight"]) for x in row["labels"]}
                found: dict[tuple[int, int], list] = {}
                for node, n, root, packed in zip(row["nodes"], row["sizes"], row["roots"], row["shared"], strict=True):
                    label, weight = of[root]
                    part = packed[: 6 * max(0, len(packed) // 6 - -(-percent * n // 100) + 1)]
                    goes = hubs is None or node == label or xxhash.xxh3_64_intdigest(node.to_bytes(8, "little", signed=True)) % weight < hubs
                    for left, h in zip(range(len(packed) // 6, 0, -1), from_six_bytes(part).tolist(), strict=False):
                        top = (100 + percent) * left // percent - n
                        if (got := found.get((h, label))) is None:
                            got = found[h, label] = [h, label, weight, row["chunk"], n, n, top, []]
                        got[4], got[5], got[6] = min(got[4], n), max(got[5], n), max(got[6], top)
                        if goes:
                            got[7].append({"node": node, "n": n, "top": top})
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found.values(), strict=True) if found else [[]] * 8, schema, strict=True)], schema=schema)

    return run


def visit_chunks(percent: int):
    """mapInArrow: (nodes, sizes, roots, shared, labels, visitors) to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk([from_six_bytes(s) for s in row["shared"]], row["sizes"], percent)
                number = {r: i for i, r in enumerate(dict.fromkeys(row["roots"]))}
                own.roots = np.array([number[r] for r in row["roots"]])
                label = {x["root"]: x["label"] for x in row["labels"]}
                labels = np.array([label[r] for r in row["roots"]])
                found = [(v["node"], row["nodes"][i]) for v in row["visitors"] for i in own.search(from_six_bytes(v["shared"]), v["n"], labels == v["label"])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _visits(chunks: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (a, b) found by sets that visit chunks of other components with which they share a rare shingle.

    Unless `every`, only hubs go, and per shingle only to the heaviest component there: a star, so that copies that
    several chunks hold come together in as many visits as there are chunks. With `every`, all sets of a component go to
    the chunks of all heavier ones. A shingle that one component alone has leads nowhere. What goes from one chunk to
    another is bundled over the shingles before it is taken apart, so a set that shares many of them goes once; a bundle
    is bounded by the sets of its home chunk. A chunk's visitors come in rows of about VISITORS.
    """
    of = chunks.select("chunk", F.explode(F.array_distinct("roots")).alias("node")).join(labels, "node")
    of = of.groupBy("chunk").agg(F.collect_list(F.struct(F.col("node").alias("root"), "label", "weight")).alias("labels"))
    labelled = chunks.join(of, "chunk")
    rare = labelled.select("chunk", "nodes", "sizes", "shared", "roots", "labels").mapInArrow(rare_lists(percent, None if every else HUBS), RARE_SQL)
    at = Window.partitionBy("h")
    heaviest = F.max(F.struct("weight", "label", "chunk", "low", "high", "reach")).over(at)
    mixed = rare.withColumn("least", F.min("label").over(at)).withColumn("most", F.max("label").over(at)).withColumn("to", heaviest).where("least < most")
    if every:
        mixed = staged(mixed.drop("to", "least", "most"), "ngram-mixed")
        least = F.array_min(F.transform("going", lambda x: x["n"])).alias("least")
        top = F.array_max(F.transform("going", lambda x: x["top"])).alias("top")
        going = mixed.where(F.size("going") > 0).select("h", F.col("chunk").alias("home"), F.col("label").alias("from"), F.col("weight").alias("light"), "going", least, top)
        there = mixed.select("h", "label", "weight", "chunk", "low", "high", "reach")
        heavier = (F.col("light") < F.col("weight")) | ((F.col("light") == F.col("weight")) & (F.col("from") < F.col("label")))
        sized = (F.col("low") <= F.col("top")) & (F.col("least") <= F.col("reach"))
        legs = going.join(there, "h").where(heavier & sized).select("home", "going", "chunk", F.col("from").alias("label"), "low", "high", "reach")
    else:
        legs = mixed.where("label <> to.label").select(F.col("chunk").alias("home"), "going", F.col("to.chunk").alias("chunk"), "label", *(F.col(f"to.{x}").alias(x) for x in ("low", "high", "reach")))
    fitting = F.filter("going", lambda x: (percent * x["n"] <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * x["n"]) & (F.col("low") <= x["top"]) & (x["n"] <= F.col("reach")))
    legs = legs.select("home", "label", "chunk", F.transform(fitting, lambda x: x["node"]).alias("going")).where(F.size("going") > 0)
    bundles = staged(legs.groupBy("home", "label", "chunk").agg(F.array_distinct(F.flatten(F.collect_set("going"))).alias("going")), "ngram-bundles")
    rows = bundles.groupBy("chunk").agg(F.ceil(F.sum(F.size("going")) / VISITORS).alias("rows"))
    pairs = bundles.join(rows, "chunk").select(F.explode("going").alias("visitor"), "chunk", "label", "rows").withColumn("row", F.pmod(F.xxhash64("visitor"), "rows")).drop("rows")
    carried = pairs.join(sets.select(F.col("node").alias("visitor"), "n", "shared"), "visitor")
    visitors = carried.groupBy("chunk", "row").agg(F.collect_list(F.struct(F.col("visitor").alias("node"), "n", "label", "shared")).alias("visitors"))
    work = labelled.join(visitors, "chunk").select("nodes", "sizes", "roots", "shared", "labels", "visitors")
    return staged(work.mapInArrow(visit_chunks(percent), "a long, b long"), "ngram-links")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per input row.

    Two documents link if their sets of distinct word n-grams have a Jaccard similarity of at least percent/100;
    component_id is the least id reachable by links. A text with fewer words is one shingle, one without words or null
    has none and links with nothing. Rows that share an id are one document. A row with a null id links with nothing and
    has a null component. Empty input gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = texts.mapInArrow(send_blocks(4 * n, words, block_shingles), SENT_SQL)
    back = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(count_buckets, SENT_SQL)
    blocks = back.groupBy("block").agg(F.collect_list(F.struct("hashes", "sets", "counts", "ids")).alias("parts"))
    rows = staged(blocks.mapInArrow(gather_sets(percent), SET_SQL), "ngram-sets")
    sets = rows.where("shared IS NOT NULL").select(F.col("doc_id").alias("node"), "n", "least", "shared")
    ordered = sets.repartitionByRange(n, "least", "node").sortWithinPartitions("least", "n", "node").select("node", "n", "shared")
    chunks = staged(ordered.mapInArrow(build_chunks(percent, chunk_sets), CHUNK_SQL), "ngram-chunks")
    pairs = chunks.select(F.explode(F.arrays_zip("nodes", "roots")).alias("x")).select(F.col("x.nodes").alias("a"), F.col("x.roots").alias("b"))
    same = rows.where("same_as <> doc_id").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b"))
    found, links = components(pairs), pairs
    for every in (False, False, True):
        labels = chunks.select(F.explode(F.array_distinct("roots")).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        sizes = pairs.join(labels, F.col("b") == F.col("node")).groupBy("label").agg(F.count("*").alias("weight"))
        more = _visits(chunks, sets, staged(labels.join(sizes, "label").select("node", "label", "weight"), "ngram-labels"), percent, every)
        links = links.unionByName(more)
        found = components(links.unionByName(same) if every else links)
        release(spark)
    return rows.join(found, rows["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
