"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from exact neighbours inside blocks of rows that random hyperplanes sort together. A round of
NN-descent joins each node's neighbours and reverse neighbours with their vectors, compares them with each other (they
are neighbours of neighbours), and offers each the best it has met; nodes keep their best. Vectors of one direction are
one node, so copies neither crowd a node's list nor meet in one task. All cosines are doubles of the original numbers and
equal ones go by the lesser node, so near copies are told apart as finely as doubles can. A query starts at its own node
and at a few that all queries share, and follows, hop by hop, the edges of the best nodes it has seen but not yet
expanded, until none is left. A table of fewer rows than two blocks is one block, whose lists are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, staged, table

NEIGHBOURS, BLOCK, STARTS, OFFERED, STILL = 32, 2048, 6, 12, 0.04
BEAM, EXPAND, ENTRIES, TOP = 256, 64, 16, 5
LISTS = "node long, others array<long>, sims array<double>"
LISTS_ARROW = pa.schema([("node", pa.int64()), ("others", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])


def _vectors(column) -> np.ndarray:
    """An Arrow column of packed vectors of one width as a matrix of doubles, each scaled by a power of two to a greatest number of 0.5 to 1."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    v = np.ascontiguousarray(packed[:, 1:]).view(np.float32 if packed[0, 0] == ord("f") else np.float64).astype(float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) and (node, packed): usable vectors and their distinct directions.

    Vectors that are null, empty or zero, or hold a null or a non-finite number, and null ids take no part. An id that
    comes with several vectors keeps the least by bytes. Shorter vectors are filled up with zeros. node is the least id
    of a direction (normalised numbers equal in 13 decimals); packed has its numbers, as floats if all of the table are
    floats and else as doubles, after a byte that says which.
    """
    doubles = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = doubles.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    width, short = usable.select(F.max(F.size("v")), F.bool_and(F.forall("v", lambda x: x.cast("float").cast("double") == x))).first()
    width, mark, kind = width or 1, *((b"f", np.float32) if short else (b"d", np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.pad(np.array(x, float), (0, width - len(x))) + 0.0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark + x.astype(kind).tobytes() for x in rows], pa.binary())], names=["vec_id", "packed"])

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(1))
                v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 13) + 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "packed", "direction"])

    rows = usable.mapInArrow(run, "vec_id long, packed binary").groupBy("vec_id").agg(F.min("packed").alias("packed"))
    rows = staged(rows.mapInArrow(directions, "vec_id long, packed binary, direction binary"), "ann-rows")
    values = staged(rows.groupBy("direction").agg(F.min(F.struct("vec_id", "packed")).alias("x")).select(F.col("x.vec_id").alias("node"), F.col("x.packed").alias("packed"), "direction"), "ann-values")
    members = staged(rows.select("vec_id", "direction").join(values.select("direction", "node"), "direction").select("vec_id", "node"), "ann-members")
    return members, values.select("node", "packed")


def _lists(nodes: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of what was offered to each node, best first; of equal ones the lesser node is the better."""
    order = np.lexsort((others, nodes))
    first = np.ones(len(order), bool)
    first[1:] = (nodes[order][1:] != nodes[order][:-1]) | (others[order][1:] != others[order][:-1])
    nodes, others, sims = nodes[order][first], others[order][first], sims[order][first]
    order = np.lexsort((others, -sims, nodes))
    nodes, others, sims = nodes[order], others[order], sims[order]
    whose, start = np.unique(nodes, return_index=True)
    size = np.diff(np.append(start, len(nodes)))
    good = np.arange(len(nodes)) - np.repeat(start, size) < k
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(size, k))]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(whose), pa.ListArray.from_arrays(offsets, pa.array(others[good])), pa.ListArray.from_arrays(offsets, pa.array(sims[good]))], schema=LISTS_ARROW)


def _best(v: np.ndarray, nodes: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, sim) of the k nodes of largest cosine with each node, itself left out and those under its floor; equal ones go by the lesser node."""
    order = np.argsort(nodes)
    v, nodes, floors = v[order], nodes[order], None if floors is None else floors[order]
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    sims = v @ v.T
    sims /= np.outer(norms, norms)
    np.fill_diagonal(sims, -2)
    k = min(k, len(nodes) - 1)
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, at, 1).min(1)
    tied = np.flatnonzero(np.count_nonzero(sims >= least[:, None], axis=1) > k)
    at[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(sims, at, 1)
    good = values >= (-2 if floors is None else floors[:, None])
    return np.repeat(nodes, good.sum(1)), nodes[at][good], values[good]


class Offers:
    """What a task has to offer, merged per node before it leaves the task: a hub, which is a neighbour of very many, gets a list from each buffer and not from each of them."""

    def __init__(self, k: int, most: int = 1_000_000):
        self.k, self.most, self.held, self.n = k, most, [], 0

    def add(self, nodes: np.ndarray, others: np.ndarray, sims: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((nodes, others, sims))
        self.n += len(nodes)
        if self.n >= self.most:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _lists(*map(np.concatenate, zip(*self.held, strict=True)), self.k)
        self.held, self.n = [], 0


def _merged(offers: DataFrame, k: int) -> DataFrame:
    """(node, others, sims) with the k best of all lists that were offered to a node, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).flatten()
            per_list = lists.value_lengths().to_numpy()
            nodes = np.repeat(np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()), per_list)
            yield _lists(nodes, lists.flatten().to_numpy(), batch.column(2).flatten().flatten().to_numpy(), k)

    lists = offers.groupBy("node").agg(F.collect_list("others").alias("others"), F.collect_list("sims").alias("sims"))
    return lists.mapInArrow(run, LISTS)


def first_graph(values: DataFrame, neighbours: int, starts: int, block: int) -> DataFrame:
    """Exact neighbours inside blocks of rows in the order of their sides of 16 random hyperplanes, `starts` times.

    The rows are dealt to as many tasks as they fill blocks, at most one for each shuffle partition, so that no block is
    small for the number of partitions; a table of one block is exact.
    """
    n = max(1, min(partitions(values.sparkSession), values.count() // block))
    offers = None
    for start in range(starts if n > 1 else 1):

        def sides(batches: Iterator[pa.RecordBatch], seed: int = start) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _vectors(batch.column(1))
                on = v / np.linalg.norm(v, axis=1, keepdims=True) @ np.random.default_rng(seed).standard_normal((v.shape[1], 16))
                code = ((on > 0) << np.arange(15, -1, -1)).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(on[:, 0])], names=["node", "packed", "code", "along"])

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, rows = [], []

            def close(to: int) -> Iterator[pa.RecordBatch]:
                ids = np.array(nodes[:to], np.int64)
                if to == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.float64()))], schema=LISTS_ARROW)
                elif to:
                    yield _lists(*_best(_vectors(pa.array(rows[:to], pa.binary())), ids, neighbours), neighbours)
                del nodes[:to], rows[:to]

            for batch in batches:
                nodes += batch.column(0).to_pylist()
                rows += batch.column(1).to_pylist()
                while len(nodes) >= 2 * block:
                    yield from close(block)
            yield from close(len(nodes))

        coded = values.select("node", "packed").mapInArrow(sides, "node long, packed binary, code long, along double")
        dealt = coded.repartitionByRange(n, "code", "along", "node").sortWithinPartitions("code", "along", "node").select("node", "packed")
        own = dealt.mapInArrow(inside, LISTS)
        offers = own if offers is None else offers.unionByName(own)
    return staged(_merged(offers, neighbours), "ann-graph")


def both_ways(graph: DataFrame, neighbours: int) -> DataFrame:
    """(node, other): each node's neighbours and at most as many of the nodes that it is a neighbour of, by hash."""
    out = graph.select("node", F.explode("others").alias("other"))
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"))
    back = out.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours)
    return out.unionByName(back.select("node", "other")).distinct()


def descend(graph: DataFrame, values: DataFrame, neighbours: int, offered: int) -> DataFrame:
    """One round of NN-descent: (node, others, sims) with what neighbours of neighbours had to offer."""
    floor = F.when(F.size("sims") >= neighbours, F.array_min("sims")).otherwise(F.lit(-2.0))
    own = values.join(graph.select("node", floor.alias("floor")), "node").select(F.col("node").alias("other"), "packed", "floor")
    met = both_ways(graph, neighbours).join(own, "other").groupBy("node").agg(F.collect_list("other").alias("others"), F.collect_list("packed").alias("packed"), F.collect_list("floor").alias("floors"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offers = Offers(neighbours)
        for batch in batches:
            for others, packed, floors in zip(*batch.columns[1:], strict=True):
                yield from offers.add(*_best(_vectors(packed.values), others.values.to_numpy(), offered, floors.values.to_numpy()))
        yield from offers.close()

    offers = met.mapInArrow(compare, LISTS)
    return staged(_merged(offers.unionByName(graph), neighbours), "ann-graph")


def neighbour_graph(values: DataFrame, *, neighbours: int = NEIGHBOURS, starts: int = STARTS, block: int = BLOCK, offered: int = OFFERED, still: float = STILL) -> DataFrame:
    """(node, others, sims) after NN-descent: until a round changes under `still` of the list entries.

    A list only ever gets better, so the rounds end at every table size. A table of one block needs none.
    """
    graph = first_graph(values, neighbours, starts, block)
    while values.count() >= 2 * block:
        after = descend(graph, values, neighbours, offered)
        change = graph.select("node", F.col("others").alias("was")).join(after.select("node", F.col("others").alias("now")), "node")
        new, total = change.select(F.sum(F.size(F.array_except("now", "was"))), F.sum(F.size("now"))).first()
        graph = after
        release(values.sparkSession)
        if not total or new < still * total:
            break
    return graph


def entry_nodes(values: DataFrame, entries: int) -> tuple[np.ndarray, list[bytes]]:
    """(nodes, packed) of the `entries` nodes that hash lowest, where every walk starts besides its own node."""
    rows = values.select("node", "packed").orderBy(F.xxhash64("node"), "node").limit(entries).collect()
    return np.array([r["node"] for r in rows], np.int64), [bytes(r["packed"]) for r in rows]


def greedy_search(starts: DataFrame, graph: DataFrame, values: DataFrame, *, neighbours: int = NEIGHBOURS, beam: int = BEAM, expand: int = EXPAND, entries: int = ENTRIES) -> DataFrame:
    """(query, seen) of start nodes (query, packed): the beam best (minus, node) that a walk has met; minus is the negative cosine.

    query is a node of the graph. A walk starts at its own node and at `entries` nodes common to all, so it leaves a
    part of the graph that is not linked to the rest. In a hop the best `expand` nodes of the beam that were not expanded
    yet are; it ends when its beam has none left. Of equal cosines the lesser node is the better one.
    """
    edges = staged(both_ways(graph, neighbours).groupBy("node").agg(F.collect_list("other").alias("others")), "ann-edges")
    item = "array<struct<minus:double,node:long,done:boolean>>"
    common, their = entry_nodes(values, entries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                minus = 0.0 - _cosines(_vectors(batch.column(2)), _vectors(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(minus)], names=["query", "node", "minus"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, query = _vectors(batch.column(1)), batch.column(0).to_numpy()
            for node, packed in [(query, own), *((np.full(len(own), n), np.repeat(_vectors(pa.array([p], pa.binary())), len(own), 0)) for n, p in zip(common, their, strict=True))]:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(0.0 - _cosines(own, packed))], names=["query", "node", "minus"])

    scores = "query long, node long, minus double"
    seen = F.collect_set(F.struct("minus", "node", F.lit(False).alias("done")))
    first = starts.select("query", "packed").mapInArrow(enter, scores).groupBy("query", "node").agg(F.min("minus").alias("minus")).groupBy("query").agg(F.sort_array(seen).cast(item).alias("seen"))
    state = staged(starts.join(first, "query").select("query", "packed", "seen"), "ann-state")
    while True:
        open_ = state.select("query", "packed", "seen", F.slice(F.filter("seen", lambda x: ~x["done"]), 1, expand).alias("next"))
        if open_.where(F.size("next") > 0).isEmpty():
            break
        steps = open_.select("query", F.explode("next.node").alias("node")).join(edges, "node").select("query", F.explode("others").alias("node")).distinct()
        known = state.select("query", F.explode("seen.node").alias("node"))
        fresh = steps.join(known, ["query", "node"], "left_anti")
        compared = fresh.join(values.select("node", F.col("packed").alias("their")), "node").join(state.select("query", "packed"), "query").select("query", "node", "packed", "their")
        met = compared.mapInArrow(score, scores).groupBy("query").agg(F.collect_list(F.struct("minus", "node", F.lit(False).alias("done"))).alias("met"))
        gone = F.transform("seen", lambda x: F.struct(x["minus"].alias("minus"), x["node"].alias("node"), (x["done"] | F.array_contains("next.node", x["node"])).alias("done")))
        together = open_.select("query", "packed", "next", gone.alias("seen")).join(met, "query", "left")
        best = F.slice(F.sort_array(F.concat("seen", F.coalesce("met", F.array().cast(item)))), 1, beam)
        state = staged(together.select("query", "packed", best.alias("seen")), "ann-state")
        release(values.sparkSession)
    return state.select("query", "seen")


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, beam: int = BEAM, **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of largest cosine for each row for which is_query(id column) holds.

    Scores are double-precision cosines of the original vectors; equal scores go by the lesser id. A query with fewer
    candidates gets all there are. Every usable row is in the index, and a query is never its own result.
    """
    members, values = nodes_of(vectors, id_col, vector_col)
    graph = neighbour_graph(values, **graph_options)
    queries = members.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    asked = queries.select("query").distinct().join(values.select(F.col("node").alias("query"), "packed"), "query")
    found = greedy_search(asked, graph, values, beam=max(beam, top + 1), entries=max(ENTRIES, top + 1))
    scored = found.select("query", F.explode("seen").alias("x")).select("query", F.col("x.node").alias("node"), (F.lit(0.0) - F.col("x.minus")).alias("score"))
    least = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    firsts = members.withColumn("n", least).where(F.col("n") <= top + 1).select("node", "vec_id")
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = staged(scored.join(firsts, "node").withColumn("n", near).where(F.col("n") <= top + 1).select("query", "vec_id", "score"), "ann-lists")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = queries.join(lists, "query").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
