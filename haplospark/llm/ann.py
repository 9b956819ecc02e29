"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search over it.

Equal vectors form one node, so a vector held by a third of all rows is one node with many members.  The graph
starts from blocks of nodes that sort together under random hyperplanes, and improves by rounds of Spark joins:
each node brings together its neighbours and the nodes it is a neighbour of, and these get to know each
other.  A search keeps a beam of the best nodes and, round by round, joins the best not yet expanded ones
with the graph.  Found nodes are scored exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.llm.common import free_shuffles, small_batches, staged, unstage

K = 40  # neighbours of a node
REVERSE = 40  # nodes it is a neighbour of that join in, best first
NEW = 12  # acquaintances that each node takes from one gathering
BLOCK = 256  # nodes compared with each other at the start
TREES = 12  # orders of the nodes
PLANES = 24  # hyperplanes of an order
BEAM, EXPAND, STEPS = 160, 32, 10
LANDMARKS = 256  # entry points, a fixed number


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: not null or zero, all components there and finite, no null id.

    Vectors of another length than most take no part either.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (dims[0]["n"] if dims else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _order_rows(dim: int):
    """For each order a key that keeps near vectors together: signs at random hyperplanes, most telling first."""
    planes = np.random.default_rng(13).normal(size=(TREES, PLANES, dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("vec"))
            half = pa.array([v.tobytes() for v in unit.astype(np.float16)], pa.binary())
            for t in range(TREES):
                side = (unit @ planes[t].T) > 0
                key = side @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(key), batch.column("node"), half], ["tree", "key", "node", "half"])

    return run


def _halves(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float16) for x in column.to_pylist()]).astype(np.float32)


def _best_pairs(node: np.ndarray, unit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its `most` nearest among the others here: (node, other, score)."""
    sim = unit @ unit.T
    sim[node[:, None] == node[None, :]] = -2
    most = min(most, len(node) - 1)
    if most < 1:
        return node[:0], node[:0], sim[:0, 0]
    best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
    rows = np.repeat(np.arange(len(node)), most)
    score = sim[rows, best.ravel()]
    keep = score > -2
    return node[rows][keep], node[best.ravel()][keep], score[keep]


def _pairs_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["node", "other", "score"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each run of BLOCK nodes of sorted rows."""
    for batch in batches:
        node, tree, unit = batch.column("node").to_numpy(), batch.column("tree").to_numpy(), _halves(batch.column("half"))
        cut = np.unique(np.concatenate([np.arange(0, len(node), BLOCK), np.flatnonzero(np.diff(tree)) + 1, [len(node)]]))
        parts = [_best_pairs(node[a:b], unit[a:b], K // 2) for a, b in zip(cut, cut[1:])]
        if parts:
            yield _pairs_batch(parts)


def _gathering_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At each node its acquaintances meet each other."""
    for batch in batches:
        parts = []
        for met in batch.column("met").to_pylist():
            node = np.array([m["node"] for m in met], np.int64)
            unit = np.stack([np.frombuffer(m["half"], np.float16) for m in met]).astype(np.float32)
            floor = np.array([m["floor"] for m in met], np.float32)
            a, b, score = _best_pairs(node, unit, NEW)
            better = score > floor[np.searchsorted(node, a)]  # than the worst it has; nodes ascend
            parts.append((a[better], b[better], score[better]))
        if parts:
            yield _pairs_batch(parts)


PAIR = "node long, other long, score float"


def _best(pairs: DataFrame, most: int = K) -> DataFrame:
    """(node, near): the best distinct others of each node as array of (score, other), best first."""
    once = pairs.groupBy("node", "other").agg(F.max("score").alias("score"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("score", "other")), asc=False), 1, most)
    return once.groupBy("node").agg(near.alias("near"))


def build_graph(nodes: DataFrame, dim: int, rounds: int = 7) -> DataFrame:
    """NN-descent over (node, vec): (node, near)."""
    ordered = staged(nodes.mapInArrow(_order_rows(dim), "tree int, key long, node long, half binary"), "orders")
    parts = ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")
    blocks = ordered.repartitionByRange(int(parts), "tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInArrow(_block_rows, PAIR)
    graph = staged(_best(blocks), "graph")
    halves = staged(ordered.where("tree = 0").select("node", "half"), "halves")
    unstage(ordered)
    for _ in range(rounds):
        links = graph.select("node", F.explode("near").alias("n")).select("node", F.col("n.other").alias("other"), F.col("n.score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "node"))
        back = links.withColumn("r", rank).where(F.col("r") <= REVERSE).select(F.col("other").alias("centre"), "node")
        met = links.select(F.col("node").alias("centre"), F.col("other").alias("node")).unionByName(back).distinct()
        floor = graph.select("node", F.when(F.size("near") >= K, F.element_at("near", -1)["score"]).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        known = halves.join(floor.hint("shuffle_merge"), "node")
        with_vec = met.join(known.hint("shuffle_merge"), "node")
        grouped = with_vec.groupBy("centre").agg(F.sort_array(F.collect_list(F.struct("node", "half", "floor"))).alias("met"))  # at most K + REVERSE
        fresh = grouped.select("met").mapInArrow(_gathering_rows, PAIR)
        better = staged(_best(links.select("node", "other", "score").unionByName(fresh)), "graph")
        unstage(graph)
        graph = better
        free_shuffles(nodes.sparkSession)
    unstage(halves)
    return graph


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class VectorIndex:
    """A graph over the distinct vectors of (id, vec) rows, and the rows each stands for."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, rounds: int = 7):
        small_batches(vectors.sparkSession)
        self.rows = staged(usable(vectors, id_col, vec_col), "vectors")
        classes = staged(self.rows.groupBy("vec").agg(F.min("id").alias("node")), "nodes")
        first = classes.select(F.size("vec").alias("n")).first()
        self.dim = first["n"] if first else 1
        self.nodes = staged(classes.select("node", "vec"), "vec")
        self.members = staged(self.rows.join(classes.hint("shuffle_merge"), "vec").select("id", "node"), "members")
        unstage(classes)
        self.graph = build_graph(self.nodes, self.dim, rounds)
        # entry points: the nodes of least hash, a fixed number of them
        self.landmarks = self.nodes.orderBy(F.xxhash64("node"), "node").limit(LANDMARKS)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest rows found for (query_id, vec, node), nearest first.

        node is the query's own node where it is a row of the index (it is then no candidate), else null.
        Ties go to the smaller id.
        """
        q = staged(queries.select("query_id", "vec", "node"), "queries")
        fixed = self.landmarks.collect()
        ids = [r["node"] for r in fixed]
        marks = np.array([r["vec"] for r in fixed], np.float64).reshape(-1, self.dim)
        marks /= np.linalg.norm(marks, axis=1, keepdims=True)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sim = _matrix(batch.column("vec")) @ marks.T.astype(np.float32)
                best = np.argsort(-sim, axis=1)[:, : EXPAND // 2]
                query = batch.column("query_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([query[i] for i in range(len(query)) for _ in best[i]], pa.int64()), pa.array([ids[j] for row in best for j in row], pa.int64())], ["query_id", "node"])

        entries = q.select("query_id", "vec").mapInArrow(start, "query_id long, node long").unionByName(q.where("node is not null").select("query_id", "node")).distinct()
        beam = staged(self._scored(entries, q).withColumn("open", F.lit(True)), "beam")
        for _ in range(STEPS):
            order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("open"), F.desc("score"), "node"))
            ranked = beam.withColumn("turn", order)
            ahead = ranked.where(F.col("open") & (F.col("turn") <= EXPAND)).select("query_id", "node")
            near = ahead.join(self.graph.hint("shuffle_merge"), "node").select("query_id", F.explode("near.other").alias("node")).distinct()
            new = near.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti")
            done = ranked.withColumn("open", F.col("open") & (F.col("turn") > EXPAND)).drop("turn")
            all_ = done.unionByName(self._scored(new, q).withColumn("open", F.lit(True)))
            best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
            step = staged(all_.withColumn("r", best).where(F.col("r") <= BEAM).drop("r"), "beam")
            unstage(beam)
            beam = step
        # of each found node the k + 1 least ids can be among the k nearest
        few = self.members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", "id")
        exact = self._scored(beam.select("query_id", "node"), q)
        found = exact.join(few.hint("shuffle_merge"), "node").where("id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    def _scored(self, pairs: DataFrame, q: DataFrame) -> DataFrame:
        """(query_id, node, score): exact cosine in double precision on the vectors as given."""
        both = pairs.join(self.nodes.hint("shuffle_merge"), "node").join(q.select("query_id", F.col("vec").alias("own")).hint("shuffle_merge"), "query_id")
        cosine = _dot(F.col("vec"), F.col("own")) / (F.sqrt(_dot(F.col("vec"), F.col("vec"))) * F.sqrt(_dot(F.col("own"), F.col("own"))))
        return both.select("query_id", "node", cosine.alias("score"))


def nearest_rows(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of each row whose id is divisible by `every`, among all other rows.

    Vectors that are null, zero, of another length, or hold null or non-finite components take no part, nor
    do rows without id; each of several rows of one id is a candidate, but none is one of a query of that id, and
    they make one query; fewer candidates than k give fewer rows; an empty table gives none.
    """
    index = VectorIndex(vectors, id_col, vec_col)
    own = index.rows.where(F.col("id") % every == 0).join(index.members.hint("shuffle_merge"), "id").select(F.col("id").alias("query_id"), "vec", "node")
    return index.search(own.dropDuplicates(["query_id"]), k)
