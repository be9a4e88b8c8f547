"""Operator 6: nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors are given one more component
that makes all of them equally long, so that it is the smallest distance too.
Trees split at the median of the projection on the difference of two random
vectors. They are fitted on at most SAMPLE vectors, those whose digests are
smallest, down to leaves of LEAF of them; every vector is then put into its
leaf of each tree. A query walks all trees from one priority queue: the next
branch is the one whose worst margin on the way is smallest, whatever its
tree. It stops when the leaves visited hold SHARE of all leaf places (by the
sample), or FEWEST * k of them if that is more. All vectors of those leaves
are ranked by their exact inner products in double precision.

Leaf candidates are never listed: queries and vectors of one leaf meet in a
task, which keeps the best of each query over all its leaves and hands on
only those. Equal vectors are one entry with their smallest ids, as many as a
result can hold, so that a very common vector is no large leaf.

Vectors that are null, zero or hold a null or non-finite component take no
part, nor do those without an id or of another length than most have. Equal
scores are ordered by id. Every row is a query and a candidate of its own: a
query is not its own neighbour, but another row with its id or its vector, or
both, is one. With fewer candidates than k all are returned; an empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrears.session import pin

from .common import slots, table

SAMPLE, TREES, LEAF = 20_000, 16, 80
SHARE, FEWEST = 0.07, 100
K, EVERY = 20, 20
#: vectors of one leaf that one task takes; a larger leaf is dealt to several
PART = 8192


@dataclass
class Forest:
    """Trees side by side: node arrays, the root of each tree, and how many
    sample vectors each leaf holds. A child below 0 is leaf ``-child - 1``."""

    plane: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    held: np.ndarray
    radius: float


def lifted(vectors: np.ndarray, radius: float) -> np.ndarray:
    """With the component that makes all ``radius`` long."""
    return np.column_stack([vectors, np.sqrt(np.maximum(radius ** 2 - (vectors ** 2).sum(axis=1), 0))])


def grow(sample: np.ndarray, radius: float, trees: int = TREES, leaf: int = LEAF, seed: int = 6) -> Forest:
    rng = np.random.default_rng(seed)
    x = lifted(sample, radius)
    plane, cut, left, right, held, roots = [], [], [], [], [], []

    def branch(own: np.ndarray) -> int:
        for _ in range(8 if len(own) > leaf else 0):
            a, b = rng.choice(own, 2, replace=False)
            w = x[a] - x[b]
            length = np.linalg.norm(w)
            if length < 1e-12:
                continue
            p = x[own] @ (w / length)
            c = float(np.median(p))
            below = p < c
            if below.any() and not below.all():
                node = len(plane)
                plane.append(w / length)
                cut.append(c)
                left.append(0)
                right.append(0)
                left[node], right[node] = branch(own[below]), branch(own[~below])
                return node
        held.append(len(own))
        return -len(held)

    for _ in range(trees):
        roots.append(branch(np.arange(len(x))))
    width = x.shape[1]
    return Forest(np.array(plane).reshape(-1, width), np.array(cut), np.array(left, int), np.array(right, int), roots,
                  np.array(held), radius)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree."""
    x = lifted(vectors, forest.radius)
    out = np.empty((len(x), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        at, live = np.full(len(x), root), np.arange(len(x))
        while len(live):
            live = live[at[live] >= 0]
            node = at[live]
            margin = np.einsum("ij,ij->i", x[live], forest.plane[node]) - forest.cut[node] if len(live) else node
            at[live] = np.where(margin < 0, forest.left[node], forest.right[node])
        out[:, t] = -at - 1
    return out


def search_leaves(forest: Forest, vectors: np.ndarray, k: int) -> list[list[int]]:
    """The leaves each query visits, from one queue over all trees."""
    x = np.column_stack([vectors, np.zeros(len(vectors))])
    places = int(forest.held.sum())
    enough = min(places, max(SHARE * places, FEWEST * k))
    out = []
    for lo in range(0, len(x), 512):
        margins = x[lo:lo + 512] @ forest.plane.T - forest.cut if len(forest.cut) else np.zeros((len(x[lo:lo + 512]), 0))
        for margin in margins:
            queue = [(0.0, root) for root in forest.roots]
            heapq.heapify(queue)
            visited, size = [], 0
            while queue and size < enough:
                worst, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    near, far = (forest.left[node], forest.right[node]) if m < 0 else (forest.right[node], forest.left[node])
                    heapq.heappush(queue, (max(worst, abs(m)), int(far)))
                    node = int(near)
                visited.append(-node - 1)
                size += forest.held[-node - 1]
            out.append(visited)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


_MEET = ["leaf", "part", "is_vector", "key", "ids", "vector"]
_MEET_DDL = "leaf int, part int, is_vector boolean, key long, ids array<bigint>, vector binary"


def _meeting(batch: pa.RecordBatch, leaf, part, take, is_vector: bool, x: np.ndarray) -> pa.RecordBatch:
    raw = [v.tobytes() for v in x]
    take = pa.array(take)
    ids = batch.column("ids").take(take) if is_vector else pa.nulls(len(take), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), pa.array([is_vector] * len(take)),
         batch.column("key").take(take), ids, pa.array(raw, pa.binary()).take(take)], names=_MEET)


def _put(batches: Iterator[pa.RecordBatch], shared, parts: int) -> Iterator[pa.RecordBatch]:
    """Every vector at its leaf of each tree."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("embedding"))
            leaf = leaves_of(shared.value, x)
            own = np.repeat(np.arange(len(x)), leaf.shape[1])
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield _meeting(batch, leaf.ravel(), (key[own] % parts).astype(np.int32), own, True, x)


def _ask(batches: Iterator[pa.RecordBatch], shared, parts: int, k: int) -> Iterator[pa.RecordBatch]:
    """Every query at the leaves it visits, at all parts of them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            x = _matrix(some.column("embedding"))
            visits = search_leaves(shared.value, x, k)
            count = np.array([len(v) for v in visits])
            leaf = np.repeat(np.concatenate([np.array(v, np.int64) for v in visits]), parts)
            own = np.repeat(np.repeat(np.arange(len(x)), count), parts)
            yield _meeting(some, leaf, np.tile(np.arange(parts), int(count.sum())), own, False, x)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added component by
    component, so that they do not depend on what else is computed."""
    return np.cumsum(queries * vectors, axis=1)[:, -1]


class Best:
    """The best vectors of each query that a task has seen. Pairs gather up to
    ``most``; then each query keeps ``k`` and later pairs must reach the
    worst of those."""

    def __init__(self, k: int, most: int = 300_000):
        self.k, self.most = k, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.floor = np.zeros(0)
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.size, self.ids = 0, {}

    def slots_of(self, queries: list[int]) -> np.ndarray:
        out = np.array([self.slot.setdefault(q, len(self.slot)) for q in queries], np.int64)
        if len(self.slot) > len(self.floor):
            self.floor = np.concatenate([self.floor, np.full(len(self.slot), -np.inf)])
        return out

    def offer(self, slot: np.ndarray, queries: np.ndarray, keys: np.ndarray, ids: list, lowest: np.ndarray,
              vectors: np.ndarray) -> None:
        rough = queries @ vectors.T
        i, j = np.nonzero(rough >= self.floor[slot][:, None] - 1e-9)
        for lo in range(0, len(i), 65536):
            a, b = i[lo:lo + 65536], j[lo:lo + 65536]
            self.pairs.append((slot[a], keys[b], exact(queries[a], vectors[b]), lowest[b]))
        self.ids.update((int(keys[b]), ids[b]) for b in np.unique(j))
        self.size += len(i)
        if self.size > self.most:
            self.prune()

    def prune(self) -> None:
        if not self.pairs:
            return
        q, v, s, low = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        order = np.lexsort((v, low, -s, q))
        q, v, s, low = q[order], v[order], s[order], low[order]
        again = np.zeros(len(q), bool)  # a vector met in several trees
        again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
        q, v, s, low = q[~again], v[~again], s[~again], low[~again]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        self.floor[q[nth == self.k - 1]] = s[nth == self.k - 1]
        keep = nth < self.k
        self.pairs, self.size = [(q[keep], v[keep], s[keep], low[keep])], int(keep.sum())
        self.ids = {x: self.ids[x] for x in np.unique(v[keep]).tolist()}

    def rows(self) -> pa.RecordBatch:
        self.prune()
        q, v, s, _ = self.pairs[0] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None)
        name = np.array(list(self.slot), np.int64)
        ids = [self.ids[x] for x in v.tolist()]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(name[q] if len(q) else q), pa.array(v), pa.array(s),
                                           pa.array(ids, pa.list_(pa.int64()))], names=["q", "v", "score", "ids"])


def _rank(batches: Iterator[pa.RecordBatch], k: int, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leaf, part and queries first: the queries of one leaf
    against its vectors, batch by batch."""
    best, place, asked, queries = Best(k), None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column("leaf").to_numpy(), batch.column("part").to_numpy()], axis=1)
        is_vector = batch.column("is_vector").to_numpy(zero_copy_only=False).astype(bool)
        keys = batch.column("key").to_numpy()
        x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(len(keys), -1)
        ids = batch.column("ids").to_pylist()
        lowest = np.array([own[0] if own else 0 for own in ids], np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1) | (is_vector[1:] != is_vector[:-1])])
        for lo, hi in zip(new, [*new[1:], len(keys)], strict=True):
            if place != tuple(at[lo]):
                place, asked, queries = tuple(at[lo]), [], []
                if len(best.slot) > most:
                    yield best.rows()
            if not is_vector[lo]:
                asked += keys[lo:hi].tolist()
                queries.append(x[lo:hi])
            elif asked:
                matrix = np.concatenate(queries)
                slot = best.slots_of(asked)
                for a in range(0, len(asked), 1024):
                    for b in range(lo, hi, 1024):
                        c = min(hi, b + 1024)
                        best.offer(slot[a:a + 1024], matrix[a:a + 1024], keys[b:c], ids[b:c], lowest[b:c], x[b:c])
    yield best.rows()


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each
    vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    own = F.col(embedding).cast("array<double>")
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0))
    width = good.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], result)
    good = good.where(F.size("embedding") == width.w)
    # the smallest ids of each distinct vector, of a common one first by salt;
    # an id as often as rows have it
    rows = good.groupBy("embedding", "vec_id").agg(F.count(F.lit(1)).alias("times"))
    salted = W.partitionBy("embedding", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    ids = (rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
           .withColumn("n", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
           .withColumn("own", F.array_repeat("vec_id", F.least("times", F.lit(k + 1)).cast("int"))))
    distinct = pin(ids.groupBy("embedding").agg(F.slice(F.sort_array(F.flatten(F.collect_list("own"))), 1, k + 1).alias("ids"))
                   .withColumn("key", F.monotonically_increasing_id()), "neighbours")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("radius")).first()
    sample = distinct.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    forest = grow(_matrix(sample), size.radius)
    shared = spark.sparkContext.broadcast(forest)
    parts = max(1, int(size.n * len(forest.roots) / len(forest.held) / PART))

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = pin(asked.join(distinct.select("embedding", "key"), "embedding"), "neighbours")
    queries = asked.select("key", "embedding").dropDuplicates(["key"])
    at_leaf = (distinct.mapInArrow(partial(_put, shared=shared, parts=parts), _MEET_DDL)
               .unionAll(queries.mapInArrow(partial(_ask, shared=shared, parts=parts, k=k), _MEET_DDL)))
    ranked = (at_leaf.repartition(slots(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "is_vector")
              .mapInArrow(partial(_rank, k=k + 1), "q long, v long, score double, ids array<bigint>"))
    order = (F.desc("score"), "vec_id")
    found = (ranked.dropDuplicates(["q", "v"]).select("q", "v", "score", F.explode("ids").alias("vec_id"))
             .withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1))
    # a query is one row: of the rows with its id and vector one is left out
    each = (asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("q"), "times").join(found, "q")
            .withColumn("same", (F.col("v") == F.col("q")) & (F.col("vec_id") == F.col("query_id")))
            .withColumn("nth", F.row_number().over(W.partitionBy("query_id", "q", "same").orderBy("n")))
            .where(~(F.col("same") & (F.col("nth") == 1)))
            .withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q").orderBy("n"))).where(F.col("rank") <= k))
    return (each.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select("query_id", "rank", "vec_id", "score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
