"""Exact top-k by inner product with M-trees, searched best first.

Vectors become points of a metric space: one more coordinate gives all the same length, so larger
inner products are smaller distances. The corpus is split by bounded pivots into shards, of about
the same size; each is an M-tree of pages whose entries keep covering radii and distances to their
parent. A query searches its own shard first, and then, with the score it must beat, only the
shards whose ball can hold better ones. Inside a tree blocks of queries go to the nearest pages first, and
stored distances rule out entries before any distance to them is computed. The tree only prunes:
scores are exact integers, and bounds are loosened by more than rounding can amount to. Vectors
without any structure (independent components, many dimensions) leave a metric tree nothing to rule
out: then all pages are read, in matrix products of blocks.

Sizes: ``PIVOTS`` pivots from ``PIVOT_SAMPLE`` vectors; one shard's vectors (at most
``SHARD_ROWS``, or a share of the table) and a batch of queries are in a task at a time.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as padded with zeros; rows with the query's own
id aren't its candidates; a repeated query is one (of several vectors the least), a repeated
candidate is several; components and scores beyond 64 bits count as the largest or least number of
64 bits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

PIVOTS, PIVOT_SAMPLE = 32, 2048
SHARD_ROWS = 200_000
PAGE, FANOUT = 128, 16
#: Queries that go down a tree together.
QUERY_BLOCK = 256
K = 20
LEAST, MOST = -(2**63), 2**63 - 1


# -- the tree


@dataclass
class Node:
    """A page: entries are points (a leaf) or the routing points of child pages."""

    points: np.ndarray  # with the added coordinate
    to_parent: np.ndarray  # entries' distances to the page's own routing point
    ids: np.ndarray | None = None
    radii: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=-1), 0))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n distinct points, each the farthest from those before it."""
    chosen, gap = [0], _distances(points, points[0])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(points, points[chosen[-1]]))
    return np.array(chosen)


def _square_distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] + (to**2).sum(axis=1)[None, :] - 2 * points @ to.T


class MTree:
    """Bulk-loaded: pages of at most PAGE points, FANOUT pages below a routing page."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        """vectors: integers; longest: the largest squared length of all vectors of the table.

        No sum of products, nor any part of it, exceeds ``longest``: below 2**52 floats are exact.
        """
        self.longest = longest
        self.exact = longest < 2**52
        points = augmented(vectors, longest)
        order = np.argsort(ids, kind="stable")
        self.root_point = points[order[0]]
        self.visited = 0  # pairs of a query and a point or routing point whose distance was asked for
        self.root = self._build(points[order], ids[order], self.root_point)

    def _build(self, points: np.ndarray, ids: np.ndarray, parent: np.ndarray) -> Node:
        to_parent = _distances(points, parent)
        if len(points) <= PAGE:
            return Node(points, to_parent, ids=ids)
        step = max(1, len(points) // 1024)
        routes = points[::step][farthest_first(points[::step], FANOUT)]
        near = _square_distances(points, routes).argmin(axis=1)
        groups = [g for k in range(len(routes)) if len(g := np.flatnonzero(near == k))]
        if len(groups) == 1:  # equal points: pages by order
            groups = np.array_split(groups[0], -(-len(points) // PAGE))
        routes = np.stack([points[g[0]] for g in groups])
        radii = np.array([_distances(points[g], r).max() for g, r in zip(groups, routes, strict=True)])
        return Node(routes, _distances(routes, parent), radii=radii, children=[self._build(points[g], ids[g], r) for g, r in zip(groups, routes, strict=True)])

    def search(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, beat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, id, score) of each query's k best that score at least its ``beat``, best first, ties to smaller ids.

        A block of queries goes down the tree together. Pages wait in the order of the least bound of
        any query; a page is read for those queries alone whose bound is within their reach, and of its
        entries only those are computed that the stored distances to the parent leave possible.
        """
        q = np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])
        square = (q**2).sum(axis=1) + self.longest
        slack = 1e-9 * square + 1e-6
        worst = beat.astype(np.float64) if self.exact else np.nextafter(beat.astype(np.float64), -np.inf)
        with np.errstate(invalid="ignore"):
            reach = np.where(np.isfinite(worst) & (worst > LEAST), np.sqrt(np.maximum(square - 2 * worst + slack, 0)) + slack**0.5, np.inf)
        best_ids = [np.zeros(0, np.int64) for _ in q]
        best = [np.zeros(0) for _ in q]
        everyone = np.arange(len(q))
        heap = [(0.0, 0, everyone, np.zeros(len(q)), _distances(q, self.root_point), self.root)]
        count = 0
        while heap:
            _, _, who, bound, to_route, node = heapq.heappop(heap)
            live = bound <= reach[who]
            who, to_route = who[live], to_route[live]
            if not len(who):
                continue
            radii = node.radii if node.radii is not None else 0.0
            # by the triangle inequality alone: entries too far to matter
            near = np.abs(to_route[:, None] - node.to_parent) - radii <= reach[who][:, None]
            some = np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            near = near[:, some]
            self.visited += int(near.sum())
            points = node.points[some]
            if node.ids is None:
                d = np.sqrt(np.maximum(square[who][:, None] - 2 * (q[who] @ points.T), 0))
                low = np.maximum(d - node.radii[some] - slack[who][:, None] ** 0.5, 0)
                asked = near & (low <= reach[who][:, None])
                for e in np.flatnonzero(asked.any(axis=0)).tolist():
                    of = asked[:, e]
                    count += 1
                    heapq.heappush(heap, (float(low[of, e].min()), count, who[of], low[of, e], d[of, e], node.children[int(some[e])]))
                continue
            ids = node.ids[some]
            if self.exact:
                score = np.rint(q[who] @ points.T)
            else:
                score = np.array([[min(max(sum(int(x) * int(y) for x, y in zip(p[:-1], vectors[w], strict=True)), LEAST), MOST) for p in points] for w in who], object)
            hit = near & (score >= worst[who][:, None]) & (ids != query_ids[who][:, None])
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                w, h = who[r], hit[r]
                one_ids, one = np.concatenate([best_ids[w], ids[h]]), np.concatenate([best[w], score[r][h]])
                top = np.lexsort((one_ids, -one))[:k]
                best_ids[w], best[w] = one_ids[top], one[top]
                if len(top) == k and best[w][-1] >= worst[w] and best[w][-1] > LEAST:
                    worst[w] = best[w][-1] if self.exact else np.nextafter(float(best[w][-1]), -np.inf)
                    reach[w] = np.sqrt(max(0.0, square[w] - 2 * float(worst[w]) + slack[w])) + slack[w] ** 0.5
        found = np.array([len(x) for x in best_ids])
        return np.repeat(query_ids, found), np.concatenate([np.zeros(0, np.int64), *best_ids]), np.concatenate([np.zeros(0), *best])


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(longest - (v**2).sum(axis=1, keepdims=True), 0))])


# -- shards


@dataclass
class Shards:
    """Pivots, and for each shard its pivot and radius; a few hundred numbers for each shard."""

    dimension: int
    longest: float
    pivots: np.ndarray
    pivot_of: np.ndarray
    radius: np.ndarray

    def best_possible(self, vectors: np.ndarray) -> np.ndarray:
        """The largest score that any vector of each shard can have with each query."""
        square = (vectors.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.longest
        d = np.sqrt(np.maximum(square - 2 * vectors.astype(np.float64) @ self.pivots[:, :-1].T, 0))[:, self.pivot_of]
        gap = np.maximum(d - self.radius[None, :], 0)
        return (square - gap**2) / 2 + 1e-6 * square + 1


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dimension).all():
        return flat.reshape(-1, dimension)
    out = np.zeros((len(sizes), dimension), np.int64)
    out[np.arange(dimension)[None, :] < sizes[:, None]] = flat
    return out


_FOUND = "query_id long, vec_id long, score long"


def _search(rows: DataFrame, shards: Shards, k: int) -> DataFrame:
    """rows: shard, kind (0 a vector, 1 a query), id, v, beat. Each shard's vectors, then its queries."""

    def serve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            shard_column, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shard_column) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if shard_column[start] != shard:
                    shard, ids, vectors, tree = shard_column[start], [], [], None
                if kind[start] == 0:
                    ids.append(part.column(2).to_numpy())
                    vectors.append(_matrix(part.column(3), shards.dimension))
                    continue
                if not ids:
                    continue
                tree = tree or MTree(np.concatenate(ids), np.concatenate(vectors), shards.longest)
                for at in range(0, len(part), QUERY_BLOCK):
                    block = part.slice(at, QUERY_BLOCK)
                    beat = np.array([-np.inf if b is None else b for b in block.column(4).to_pylist()], np.float64)
                    found = tree.search(block.column(2).to_numpy(), _matrix(block.column(3), shards.dimension), k, beat)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in found], names=[f.split()[0] for f in _FOUND.split(", ")])

    return rows.repartition(len(shards.pivot_of), "shard").sortWithinPartitions("shard", "kind").mapInArrow(serve, _FOUND)


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the floors of ``scale`` times each component, of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & (c * 0 == 0))
    rows = embeddings.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where((F.size("x") > 0) & F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def top_inner_products(vectors: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, v) that fits ``is_query`` its k best."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    scratch = Scratch(vectors.sparkSession)
    vectors = scratch.table(vectors.withColumn("square", square), "vectors")
    facts = vectors.agg(F.max("square").alias("longest"), F.max(F.size("v")).alias("dimension"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dimension, longest = facts["dimension"], facts["longest"]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    points = np.zeros((len(sample), dimension), np.int64)
    for row, one in zip(points, sample, strict=True):
        row[: len(one["v"])] = one["v"]
    points = augmented(points, longest)
    pivots = points[farthest_first(points, PIVOTS)]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = augmented(_matrix(batch.column(1), dimension), longest)
            near = _square_distances(p, pivots).argmin(axis=1) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()), pa.array(_distances(p, pivots[near]), pa.float64())], names=["vec_id", "v", "pivot", "distance"])

    placed = scratch.table(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, pivot long, distance double"), "placed")
    counts = {r["pivot"]: (r["n"], r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    # a pivot that is near to many vectors gets several shards
    most = min(SHARD_ROWS, -(-facts["n"] // len(pivots)))
    parts = {p: -(-n // most) for p, (n, _) in sorted(counts.items())}
    first = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist(), strict=True))
    shards = Shards(dimension, longest, pivots, np.repeat(list(parts), list(parts.values())), np.repeat([counts[p][1] for p in parts], list(parts.values())))
    lookup = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("pivot"))
    placed = placed.withColumn("shard", lookup(first) + F.pmod(F.xxhash64("vec_id"), lookup(parts)))

    none = F.lit(None).cast("long")
    corpus = placed.select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", none.alias("beat"))
    # of several vectors with one id the least asks
    queries = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "pivot", "shard")).alias("least")).select("vec_id", "least.v", "least.shard")
    queries = scratch.table(queries, "queries")
    home = scratch.table(_search(corpus.unionByName(queries.select("shard", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", none.alias("beat"))), shards, k), "home")
    beat = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("beat"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                bound = shards.best_possible(_matrix(part.column(1), dimension))
                least = np.array([-np.inf if b is None else b for b in part.column(3).to_pylist()])
                wanted = bound >= least[:, None]
                wanted[np.arange(len(part)), part.column(2).to_numpy()] = False
                row, shard = np.nonzero(wanted)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column(0).take(take), part.column(1).take(take), part.column(3).take(take)], names=["shard", "id", "v", "beat"])

    asked = queries.select(F.col("vec_id").alias("query_id"), "v", "shard").join(beat, "query_id", "left").select("query_id", "v", "shard", "beat")
    routed = asked.mapInArrow(route, "shard long, id long, v array<long>, beat long").select("shard", F.lit(1).alias("kind"), "id", "v", "beat")
    found = home.unionByName(_search(corpus.unionByName(routed), shards, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scratch.only(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
