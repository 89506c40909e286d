"""The most similar vectors of many queries, exactly, without comparing every query with every vector.

Vectors are packed into blocks in the order of their lengths, the longest first. No product with a
query exceeds the product of the lengths, so a query is done as soon as the next block's longest vector can't
reach its k-th best score. Blocks are taken in rounds of doubling size by the queries that aren't done.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept_table

BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Scores count to so many digits, so that sums in another order rank alike; bounds are loosened by as much.
DIGITS = 6


@dataclass
class Found:
    """rows: query_id, rank, vec_id, score; pairs: of queries and vectors whose product was computed."""

    rows: DataFrame
    pairs: int


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, length), as they lie in their partitions, as blocks: part, k (their order there), ids, data, dimension, longest."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal ids, vectors, lengths, held
            i, v, s = np.concatenate(ids), np.concatenate(vectors), np.concatenate(lengths)
            ids, vectors, lengths, held = [i[n:]], [v[n:]], [s[n:]], len(i) - min(n, len(i))
            columns = [pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array([i[:n].tolist()], pa.list_(pa.int64())), pa.array([v[:n].tobytes()], pa.binary()), pa.array([v.shape[1]], pa.int32()), pa.array([float(s[:n].max())], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "k", "ids", "data", "dimension", "longest"])

        for batch in batches:
            if not len(batch):
                continue
            ids.append(batch.column(0).to_numpy())
            vectors.append(batch.column(1).flatten().to_numpy().reshape(len(batch), -1))
            lengths.append(batch.column(2).to_numpy())
            held += len(batch)
            while held >= size:
                yield block(size)
                k += 1
        if held:
            yield block(size)

    return rows.select("id", "v", "length").mapInArrow(pack, "part int, k long, ids array<long>, data binary, dimension int, longest double")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with their number in the whole order; parts are few, so their sizes are summed in one place."""
    sizes = blocks.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return blocks.join(F.broadcast(first), "part").withColumn("block", F.col("first") + F.col("k")).drop("part", "k", "first")


def _compare(pairs: DataFrame, k: int) -> DataFrame:
    """pairs of a query block and a vector block: each query's k best there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, ids, data, dimension in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, v = (np.frombuffer(x, np.float64).reshape(-1, dimension) for x in (q_data, data))
                scores, ids = np.round(q @ v.T, DIGITS) + 0.0, np.array(ids)
                for row, query in enumerate(q_ids):
                    s = scores[row]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        some = np.flatnonzero(s >= least)  # with all ties
                    else:
                        some = np.arange(len(s))
                    top = some[np.lexsort((ids[some], -s[some]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), query)), pa.array(ids[top]), pa.array(s[top])], names=["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_data", "ids", "data", "dimension").mapInArrow(run, "query_id long, vec_id long, score double")


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> Found:
    """For each of ``queries`` (distinct ids) its k ``vectors`` with the largest inner product, ties to the smaller id.

    Scores are rounded to ``DIGITS`` digits. Rows whose id or vector is null, empty, or holds null or non-finite components take no
    part; vectors of another dimension than the first query's raise; a query that is among the vectors is found, too.
    """
    spark = vectors.sparkSession

    def sound(rows: DataFrame) -> DataFrame:
        v = F.transform(vector, lambda x: x.cast("double"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
        return whole.where((F.size("v") > 0) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (x * 0 == 0)), F.lit(False))).withColumn("length", length)

    asked = kept_table(sound(queries), "queries")
    first = asked.select(F.size("v").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return Found(spark.createDataFrame([], schema), 0)
    same = F.when(F.size("v") == first["n"], F.col("v")).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("array<double>"))
    asked = asked.withColumn("v", same)
    # a range of lengths is a few tasks; blocks follow each other from the longest vector to the shortest
    ordered = sound(vectors).withColumn("v", same).repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length"))
    blocks = kept_table(_numbered(kept_table(_packed(ordered, block_rows), "blocks")), "numbered")
    n_blocks = blocks.count()

    best, compared, at, size = None, 0, 0, 1
    active = asked
    while at < n_blocks:
        if best is not None:
            reach = blocks.where(F.col("block") == at).select("longest").first()["longest"]
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            active = asked.join(kth, "id", "left").where(F.col("kth").isNull() | (F.col("length") * reach * (1 + 1e-9) + 10.0**-DIGITS >= F.col("kth"))).drop("kth")
        packed = kept_table(_packed(active.repartition(F.xxhash64("id")), QUERY_ROWS).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "asked")
        if packed.isEmpty():
            break
        last = min(at + size, n_blocks) - 1
        pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(at), F.lit(last)).cast("array<long>"))).join(blocks.where(F.col("block").between(at, last)), "block")
        found = kept_table(_compare(pairs, k), "found")
        compared += packed.agg(F.sum(F.size("q_ids"))).first()[0] * blocks.where(F.col("block").between(at, last)).agg(F.sum(F.size("ids"))).first()[0]
        rows = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = kept_table(rows.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        at, size = last + 1, size * 2
    if best is None:
        return Found(spark.createDataFrame([], schema), 0)
    return Found(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), compared)
