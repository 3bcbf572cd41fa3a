"""Exact top-k search by inner product: tiled matrix products, a selection in each tile, and merged top lists.

Queries come in blocks of a bounded size, each broadcast in turn; the candidates stay in their partitions (shards). A
task multiplies its batches with the block, keeps each query's best k of the tile, merges them into the list it holds,
and returns one list for each query. Lists of a few tasks merge first, then those of all branches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import materialise
from lociflow.llm.embedding_dedup import usable

#: Bytes of a block of queries that is collected and broadcast.
BLOCK_BYTES = 32 << 20
#: Candidates and queries of a tile.
TILE = 1024
#: Task lists that merge in the first step of the tree.
FAN_IN = 16


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row of scores with their ids, ties to smaller ids; ids: like scores."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        most = int((scores >= edge).sum(axis=1).max())
        if most < scores.shape[1]:  # all that tie with the last place stay until ids decide
            top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: as doubles where those are exact, else as Python integers within a long."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, -(2**63) + 2, 2**63 - 2).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows; all, if fewer.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by query_every. Vectors that
    are null or hold null or non-finite components, and rows without id, take no part; vectors of different lengths
    don't meet. Rows that repeat an id are one candidate for each row, never for a query of that id; a query id that
    repeats is answered once. Scores beyond a long are held at its ends. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ints = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    big = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    ready = vectors.withColumn("__v", F.col(vector_col).cast("array<double>")).where(usable("__v") & F.col(id_col).isNotNull())
    # floor() gives a long in Spark; from 2**53 on a double is whole already.
    exact = F.zip_with(ints, big, lambda i, x: F.when(F.abs(x) < F.lit(float(2**53)), i).otherwise(x))
    rows = materialise(ready.select(F.col(id_col).cast("long").alias("id"), exact.alias("v")))
    queries = rows.where(F.col("id") % query_every == 0)
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-(shape.n * ((shape.d or 0) + 1) * 8) // block_bytes))
    answers = []
    for block in range(blocks):  # one, until queries take more than block_bytes; each further one is a further pass
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).dropDuplicates(["id"]).collect()
        by_size = {}
        for d in {len(r.v) for r in mine}:
            own = sorted((r.id, r.v) for r in mine if len(r.v) == d)
            by_size[d] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64))
        known = spark.sparkContext.broadcast(by_size)

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            none = np.iinfo(np.int64).max
            lowest = -none  # its negative is a long too
            held = {d: (np.full((len(q), k), lowest), np.full((len(q), k), none)) for d, (q, _) in known.value.items()}
            for batch in batches:
                ids, column = batch.column(0).to_numpy(), batch.column(1)
                offsets = np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
                values, width = column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
                for d in set(np.unique(width).tolist()) & held.keys():
                    at = np.flatnonzero(width == d)
                    q_ids, q_rows = known.value[d]
                    for i in range(0, len(at), TILE):
                        shard = at[i : i + TILE]
                        tile = values[offsets[shard][:, None] + np.arange(d)]
                        for j in range(0, len(q_ids), TILE):
                            scores = products(q_rows[j : j + TILE], tile)
                            c_ids = np.broadcast_to(ids[shard], scores.shape)
                            own = q_ids[j : j + TILE, None] == ids[shard][None, :]
                            scores, c_ids = np.where(own, lowest, scores), np.where(own, none, c_ids)
                            old = held[d]
                            s, c = best(scores, c_ids, k)
                            s, c = best(np.concatenate([old[0][j : j + TILE], s], axis=1), np.concatenate([old[1][j : j + TILE], c], axis=1), k)
                            old[0][j : j + TILE], old[1][j : j + TILE] = s, c
            branch = TaskContext.get().partitionId() // FAN_IN
            for d, (s, c) in held.items():
                x, y = np.nonzero(c != none)
                yield pa.RecordBatch.from_arrays([pa.array(known.value[d][0][x]), pa.array(c[x, y]), pa.array(s[x, y]), pa.array(np.full(len(x), branch))], ["query_id", "vec_id", "score", "branch"])

        lists = rows.mapInArrow(search, "query_id long, vec_id long, score long, branch long")
        merge = lambda df, *by: df.groupBy(*by).agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))).alias("all")).select(*by, F.slice(F.array_sort("all"), 1, k).alias("all"))
        some = merge(lists, "query_id", "branch").select("query_id", F.explode("all").alias("x")).select("query_id", "x.vec_id", (-F.col("x.minus")).alias("score"))
        answers.append(merge(some, "query_id").select("query_id", F.posexplode("all").alias("at", "x")))
    out = reduce(DataFrame.unionByName, answers)
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
