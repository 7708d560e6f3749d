"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Rows are dealt into blocks. A block's index holds, for each dimension, its postings
sorted by component and cut into LEVELS segments. For a query, a segment's impact is the most that
its postings can add above the least that the dimension adds to any row; segments of all dimensions are
processed in falling order of (quantised) impact, each adding its exact products. What is unprocessed bounds
every score from above, so the search may stop once the bound proves that only a few rows
can still be among the k best; those are rescored exactly. Otherwise it goes on to the end.

Queries are rows too and grow with them, so they are cut into blocks, each of which meets
each block of rows once; a pair of blocks is one group of bounded size. A block gives at
most k rows per query, and Spark keeps the best k of those.

Components become floor(scale * x). Vectors that are null, empty, or hold null or non-finite
components, and rows with null ids, take no part. Vectors of unequal length are compared in the dimensions both
have. Ties go to the smaller id; of rows with the same id all are candidates. A query doesn't
find rows with its own id; a repeated query row is answered once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offertide.llm.common import written

ROWS_PER_BLOCK = 1 << 14
QUERIES_PER_BLOCK = 512
LEVELS = 8
CHECK_EVERY = 64
FEW = 128
"""Possible members at which the search stops and rescores them."""


class BlockIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = vectors.shape
        self.rows, self.values, self.bounds = [], [], []
        edges = np.unique(np.linspace(0, n, LEVELS + 1).astype(int))
        for j in range(dims):
            rank = np.argsort(self.vectors[:, j], kind="stable").astype(np.int32)
            value = self.vectors[rank, j]
            self.rows.append([rank[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            self.values.append([value[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            self.bounds.append([(value[a], value[b - 1]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        bounds = np.array(self.bounds, np.int64)  # dimension x level x (least, most)
        self.least, self.most = bounds[:, :, 0], bounds[:, :, 1]

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, by falling score and rising id."""
        q = query[:, None]
        high = np.maximum(q * self.least, q * self.most)
        floor = np.minimum(q * self.least, q * self.most).min(axis=1)  # least that a dimension adds
        impact = high - floor[:, None]
        scores = np.full(len(self.ids), floor.sum(), np.int64)
        dims, levels = np.unravel_index(np.argsort(-impact, axis=None, kind="stable"), impact.shape)
        ahead = np.sort(impact, axis=1)[:, ::-1]  # impacts of a dimension as they come
        done = np.zeros(len(query), np.int64)
        mine = self.ids == own
        candidates = None
        for step, (j, level) in enumerate(zip(dims, levels, strict=True)):
            if query[j]:
                scores[self.rows[j][level]] += query[j] * self.values[j][level] - floor[j]
            done[j] += 1
            if (step + 1) % CHECK_EVERY == 0 and step + 1 < len(dims):
                left = np.where(done < ahead.shape[1], np.take_along_axis(
                    ahead, np.minimum(done, ahead.shape[1] - 1)[:, None], axis=1)[:, 0], 0).sum()
                # So far a score is a lower bound, and `left` more an upper one.
                now = np.where(mine, np.iinfo(np.int64).min // 2, scores)
                if len(now) > k:
                    kth = np.partition(now, len(now) - k)[len(now) - k]
                    possible = np.flatnonzero(now + left >= kth)
                    if len(possible) <= FEW:
                        candidates = possible
                        break
        if candidates is None:
            kth = np.partition(scores, max(0, len(scores) - k - int(mine.sum())))[max(0, len(scores) - k - int(mine.sum()))]
            candidates = np.flatnonzero(scores >= kth)
        candidates = candidates[~mine[candidates]]
        exact = self.vectors[candidates] @ query
        best = np.lexsort((self.ids[candidates], -exact))[:k]
        return self.ids[candidates[best]], exact[best]


def quantised(column: str, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & (F.size(x) > 0) & sound,
                  F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row that `is_query` selects."""
    spark = df.sparkSession
    rows = written(
        df.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("q"))
        .where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, groups = max(1, -(-n // ROWS_PER_BLOCK)), max(1, -(-m // QUERIES_PER_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.select("id", "v", F.lit(False).alias("q"),
                       F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), every(groups).alias("g"))
    asked = rows.where("q").dropDuplicates(["id", "v"]).select(
        "id", "v", F.lit(True).alias("q"), every(blocks).alias("b"),
        F.pmod(F.xxhash64("id", "v", F.lit("q")), F.lit(groups)).cast("int").alias("g"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        out = {"query_id": [], "vec_id": [], "score": []}
        if table.num_rows:
            ids, asks = table.column("id").to_numpy(), table.column("q").to_numpy(zero_copy_only=False)
            lists = table.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            vectors = np.zeros((len(ids), int(sizes.max())), np.int64)
            vectors[np.arange(vectors.shape[1])[None, :] < sizes[:, None]] = flat
            if asks.any() and not asks.all():
                index = BlockIndex(ids[~asks], vectors[~asks])
                for own, query in zip(ids[asks], vectors[asks], strict=True):
                    found, scores = index.search(query, k, own)
                    out["query_id"].append(np.full(len(found), own))
                    out["vec_id"].append(found)
                    out["score"].append(scores)
        yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for c, v in out.items()})

    met = data.unionByName(asked).groupBy("b", "g").applyInArrow(
        lambda table: pa.Table.from_batches(list(search(iter(table.to_batches())))), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
