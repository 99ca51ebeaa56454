"""Exact top-k search with a KD-tree per shard.

Median splits of a bounded sample cut the space into cells, and a cell's vectors are dealt over
shards. Each shard builds a KD-tree: median splits along the widest dimension, with the tight
bounding box of every node. A query visits nodes best first, by the largest score that any point
of the box could have, and stops when that is below its k-th score so far. The k-th score from a
query's own shard is carried to the others: cells whose box can't reach it are not visited, and
in the rest most nodes are never opened.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, table
from fieldloom.llm.vectors import matrix, runs, same_width, usable

#: Rows of a shard and of a block of queries, about; most cells, and vectors that their splits are made from.
SHARD_ROWS, QUERY_ROWS = 8192, 16384
CELLS, SAMPLE = 256, 8192
LEAF = 64
#: A score is kept as two longs, ``high * 2**LOW + low``; beyond 2**MOST it counts as that.
LOW, MOST = 62, 124


class KDTree:
    """Points of one shard, in leaves of at most LEAF, ordered by the tree."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            me = len(self.span)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(me)
            if b - a > LEAF and (hi > lo).any():
                dim, mid = int(np.argmax(hi - lo)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, dim], mid)]
                stack += [(a, a + mid, me), (a + mid, b, me)]
        self.points = points[self.order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score any point of each node's box could have, for each query."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(1024 * x) as doubles, which rows are too large for exact scores in doubles)."""
    with np.errstate(over="ignore"):
        q = np.floor(m * 1024.0)
        return q, np.abs(q).max(axis=1, initial=0) ** 2 * m.shape[1] >= 2.0**53


def whole_numbers(row: np.ndarray) -> list[int]:
    """floor(1024 * x) of a row of any size, exactly."""
    return [int(x) * 1024 if abs(x) >= 2.0**53 else math.floor(x * 1024.0) for x in row.tolist()]


def exact_score(a: list[int], b: list[int]) -> int:
    return max(-(1 << MOST), min(1 << MOST, sum(x * y for x, y in zip(a, b, strict=True))))


class Shard:
    """The vectors of a shard, searched with a bound that gets better. Rows whose scores doubles may not hold
    stand apart and are scored with Python's integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        q, large = quantise(vectors)
        self.width, self.vectors, self.all_ids = vectors.shape[1], vectors, ids
        self.large = [(int(i), whole_numbers(v)) for i, v in zip(ids[large], vectors[large], strict=True)]
        self.tree = KDTree(q[~large]) if (~large).any() else None
        self.ids = ids[~large][self.tree.order] if self.tree else ids[:0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """Rows (query_id, vec_id, score) of each query's k best in the shard that reach ``least``."""
        queries = np.pad(queries, ((0, 0), (0, max(0, self.width - queries.shape[1]))))
        if queries.shape[1] > self.width:  # what the vectors do not have counts as zero
            queries = queries[:, : self.width]
        q, large = quantise(queries)
        step = 1024
        for at in range(0, len(q), step):
            bounds = self.tree.bounds(q[at : at + step]) if self.tree else None
            for i in range(at, min(at + step, len(q))):
                me = int(query_ids[i])
                if large[i]:
                    own = whole_numbers(queries[i])
                    found = [(exact_score(own, whole_numbers(v)), -int(j)) for j, v in zip(self.all_ids, self.vectors, strict=True) if j != me]
                    best = heapq.nlargest(k, found)
                else:
                    best = self._best(me, q[i], bounds[i - at] if self.tree else None, float(least[i]), k)
                    if self.large:
                        own = whole_numbers(queries[i])
                        best = heapq.nlargest(k, best + [(exact_score(own, v), -j) for j, v in self.large if j != me])
                for score, minus in best:
                    yield me, -int(minus), int(score)

    def _best(self, me: int, query: np.ndarray, bounds: np.ndarray | None, limit: float, k: int) -> list[tuple[float, int]]:
        best: list[tuple[float, int]] = []  # (score, -id), the k-th on top
        heap = [(-bounds[0], 0)] if bounds is not None else []
        while heap and -heap[0][0] >= limit:
            node = heapq.heappop(heap)[1]
            if self.tree.kids[node]:
                for kid in self.tree.kids[node]:
                    if bounds[kid] >= limit:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            a, b = self.tree.span[node]
            scores = self.tree.points[a:b] @ query
            for i in np.flatnonzero(scores >= limit):
                if self.ids[a + i] == me:
                    continue
                item = (scores[i], -self.ids[a + i])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    limit = max(limit, best[0][0])
        return best


class Cells:
    """Median splits of a sample: ``of`` gives the cell of each vector, from 0."""

    def __init__(self, sample: np.ndarray, wanted: int) -> None:
        self.splits: list[list[tuple[int, float]]] = []
        parts = [np.arange(len(sample))]
        while 2 * len(parts) <= wanted and min(map(len, parts)) >= 2:
            level, halves = [], []
            for p in parts:
                own = sample[p]
                dim = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.shape[1] else 0
                at = float(np.median(own[:, dim])) if own.shape[1] else 0.0
                level.append((dim, at))
                halves += [p[own[:, dim] < at], p[own[:, dim] >= at]] if own.shape[1] else [p, p[:0]]
            self.splits.append(level)
            parts = halves
        self.number = 2 ** len(self.splits)

    def of(self, m: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(m), np.int64)
        for level in self.splits:
            dims, ats = np.array([d for d, _ in level]), np.array([a for _, a in level])
            dim = dims[cell]
            value = np.where(dim < m.shape[1], m[np.arange(len(m)), np.minimum(dim, m.shape[1] - 1)], 0.0)
            cell = 2 * cell + (value >= ats[cell])
        return cell


def in_cells(x: DataFrame, cells: Cells) -> DataFrame:
    """``id, vec, cell``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells.of(matrix(b.column("vec").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32))], ["id", "vec", "cell"])

    return x.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id long, vec array<double>, cell int")


def boxes(x: DataFrame, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) component of each cell, which has ``rows`` vectors, in each dimension; at most CELLS * dimensions
    rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, cell = matrix(b.column("vec").to_pylist()), b.column("cell").to_numpy()
                for c in np.unique(cell):
                    own = m[cell == c]
                    n = m.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0)),
                                                      pa.array(np.full(n, len(own), np.int64))], ["cell", "dim", "lo", "hi", "n"])

    found = x.select("vec", "cell").mapInArrow(run, "cell int, dim int, lo double, hi double, n long")
    found = found.groupBy("cell", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    width = max((r.dim for r in found), default=-1) + 1
    lo, hi = np.zeros((len(rows), width)), np.zeros((len(rows), width))
    for r in found:
        # shorter vectors leave out dimensions that count as zero
        short = r.n < rows[r.cell]
        lo[r.cell, r.dim], hi[r.cell, r.dim] = (min(r.lo, 0.0), max(r.hi, 0.0)) if short else (r.lo, r.hi)
    return lo, hi


def visits(queries: DataFrame, lo: np.ndarray, hi: np.ndarray, shards: np.ndarray) -> DataFrame:
    """``id, vec, least, shard``: a query for each shard, other than its own, of the cells whose box lets a score reach
    ``least``. The bound has room for rounding."""
    starts = np.cumsum(shards) - shards
    there = shards > 0
    with np.errstate(over="ignore"):
        low, high = np.nan_to_num(np.floor(lo * 1024.0)), np.nan_to_num(np.floor(hi * 1024.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                m = matrix(part.column("vec").to_pylist())
                with np.errstate(all="ignore"):
                    q = np.floor(m * 1024.0)
                    q, a = same_width(q, low)
                    z = np.pad(high, ((0, 0), (0, a.shape[1] - high.shape[1])))
                    bound = np.maximum(q, 0) @ z.T + np.minimum(q, 0) @ a.T
                    bound += 1e-9 * (np.abs(q) @ np.maximum(np.abs(a), np.abs(z)).T)
                reach = (np.nan_to_num(bound, nan=np.inf, posinf=np.inf) >= part.column("least").to_numpy()[:, None]) & there
                row, cell = np.nonzero(reach)
                row, cell = np.repeat(row, shards[cell]), np.repeat(cell, shards[cell])
                # number the shards of each (row, cell)
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]) if len(row) else np.zeros(0, bool)
                place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
                shard = starts[cell] + place
                other = shard != part.column("shard").to_numpy()[row]
                row, shard = row[other], shard[other]
                for j in range(0, len(row), 8192):
                    at = pa.array(row[j : j + 8192])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("vec").take(at), part.column("least").take(at), pa.array(shard[j : j + 8192].astype(np.int32))],
                                                     ["id", "vec", "least", "shard"])

    return queries.select("id", "vec", "least", "shard").mapInArrow(run, "id long, vec array<double>, least double, shard int")


def shipped(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The vectors of each shard, once for each block that has queries for it."""
    asked = queries.groupBy("shard").agg(F.collect_set("block").alias("blocks"))  # numbers of blocks: few beside a shard's vectors
    return vectors.join(asked, "shard").select("shard", F.explode("blocks").alias("block"), F.lit(0).alias("kind"), "id", "vec", F.lit(0.0).alias("least"))


def search_shards(vectors: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """``query_id, vec_id, high, low``: each query's best in each shard it goes to. A shard's vectors come once for
    each block of queries that go there and before them, its tree is built once for the block."""
    block = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(blocks)).cast("int")
    q = queries.select("shard", block.alias("block"), F.lit(1).alias("kind"), "id", "vec", "least")
    v = shipped(vectors, q.select("shard", "block"))
    both = v.union(q).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for t in runs(batches, ["shard", "block", "kind"]):
            key, m = (t["shard"][0].as_py(), t["block"][0].as_py()), matrix(t["vec"].to_pylist())
            if t["kind"][0].as_py() == 0:
                at, shard = key, (t["id"].to_numpy(), m)
                continue
            if key != at:
                continue  # no vectors there
            if isinstance(shard, tuple):
                shard = Shard(*shard)
            rows = list(shard.search(t["id"].to_numpy(), m, t["least"].to_numpy(), k))
            for i in range(0, len(rows), 8192):
                ids, found, scores = zip(*rows[i : i + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array([s >> LOW for s in scores], pa.int64()),
                                                  pa.array([s & (1 << LOW) - 1 for s in scores], pa.int64())], ["query_id", "vec_id", "high", "low"])

    return both.mapInArrow(run, "query_id long, vec_id long, high long, low long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products of floor(1024 * x).

    Queries are the rows whose key is divisible by ``every``, candidates all rows but the
    query's own; ties go to the smaller id, and with fewer than ``k`` candidates all are given.
    Null vectors, vectors with null or non-finite components, and rows with a null key take no
    part; a repeated key counts once (see ``vectors.usable``); a shorter vector is filled up
    with zeros. Components of any size count exactly; a score that a long can't hold is given as the nearest
    long. An empty table gives an empty result.

    Shards hold about SHARD_ROWS rows and query blocks QUERY_ROWS, whatever the input's size. The splits are made
    from at most SAMPLE vectors; they decide only where a vector lies, every vector is searched.
    """
    steps = Steps(vectors.sparkSession)
    whole = x = steps.keep(usable(vectors, key, vector))
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    counts = x.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks = -(-counts[1] // QUERY_ROWS) or 1
    sample = matrix([r[0] for r in x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    cells = Cells(sample, min(CELLS, max(1, counts[0] // SHARD_ROWS)))
    x = steps.keep(in_cells(x, cells))
    steps.drop(whole)
    rows = np.zeros(cells.number, np.int64)
    for r in x.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CELLS rows
        rows[r.cell] = r.n
    shards = -(-rows // SHARD_ROWS)
    starts = np.cumsum(shards) - shards
    first_shard, n_shards = (F.array(*[F.lit(int(i)) for i in a]) for a in (starts, shards))
    own = F.get(first_shard, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(n_shards, F.col("cell"))).cast("int")
    x = x.withColumn("shard", own.cast("int"))
    queries = x.where(is_query)
    first = steps.keep(search_shards(x, queries.withColumn("least", F.lit(float("-inf"))), 1, k))  # a shard holds few of its own
    kth = first.groupBy("query_id").agg(F.min(F.struct("high", "low")).alias("kth"), F.count(F.lit(1)).alias("n"))
    near = (F.shiftleft("kth.high", LOW) + F.col("kth.low")).cast("double")
    far = F.col("kth.high").cast("double") * 2.0**LOW
    value = F.when(F.col("kth.high").isin(0, -1), near).otherwise(far)
    lower = value - F.when(F.abs(value) >= 2.0**53, F.abs(value) * 1e-9).otherwise(0.0)  # rounding must not exclude a tie
    bound = F.when(F.col("n") >= k, lower).otherwise(F.lit(float("-inf")))
    known = queries.join(kth, F.col("id") == F.col("query_id"), "left").withColumn("least", F.coalesce(bound, F.lit(float("-inf"))))
    lo, hi = boxes(x, rows)
    rest = search_shards(x, visits(known, lo, hi, shards), blocks, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    score = (F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63))).otherwise(F.shiftleft("high", LOW).bitwiseOR(F.col("low"))))
    out = first.union(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", score.alias("score"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
