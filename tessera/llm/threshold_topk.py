"""Exact top-k by Fagin's threshold algorithm.

The rows are dealt into parts.  A part keeps its distinct vectors in one sorted list
for each dimension.  A query reads the lists from their best end (the largest values
where its component is positive, the smallest where it is negative; a list of a zero
component is not read), looks up the whole vector of every row it meets, and keeps
the k best.  No row that it hasn't met can score more than the sum of its components
times the values where the lists stand; the query stops as soon as its kth score is
above that bound, or when it has met every row.  A bound equal to the kth score
doesn't stop it, since a tie may have a smaller id.

Lists are read in doubling strides.  Parts and queries meet in a secondary sort: a
task holds one part and takes the queries in blocks, as they come, so neither a
group nor the driver holds all rows or all queries.  Each part sends its k best of a
query; those are merged by a window of k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables, text

PART_ROWS, LEAST_PART, STRIDE = 32_768, 2048, 32
#: Sums below this are exact in doubles.
_EXACT = float(1 << 53)
_LONG = np.iinfo(np.int64)
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): whole-numbered doubles floor(scale * x), one row an id (the least vector of a repeated id).

    Rows of null id or vector, and vectors that hold a null component or one that
    isn't finite (before or after scaling), take no part.
    """
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    v = v.withColumn("vector", F.transform("vector", lambda x: x * F.lit(scale)))
    v = v.where("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    # rint and a comparison stay doubles: floor() would leave the range of a long
    v = v.withColumn("vector", F.transform("vector", lambda x: F.rint(x) - F.when(F.rint(x) > x, F.lit(1.0)).otherwise(F.lit(0.0)) + F.lit(0.0)))
    return v.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows padded with zeros to the longest of them."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), text.ragged(np.zeros(len(size), np.int64), size)] = flat
    return out


class Lists:
    """Sorted lists of one part's distinct vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        x = np.ascontiguousarray(x[np.argsort(ids)])
        if x.shape[1]:
            _, first, back = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        else:
            first, back = np.zeros(1, np.int64), np.zeros(len(x), np.int64)
        self.x = x[first]
        self.ids = np.sort(ids)[np.argsort(back, kind="stable")]  # of each vector, ascending
        self.copies = np.bincount(back)
        self.at = np.cumsum(self.copies) - self.copies
        down = np.argsort(-self.x, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(np.stack([down, down[:, ::-1]]).astype(np.int32))
        self.most = float(np.abs(self.x).max(initial=0))
        self.own = set(ids.tolist())

    def best(self, query: int, q: np.ndarray, k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, vectors met): the k best rows but the query's own."""
        n, width = self.x.shape
        q = np.concatenate([q, np.zeros(max(0, width - len(q)))])[:width]
        x = self.x
        held = lambda s: s
        if not float(np.abs(q).sum()) * self.most < _EXACT:  # beyond exact doubles: Python's integers
            x, q = np.frompyfunc(int, 1, 1)(x), np.frompyfunc(int, 1, 1)(q)
            held = np.frompyfunc(lambda s: min(max(s, _LONG.min), _LONG.max), 1, 1)
        lists = np.flatnonzero(q != 0)
        ways = (q[lists] < 0).astype(np.int64)
        need = k + (query in self.own)
        seen, met = np.zeros(n, bool), np.zeros(n, bool)
        top, score = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        lo, hi, left = 0, min(n, stride), n
        while left:
            seen[self.order[ways, lists, lo:hi].ravel() if len(lists) else np.arange(lo, hi)] = True
            new = np.flatnonzero(seen > met)
            met[new] = True
            left -= len(new)
            top, score = np.concatenate([top, new]), np.concatenate([score, held(x[new] @ q)])
            if len(top) > need:
                last = np.sort(score)[-need] if score.dtype == object else np.partition(score, -need)[-need]
                keep = score >= last
                top, score = top[keep], score[keep]
            if self.copies[top].sum() >= need:
                down = np.argsort(-score, kind="stable")
                kth = score[down][np.searchsorted(np.cumsum(self.copies[top][down]), need)]
                if kth > held((x[self.order[ways, lists, hi - 1], lists] * q[lists]).sum()):
                    break
            lo, hi = hi, min(n, 2 * hi)
        size = np.minimum(self.copies[top], need)
        ids, score = self.ids[text.ragged(self.at[top], size)], np.repeat(score, size)
        ids, score = ids[ids != query], score[ids != query]
        by_id = np.argsort(ids)
        down = by_id[np.argsort(-score[by_id], kind="stable")][:k]
        return ids[down], score[down], n - left


def _search(k: int):
    def part(rows: list[pa.RecordBatch]) -> Lists:
        t = pa.Table.from_batches(rows)
        return Lists(t["vec_id"].to_numpy(), _matrix(t["vector"]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, lists = None, [], None
        for b in batches:
            places = np.array(b.column(0)) * 2 + np.array(b.column(1))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1, [len(places)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                piece, (p, asks) = b.slice(lo, hi - lo), divmod(int(places[lo]), 2)
                if p != now:
                    now, rows, lists = p, [], None
                if not asks:
                    rows.append(piece)
                    continue
                if lists is None:
                    if not rows:
                        continue
                    lists, rows = part(rows), []
                found = [(q, *lists.best(q, v, k)[:2]) for q, v in zip(piece.column(2).to_pylist(), _matrix(piece.column(3)), strict=True)]
                ids = np.concatenate([f[1] for f in found])
                score = [int(s) for f in found for s in f[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), pa.array(ids), pa.array(score, pa.int64())], schema=_FOUND)

    return go


def top_k(df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, part_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * vector) with every row where ``query`` (over vec_id) holds.

    All results are exact; candidates are all rows but the query's own (all of them
    are returned if there are fewer than k), ties go to the smaller vec_id.  Vectors
    of different lengths are compared as if the shorter ended in zeros, so an empty or
    zero vector scores 0 everywhere.  Scores beyond a long are held at its limits,
    and ranked so.
    Rows that take part are those of ``quantised``; rows that repeat an id count once.
    An empty table gives no rows.  Columns other than the two don't matter, whatever their names.
    """
    spark = df.sparkSession
    rows = tables.written(quantised(df, id_col, vector_col, scale), "topk-rows")
    n = rows.count()
    size = part_rows or min(PART_ROWS, max(LEAST_PART, n // (2 * spark.sparkContext.defaultParallelism)))
    parts = max(1, -(-n // size))
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "vec_id", "vector")
    asked = rows.where(query).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "vec_id", "vector")
    met = held.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "asks")
    found = met.mapInArrow(text.tidy(_search(k)), _FOUND_DDL)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
