"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of
``books`` codebooks fitted to residuals, then together by least squares.  Encoding is a beam search: at every
book the ``beam`` best partial sums are extended by all codewords; with tables of
inner products this needs no residual vector.  The squared norm of each
approximation is stored with its codes.

Search.  A query's inner products with all codewords make a lookup table; a row's
score is the sum of its codes' entries (with the stored norm for Euclidean
distance).  Each part of the index ranks its distinct vectors by that score, reranks
the best exactly (``rerank``, or one in RERANK_SHARE of a large part, so that recall
doesn't hang on how rows are dealt to parts), takes the rows of these by ascending
vec_id, and sends its k nearest; a query's parts are merged by a window of k rows.

Queries are taken in blocks of at most ``block`` rows, one after the other: a block is
broadcast, meets every row of the index, and its nearest are written before the next
block is read, so neither the driver nor the plan grows with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables, text

BOOKS, WORDS, BEAM, RERANK, RERANK_SHARE, FIT_ROWS, BLOCK, PART = 16, 256, 4, 128, 64, 16_384, 4096, 32_768
_INDEX = "vec_id long, vector array<double>, codes binary, norm double"
_FOUND = "query_id long, vec_id long, score double"


class Quantiser:
    def __init__(self, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 3):
        """Fit the books one after the other to what the former leave, by k-means."""
        r = np.random.default_rng(seed)
        rest, found = x.astype(np.float32), []
        words = max(1, min(words, len(x)))
        for _ in range(books):
            c = rest[r.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                near = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                n = np.bincount(near, minlength=words)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            rest = rest - c[(rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
            found.append(c)
        self.books = np.stack(found)
        self._refine(x.astype(np.float32))

    def _refine(self, x: np.ndarray, pull: float = 1.0) -> None:
        """All codewords at once: least squares for the sample's codes, drawn a little to where they are."""
        m, k, d = self.books.shape
        c = self.encode(x, 1).astype(np.int64)
        both, total = np.zeros((m * k, m * k), np.float32), np.zeros((m * k, d), np.float32)
        for i in range(m):
            np.add.at(total, i * k + c[:, i], x)
            for j in range(i, m):
                n = np.bincount(c[:, i] * k + c[:, j], minlength=k * k).reshape(k, k)
                both[i * k : (i + 1) * k, j * k : (j + 1) * k] = n
                both[j * k : (j + 1) * k, i * k : (i + 1) * k] = n.T
        both[np.arange(m * k), np.arange(m * k)] += pull
        self.books = np.linalg.solve(both, total + pull * self.books.reshape(m * k, d)).reshape(m, k, d).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search; |x - sum|^2 grows by |c|^2 - 2 x.c + 2 sum.c with a codeword c."""
        m, k, d = self.books.shape
        flat = self.books.reshape(-1, d)
        cross = (flat @ flat.T).reshape(m, k, m, k)  # large beside the books: made where it is used, never sent
        out = np.empty((len(x), m), np.uint8)
        for lo in range(0, len(x), 1024):
            v = x[lo : lo + 1024].astype(np.float32)
            n = len(v)
            dots = np.einsum("nd,mkd->mnk", v, self.books, optimize=True)
            cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
            for i in range(m):
                own = np.diagonal(cross[i, :, i, :])
                step = own[None] - 2 * dots[i]
                more = cost[:, :, None] + step[:, None, :]
                for j in range(i):
                    more += 2 * cross[j][codes[:, :, j], i]
                flat = more.reshape(n, -1)
                b = min(beam, flat.shape[1])
                best = np.argpartition(flat, b - 1, axis=1)[:, :b]
                cost = np.take_along_axis(flat, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
            out[lo : lo + n] = codes[np.arange(n), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[i][codes[:, i]] for i in range(len(self.books)))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    sound = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    return v.where(sound)


def _index(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            codes = q.encode(x)
            norm = (q.decode(codes).astype(float) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], ["vec_id", "vector", "codes", "norm"])

    return go


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PART:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in groups of equal vectors: each group's first row (ascending), rows by group, where a group starts."""
    key = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    _, first, back = np.unique(key.view(np.dtype((np.void, key.itemsize * key.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    group = place[back]
    return first[order], np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group))])


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest; the first of those equal to the last."""
    if len(score) <= n:
        return np.arange(len(score))
    cut = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > cut)
    return np.concatenate([above, np.flatnonzero(score == cut)[: n - len(above)]])


def _search(shared, k: int, rerank: int, metric: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, queries = shared.value
        m = len(q.books)
        lut = np.einsum("qd,mkd->qmk", queries.astype(np.float32), q.books, optimize=True)
        for part in _parts(batches):
            own = part.column("vec_id").to_numpy()
            own, first = np.unique(own, return_index=True)  # an id that repeats counts once
            part = part.take(pa.array(first))
            x = _matrix(part.column("vector").combine_chunks())
            rep, members, at = _alike(x)
            codes = np.frombuffer(b"".join(part.column("codes").take(pa.array(rep)).to_pylist()), np.uint8).reshape(len(rep), m)
            norm = part.column("norm").to_numpy()[rep]
            columns = [np.ascontiguousarray(codes[:, i]) for i in range(m)]
            for i, qid in enumerate(ids):
                near = lut[i, 0][columns[0]]
                for j in range(1, m):
                    near += lut[i, j][columns[j]]
                if metric == "l2":
                    near = 2 * near - norm
                top = _best(near, max(rerank, len(rep) // RERANK_SHARE) + 1)  # one more, as the query's own may be among them
                exact = (x[rep[top]] * queries[i]).sum(1) if metric == "ip" else -((x[rep[top]] - queries[i]) ** 2).sum(1)
                size = np.minimum(at[top + 1] - at[top], k + 1)
                rows, exact = members[text.ragged(at[top], size)], np.repeat(exact, size)
                rows, exact = rows[own[rows] != qid], exact[own[rows] != qid]
                keep = np.lexsort((own[rows], -exact))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), qid)), pa.array(own[rows][keep]), pa.array(exact[keep])], schema=schema)

    def joined(batches):
        held, n = [], 0
        for b in go(batches):
            held.append(b)
            n += b.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def nearest(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "ip", books: int = BOOKS, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where ``query`` (over vec_id) holds.

    Metric ip: largest inner product; l2: smallest squared distance (score is its
    negative).  Scores are exact; ties go to the smaller vec_id.  Rows of null id
    or of a vector that is null, empty, zero, or holds a null or non-finite
    component take no part, nor do those whose length isn't the most frequent
    (the smaller of equals).  Rows that repeat an id count once, with their best
    score.  Columns other than the two don't matter, whatever their names.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return out
    rows = rows.where(F.size("vector") == lengths[0]["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    q = Quantiser(np.array(sample["vector"].tolist()), books)
    index = tables.written(rows.mapInArrow(_index(spark.sparkContext.broadcast(q)), _INDEX), "ann-index")
    asked = index.where(query)
    blocks = max(1, -(-asked.count() // block))
    found = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", F.lit(b"q")), F.lit(blocks)) == b)
        got = own.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
        if not got:
            continue
        shared = spark.sparkContext.broadcast((q, np.array([r[0] for r in got]), np.array([r[1] for r in got])))
        found.append(tables.path_of(tables.written(index.mapInArrow(text.tidy(_search(shared, k, rerank, metric)), _FOUND), "ann-found")))
        shared.destroy()
    if not found:
        return out
    found = spark.read.schema(_FOUND).parquet(*found)
    # An id that repeats in several parts comes once, with its largest score.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
