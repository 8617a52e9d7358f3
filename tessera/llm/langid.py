"""Language ID by a byte convolutional network in numpy.

Filters of several widths run over a window of bytes (A-Z folded to a-z) as
tables: a filter's response is the sum of one table row for each byte it covers.
ReLU, the maximum over the window, and a softmax layer follow.  A text is cut
into fixed windows that cover all of it; its language distribution is the mean
of its windows', weighted by their bytes.

Training reads a bounded sample of labelled rows: about ``per_lang`` rows of each
language (chosen by the hash of the id, so that reruns agree), at most
``WINDOWS_A_ROW`` windows of each, spread over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import text

WIDTHS, FILTERS, WINDOW, WINDOWS_A_ROW, PER_LANG, MAX_ROWS = (2, 3, 4), 16, 256, 6, 1000, 12_000
EPOCHS, BATCH, RATE = 6, 128, 0.01
UNKNOWN = "und"
_STEP = 1024
CHUNK_BYTES = 1 << 19


class Net:
    def __init__(self, langs: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.tables = {w: r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def prepare(self) -> None:
        """Tables by byte pair for prediction: all widths' first two bytes, and what remains of the wider ones."""
        t, both = self.tables, lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.first = np.concatenate([both(t[w][0], t[w][1]) + self.bias[w] for w in WIDTHS], 1)
        self.third = t[3][2]
        self.last = both(t[4][2], t[4][3])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of windows of bytes (zeros after the end)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        n = x.shape[1]
        f = FILTERS
        for lo in range(0, len(x), _STEP):
            b = np.pad(x[lo : lo + _STEP], ((0, 0), (0, 3)))
            pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            r = np.take(self.first, pair[:, :n], axis=0)
            r[:, :, f : 2 * f] += np.take(self.third, b[:, 2 : n + 2], axis=0)
            r[:, :, 2 * f :] += np.take(self.last, pair[:, 2 : n + 2], axis=0)
            z = np.maximum(r.max(1), 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + _STEP] = z / z.sum(1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = len(y) / np.maximum(1, np.bincount(y, minlength=len(self.langs))) / len(self.langs)
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                i = order[lo : lo + BATCH]
                step += 1
                for p, g, m, s in zip(params, self._gradient(x[i], y[i], weight[y[i]]), moment, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, f = len(x), FILTERS
        b = np.pad(x, ((0, 0), (0, 3)))
        tops, where = [], []
        for w in WIDTHS:
            r = sum(np.take(self.tables[w][j], b[:, j : j + x.shape[1]], axis=0) for j in range(w)) + self.bias[w]
            at = r.argmax(1)
            tops.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            where.append(at)
        h = np.concatenate(tops, 1)
        a = np.maximum(h, 0)
        z = a @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= (weight / n)[:, None].astype(np.float32)
        back = (p @ self.out.T) * (h > 0)
        tables, biases = [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * f : (k + 1) * f]
            d = np.zeros_like(self.tables[w])
            for j in range(w):
                byte = np.take_along_axis(b, where[k] + j, 1)
                np.add.at(d[j], (byte, np.arange(f)[None]), g)
            tables.append(d)
            biases.append(g.sum(0))
        return [*tables, *biases, a.T @ p, p.sum(0)]


def windows(c: text.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over every row of the chunk: bytes, row, number of bytes."""
    size = np.diff(c.offsets)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(c.rows), per)
    k = text.ragged(np.zeros(c.rows, np.int64), per)
    length = np.minimum(WINDOW, size[row] - k * WINDOW)
    start = c.offsets[row] + k * WINDOW
    x = np.zeros((len(row), WINDOW), np.uint8)
    at = text.ragged(start, length)
    x[np.repeat(np.arange(len(row)), length), text.ragged(np.zeros(len(row), np.int64), length)] = text.LOWER[c.data[at]]
    return x, row, length


def lettered(c: text.Chunk) -> np.ndarray:
    """Which rows hold a letter of any script."""
    low = c.data | 0x20
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = total[c.offsets[1:]] > total[c.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(c.offsets) > 0)):
        raw = c.data[c.offsets[i] : c.offsets[i + 1]]
        if (raw >= 0x80).any():
            out[i] = any(ch.isalpha() for ch in raw.tobytes().decode("utf-8", "replace"))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread over each row's text."""
    for batch in batches:
        lang, x = [], []
        for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = t.encode()
            n = -(-len(raw) // WINDOW)
            for k in np.unique(np.linspace(0, n - 1, min(n, WINDOWS_A_ROW)).astype(int)):
                lang.append(name)
                x.append(raw[k * WINDOW : (k + 1) * WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(x, pa.binary())], ["lang", "x"])


def train(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Net:
    """A network from a bounded sample of the rows with text and lang where ``learn`` holds."""
    rows = df.select(df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"), df[id_col].alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    rows = rows.where("learn and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    want = max(1, min(per_lang, MAX_ROWS // max(1, len(counts))))
    net = Net(sorted(counts))
    if not counts:
        return net
    # Each language's rows by a hash threshold: about want of them, all if there are fewer.
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, want / n))])
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1_000_003)) / 1_000_003
    got = rows.where(chance <= F.element_at(share, F.col("lang"))).select("text", "lang").mapInArrow(text.tidy(_sampled), "lang string, x binary").toPandas()
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, raw in enumerate(got["x"]):
        x[i, : len(raw)] = text.LOWER[np.frombuffer(raw, np.uint8)]
    y = np.searchsorted(net.langs, got["lang"].to_numpy(str)) if len(got) else np.zeros(0, np.int64)
    order = np.lexsort((*x.T[:8][::-1], y)) if len(got) else y
    net.train(x[order], y[order])
    return net


def identify(df: DataFrame, net: Net, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, lang_pred and score (0 to 1), for every row, over its whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt.
    """
    if clash := set(carry) & {"lang_pred", "score"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    docs = df.select(df[text_col].cast("string").alias("__text"), *[df[c] for c in carry])
    schema = T.StructType([*docs.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(text.tidy(_identify(df.sparkSession.sparkContext.broadcast(net), to_arrow_schema(schema))), schema)


def _identify(shared, schema: pa.Schema):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        net.prepare()
        names = np.array([*net.langs, UNKNOWN], object)
        for batch in batches:
            for c in text.chunks(batch.column(0), CHUNK_BYTES):
                x, row, length = windows(c)
                total = np.zeros((c.rows, max(1, len(net.langs))))
                if len(row) and net.langs:
                    p = net.predict(x) * length[:, None]
                    for k in range(len(net.langs)):
                        total[:, k] = np.bincount(row, p[:, k], c.rows)
                total /= np.maximum(1, np.diff(c.offsets))[:, None]
                ok = lettered(c) & bool(net.langs)
                best = np.where(ok, total.argmax(1), len(net.langs))
                score = np.where(ok, np.clip(total.max(1), 0, 1), 0.0)
                part = batch.slice(c.first, c.rows)
                out = [*part.columns[1:], pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)

    return go
