"""Spelling variants of a vocabulary by two-dimensional range reporting.

Words of one length are points (rank in forward order, rank in reverse order).  A
word that differs from w by one code point at position i begins with what w has
before i and ends with what w has after it: a rectangle, the prefix's interval in
forward order by the suffix's interval in reverse order.  A wavelet tree over the
reverse ranks in forward order reports the points of a rectangle.  Taking w among
the words of its own length gives replacements, among those one longer gives
insertions; deletions are insertions read the other way.

How it is spread.  A range [a, b) of edit positions among words of length L leaves
the first a and the last L - b code points as they are, so words that are near by an
edit in the range agree in these: they are the key that words meet by.  Each word
goes to two keys (the halves of its length) as it is and to two as one that misses
a code point.  A key of too many letters is cut in two at the middle of its range, again and
again; at a single position a key holds no more words than the alphabet has letters.
So no task holds an unbounded group, and no two words are compared that don't share
all but a few letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

LEAST, TIMES, SKIP = 7, 10, 31
#: Letters of a key before it is cut, and of a block, that one task holds.
KEY_LETTERS, BLOCK_LETTERS = 400_000, 800_000
RUN = "([A-Za-z\\u00C0-\\u00FF]{%d,})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least: int = LEAST, skip: int = SKIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``least`` code points that occur twice at least.

    Where ``skip`` divides h, the unsigned crc32 of ``<id>:<run>``, the run loses its
    code point h modulo its length (none is lost by a null id).  Null texts have no words.
    """
    runs = F.regexp_extract_all(F.translate(docs[text_col], UPPER, LOWER), F.lit(RUN % least))
    found = docs.select(docs[id_col].cast("string").alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.coalesce(F.pmod(h, F.lit(skip)) == 0, F.lit(False)), cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of (length, a, b, word, shift): shift is 1 for a word that misses a code point."""
    head = F.col("word").substr(F.lit(1), F.col("a"))
    tail = F.col("word").substr(F.col("b") - F.col("shift") + 1, F.col("length"))
    return rows.withColumn("key", F.xxhash64("length", "a", "b", head, tail))


def _dealt(words: DataFrame, limit: int) -> DataFrame:
    """Rows (length, a, b, shift, word, key) such that words that are near meet in a key of bounded size."""
    size = F.char_length("word")
    both = words.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    both = both.select("word", "shift", (size + F.col("shift")).cast("int").alias("length"))
    rows = _halved(both.select("word", "shift", "length", F.lit(0).alias("a"), F.col("length").alias("b")))
    light = []
    while True:
        rows = tables.written(_keyed(rows), "spelling-keys")
        heavy = rows.where("b - a > 1").groupBy("key").agg(F.sum(F.col("length").cast("long")).alias("letters")).where(F.col("letters") > limit).select("key")
        heavy = tables.written(heavy, "spelling-heavy")
        if heavy.isEmpty():
            light.append(rows)
            break
        light.append(rows.join(heavy, "key", "left_anti"))
        rows = _halved(rows.join(heavy, "key", "left_semi").drop("key"))
    out = light[0]
    for more in light[1:]:
        out = out.unionByName(more)
    return out


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.col("a") + F.expr("(b - a) div 2").cast("int")
    ends = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))
    return rows.withColumn("range", F.explode(ends)).select("word", "shift", "length", "range.a", "range.b").where("a < b")


class Wavelet:
    """Wavelet tree over a permutation of 0..m: which of values[l:r] lie in [lo, hi)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, v = [], np.asarray(values)
        for level in range(self.bits - 1, -1, -1):
            one = (v >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            v = np.concatenate([v[one == 0], v[one == 1]])

    def report(self, l: np.ndarray, r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
        """(query, value) of every point of every rectangle, level by level for all queries at once."""
        query, base = np.arange(len(l)), np.zeros(len(l), np.int64)
        for k, zeros in enumerate(self.zeros):
            half, total = 1 << (self.bits - 1 - k), zeros[-1]
            zl, zr = zeros[l], zeros[r]
            sides = []
            for left, right, start in ((zl, zr, base), (total + l - zl, total + r - zr, base + half)):
                keep = (left < right) & (start < hi[query]) & (start + half > lo[query])
                sides.append((query[keep], left[keep], right[keep], start[keep]))
            query, l, r, base = (np.concatenate(x) for x in zip(*sides, strict=True))  # noqa: E741
        return query, base


class Order:
    """Rows of a letter matrix in lexicographic order, with the common prefix of neighbours."""

    def __init__(self, letters: np.ndarray):
        m, width = letters.shape
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"U{width}").ravel(), kind="stable")
        s = letters[self.order]
        self.rank = np.empty(m, np.int64)
        self.rank[self.order] = np.arange(m)
        self.common = np.full(m + 1, -1)
        if m > 1:
            differs = s[1:] != s[:-1]
            self.common[1:m] = np.where(differs.any(1), differs.argmax(1), width)
        self.least = [self.common]
        while 2 << (len(self.least) - 1) <= m + 1:
            a, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(a[:-step], a[step:]))

    def longest(self) -> np.ndarray:
        """By row: the longest prefix that it shares with another row."""
        return np.maximum(self.common[:-1], self.common[1:])[self.rank]

    def interval(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the rows that share ``length`` letters with row."""
        left, right = self.rank[row].copy(), self.rank[row] + 1
        for k in range(len(self.least) - 1, -1, -1):
            step, least = 1 << k, self.least[k]
            go = left - step >= 0  # common[left - step + 1 : left + 1] is all >= length
            go &= least[np.where(go, left - step + 1, 0)] >= length
            left -= step * go
            go = right + step <= len(self.rank)
            go &= least[np.where(go, right, 0)] >= length
            right += step * go
        return left, right


def near(words: list[str], short: list[str], length: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): rows of ``words`` (of ``length``) and then of ``short`` (one less), and the words that
    they become by one replaced, or one inserted, code point at a position of [a, b)."""
    m = len(words)
    none = np.zeros(0, np.int64)
    if not m or m + len(short) < 2:
        return none, none
    letters = np.zeros((m + len(short), length), np.uint32)
    letters[:m] = np.array(words, f"U{length}").view(np.uint32).reshape(m, length)
    size = np.full(len(letters), length)
    size[m:] = length - 1
    back = np.zeros_like(letters)
    back[:m] = letters[:m, ::-1]
    if short and length > 1:
        letters[m:, :-1] = np.array(short, f"U{length - 1}").view(np.uint32).reshape(len(short), length - 1)
        back[m:, :-1] = letters[m:, -2::-1]
    ahead, behind = Order(letters), Order(back)
    # A position counts only where some other row shares what is before it, and some what is after it.
    first = np.maximum(a, length - 1 - behind.longest())
    last = np.minimum(b - 1, ahead.longest())
    n = np.maximum(0, last - first + 1)
    row = np.repeat(np.arange(len(letters)), n)
    at = text.ragged(first, n)
    if not len(row):
        return none, none
    points = [np.concatenate([[0], np.cumsum(o.order < m)]) for o in (ahead, behind)]  # words before a rank
    l, r = (points[0][x] for x in ahead.interval(row, at))  # noqa: E741
    lo, hi = (points[1][x] for x in behind.interval(row, length - 1 - at))
    more = (r - l > (row < m)) & (hi - lo > (row < m))  # a word's rectangle holds itself
    row, l, r, lo, hi = row[more], l[more], r[more], lo[more], hi[more]  # noqa: E741
    forward = ahead.order[ahead.order < m]
    backward = behind.order[behind.order < m]
    rank = np.empty(m, np.int64)
    rank[backward] = np.arange(m)
    query, value = Wavelet(rank[forward]).report(l, r, lo, hi)
    row, word = row[query], backward[value]
    keep = row != word
    return row[keep], word[keep]


_PAIRS = pa.schema([("word", pa.string()), ("other", pa.string())])


def _block(t: pa.Table) -> pa.Table:
    """All near pairs of a block, both ways."""
    t = t.sort_by([("length", "ascending"), ("a", "ascending"), ("b", "ascending"), ("shift", "ascending")])
    columns = [t[c].to_numpy() for c in ("length", "a", "b", "shift")]
    edges = np.flatnonzero(np.concatenate([[True], np.any([np.diff(c) != 0 for c in columns[:3]], axis=0), [True]])) if t.num_rows else [0]
    left, right = [], []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = t["word"].slice(lo, hi - lo).to_pylist()
        m = int(np.searchsorted(columns[3][lo:hi], 1))
        row, word = near(own[:m], own[m:], int(columns[0][lo]), int(columns[1][lo]), int(columns[2][lo]))
        for i, j in zip(row.tolist(), word.tolist(), strict=True):
            left.append(own[i])
            right.append(own[j])
            if i >= m:
                left.append(own[j])
                right.append(own[i])
    return pa.table([pa.array(left, pa.string()), pa.array(right, pa.string())], schema=_PAIRS)


def near_pairs(words: DataFrame, limit: int = KEY_LETTERS, block: int = BLOCK_LETTERS) -> DataFrame:
    """(word, other), both ways, of the distinct ``word`` that differ by one inserted, deleted or replaced code point."""
    rows = _dealt(tables.only(words, "word"), limit)
    letters = rows.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    blocks = max(words.sparkSession.sparkContext.defaultParallelism, -(-letters // block))
    pairs = rows.withColumn("block", F.pmod("key", F.lit(blocks))).groupBy("block").applyInArrow(_block, "word string, other string")
    return pairs.distinct()  # an edit in a run of one letter has several positions


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct (word, n).

    n_near counts the near words; form is the one of largest n (ties: the smallest in
    code-point order) if its n is at least ``times`` the word's, else null; root follows
    forms to the last one (the word itself if it has none).
    """
    words = tables.written(tables.only(words, "word", "n"), "spelling-words")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    met = near_pairs(words).join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), "other")).alias("best"))
    best = words.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.order")).alias("form_n"))
    strong = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    best = tables.written(best.withColumn("form", F.when(strong, F.col("form"))).withColumn("form_n", F.when(strong, F.col("form_n"))), "spelling-forms")
    roots = _roots(best.where("form is not null").select("word", "form"))
    return best.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their end, twice as far in each round.  Counts grow from form to form, so there is no cycle."""
    roots = forms.withColumnRenamed("form", "root")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = tables.written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")
