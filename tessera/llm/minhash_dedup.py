"""Near-duplicate classes by DartMinHash signatures and banded joining.

Signatures.  A text is a set (or bag) of word shingles; the element e with weight
w owns the region [0, w) x [0, inf) of a plane of its own.  Darts are thrown at
that plane at unit density by hashing alone: the cell (level, rank) of e holds a
Poisson number of darts, each with a rank, a height and a signature coordinate.
A dart counts if its height is under w.  For each coordinate the dart of least
rank is kept; two texts agree in a coordinate with probability equal to their
weighted Jaccard similarity.  Only ranks up to theta = t / (total weight) are
looked at, t = k ln k + 2k, which fills all k coordinates nearly always; theta
doubles for a text with an empty one.  So a text costs about t darts and one cell
or a few per element.

Joining.  1. Texts with equal shingles (128-bit digest) collapse into one *kind*;
the row of smallest doc_id stands for it.  2. Each band of signature rows deals
the kinds into buckets.  A bucket is not expanded into pairs: every member is
paired with the bucket's most *central* one only, that whose buckets are fullest
(in a group of near copies that is the text they were copied from, which is closer
to each copy than the copies are to each other).  A member tries the most central
of its leaders first; its other leaders only where the links found so far leave
the two in different components.  Pairs are verified exactly on the texts, and
verified links give components.  3. Where a bucket's members are in different
components yet, it may hide a link between two members that the leader isn't
similar to.  These are found by their *differences* from the leader: see
``_Differences``.

A text goes through the shuffle only if it has a bucket mate; which rows those are
is told by a bitmap (an eighth of a byte a row), broadcast while it is small.

With 40 bands of 6 rows a pair of similarity 0.8 is missed with probability
(1 - 0.8**6) ** 40 = 5e-6, and one of similarity 0.3, which texts with a passage
in common often have, is looked at with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tables, text

SHINGLE, THRESHOLD, BANDS, BAND_ROWS = 5, 0.8, 40, 6
#: Members that are compared with one copy of their leader's text.
CROWD = 128
#: A bitmap of rows is broadcast up to this size; beyond it rows are found by a join.
BITMAP_BYTES = 64 << 20
_EDGES = np.array([0, 1 / 64, 1 / 16, 1 / 4, 1.0])
_SIGNED = "uid long, lo long, hi long, n_shingles long, bands array<long>"
_LEAST = -(1 << 63)


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative distribution as 64-bit thresholds."""
    p, total, out = np.exp(-area), 0.0, []
    for i in range(24):
        total += p
        out.append(min(total, 1 - 2**-53))
        p *= area / (i + 1)
    return np.array(out)


_TABLES = [_poisson_table(a) for a in np.append(np.diff(_EDGES), 1.0)]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(c: text.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts, sorted by row and hash, and offsets by row.

    A text of fewer words than ``size`` has one shingle, all its words.
    """
    w = text.words(c, text.ALNUM, text.LOWER)
    g = text.grams(w.hashes, size)
    ok = text.within(w.first, size)
    at = np.flatnonzero(ok)
    row, h = np.searchsorted(w.first, at, "right") - 1, g[at]
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            m = n[short] > i
            x[m] = x[m] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[w.first[short[m]] + i]
        row, h = np.concatenate([row, short]), np.concatenate([h, text.mix(x + n[short].astype(np.uint64))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(c.rows + 1))


def elements(c: text.Chunk, size: int, bag: bool) -> list[np.ndarray]:
    """Each row's shingles, sorted; in a bag the j-th occurrence of one is an element of its own."""
    row, h, n, first = shingles(c, size)
    if bag and len(n) and n.max() > 1:
        j = text.ragged(np.zeros(len(n), np.int64), n)
        row, h = np.repeat(row, n), np.repeat(h, n)
        h = np.where(j > 0, text.mix(h + j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), h)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.searchsorted(row, np.arange(c.rows + 1))
    return [h[lo:hi] for lo, hi in zip(first, first[1:], strict=False)]


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """DartMinHash: rows x k minima; all-ones where a row has no element."""
    best = np.full(rows * k, ~np.uint64(0))
    total = np.bincount(row, weight, rows)
    t = k * np.log(k) + 2 * k
    theta = np.where(total > 0, t / np.maximum(total, 1e-300), 0.0)
    done = np.zeros(rows)  # rank up to which each row has been searched
    # Weight levels [0,1), [1,2), ...: one replica of an element for each level that it reaches into.
    levels = np.ceil(weight).astype(np.int64)
    rep = np.repeat(np.arange(len(h)), levels)
    level = text.ragged(np.zeros(len(h), np.int64), levels)
    rh = text.mix(h[rep] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    rrow, top = row[rep], np.minimum(1.0, weight[rep] - level)
    while True:
        # Cells (done, theta] of every replica: the five fixed ones under rank 1, then unit ones.
        lo_cell, hi_cell = _cell(done), _cell(theta, up=True)
        count = np.maximum(0, hi_cell - lo_cell)[rrow]
        step = 1 << 18
        edges = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, step)) if len(count) else []
        for a, b in zip(edges, [*edges[1:], len(count)], strict=True):
            if a < b:
                _throw(best, rh[a:b], rrow[a:b], top[a:b], text.ragged(lo_cell[rrow[a:b]], count[a:b]), count[a:b], k)
        done = np.maximum(done, _rank(hi_cell))
        empty = (best.reshape(rows, k) == ~np.uint64(0)).any(1) & (total > 0)
        if not empty.any():
            return best.reshape(rows, k)
        theta = np.where(empty, 2 * np.maximum(done, 1e-9), 0.0)
        keep = empty[rrow]
        rh, rrow, top = rh[keep], rrow[keep], top[keep]


def _cell(rank: np.ndarray, up: bool = False) -> np.ndarray:
    """Number of whole cells under a rank (or enough to reach it)."""
    under = np.searchsorted(_EDGES, rank, "left" if up else "right") - (0 if up else 1)
    over = 4 + (np.ceil(rank - 1) if up else np.floor(rank - 1)).astype(np.int64)
    return np.where(rank > 1, over, under).astype(np.int64)


def _rank(cells: np.ndarray) -> np.ndarray:
    return np.where(cells <= 4, _EDGES[np.minimum(cells, 4)], cells - 3.0)


def _throw(best: np.ndarray, rh, rrow, top, cell, count, k: int) -> None:
    """The darts of some cells; each coordinate keeps its earliest."""
    who = np.repeat(np.arange(len(rh)), count)
    u = text.mix(rh[who] ^ (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
    darts = np.zeros(len(u), np.int64)
    kind = np.minimum(cell, 4)
    x = _unit(u)
    for i, table in enumerate(_TABLES):
        m = np.flatnonzero(kind == i)
        if len(m):
            darts[m] = np.searchsorted(table, x[m], "right")
    from_cell = np.repeat(np.arange(len(u)), darts)
    if not len(from_cell):
        return
    j = text.ragged(np.zeros(len(u), np.int64), darts)
    d = text.mix(u[from_cell] + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))
    owner = who[from_cell]
    inside = top[owner]
    if (inside < 1).any():
        ok = _unit(text.mix(d + np.uint64(3))) < inside
        from_cell, d, owner = from_cell[ok], d[ok], owner[ok]
    c = cell[from_cell]
    low = np.where(c < 4, _EDGES[np.minimum(c, 4)], c - 3.0)
    wide = np.where(c < 4, np.append(np.diff(_EDGES), 1.0)[np.minimum(c, 4)], 1.0)
    rank = low + wide * _unit(d)
    # Rank, as the order of its bits, above; the dart's own bits below.
    key = (rank.view(np.uint64) & ~np.uint64(0xFFFFF)) | (text.mix(d + np.uint64(1)) >> np.uint64(44))
    coordinate = (text.mix(d + np.uint64(2)) % np.uint64(k)).astype(np.int64)
    np.minimum.at(best, rrow[owner] * k + coordinate, key)


def _sign(size: int, bands: int, band_rows: int, bag: bool, schema: pa.Schema):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, uid = bands * band_rows, (TaskContext.get().partitionId() << 40) + 1
        mult = [np.uint64(int(x)) for x in text._odd(400, band_rows)]
        for batch in batches:
            for c in text.chunks(batch.column(0)):
                row, h, n, first = shingles(c, size)
                weight = n.astype(float) if bag else np.ones(len(n))
                sig = signatures(row, h, weight, c.rows, k)
                x = sig.reshape(c.rows, bands, band_rows)
                key = sum(x[:, :, i] * mult[i] for i in range(band_rows)) + np.arange(bands, dtype=np.uint64)[None]
                key = text.mix(key.ravel()).view(np.int64)
                size_ = np.diff(first)
                some = size_ > 0
                # Digest of the element set: two sums of mixed hashes (and counts).
                e = h + (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) if bag else np.uint64(0))
                z = np.zeros(1, np.uint64)
                lo, hi = (np.concatenate([z, np.cumsum(text.mix(e + np.uint64(s)))]) for s in (11, 12))
                lo, hi = (text.mix(a[first[1:]] - a[first[:-1]] + size_.astype(np.uint64)).view(np.int64) for a in (lo, hi))
                ids = np.arange(uid, uid + c.rows)
                uid += c.rows
                lo, hi = np.where(some, lo, ids), np.where(some, hi, 0)  # a row without words is like no other
                edge = np.concatenate([[0], np.cumsum(some * bands)])
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(key.reshape(c.rows, bands)[some].ravel()))
                part = batch.slice(c.first, c.rows)
                out = [*part.columns, pa.array(ids), pa.array(lo), pa.array(hi), pa.array(size_), lists]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)

    return go


def _held(ref: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the sorted h are in the sorted ref."""
    if not len(ref):
        return np.zeros(len(h), bool)
    return ref[np.minimum(np.searchsorted(ref, h), len(ref) - 1)] == h


def _crowds(size: int, bag: bool, compare):
    """compare(row, leader's elements, member's elements) over rows sorted by (a, salt, role): a leader, then its members."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, of = None, None
        for batch in batches:
            keys = batch.select(["a", "salt", "role", "b", "root"]).to_pylist()
            for c in text.chunks(batch.column(batch.schema.get_field_index("text"))):
                out = []
                for i, e in enumerate(elements(c, size, bag), c.first):
                    r = keys[i]
                    if r["role"] == 0:
                        leader, of = e, (r["a"], r["salt"])
                    elif of == (r["a"], r["salt"]):
                        out.append((r, leader, e))
                if out:
                    yield from compare(out)

    return go


def _verify(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(got: list) -> Iterator[pa.RecordBatch]:
        rows = []
        for r, ref, e in got:
            both = int(_held(ref, e).sum())
            if both and both / (len(ref) + len(e) - both) >= threshold - 1e-12:
                rows.append((r["a"], r["b"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], schema=schema)

    return compare


class _Differences:
    """Tokens by which two members of different components can meet, given their leader L.

    x differs from L by what it lacks, M, and by what it has besides, D.  The overlap
    of x and y is |L| - |Mx| - |My| + |Mx and My| + |Dx and Dy|, so with
    k = t / (1 + t) similarity t needs |Mx and My| + |Dx and Dy| >= f(x) + f(y), where
    f(x) = k |x| + |Mx| - |L| / 2.  With e = (1 / 2 - k) |L|: f is at least -e, and more
    than e for a member that isn't similar to L.  Two sets of differences that share
    r elements share one among the first |M| + |D| - r + 1 of each, in any order that
    both keep: here D before M (what copies have besides is seldom shared), then by hash.

    Members similar to L (A) are in one component, so a partner is outside (B), and A
    needs r > f(x) + e; B needs r > f(x) - e for partners in A, which it has only if its
    similarity to L is 2 t - 1 at least (1 - similarity is a metric); among B the member
    of the smaller f takes r >= 2 f(x), the other r > f(x) + e.

    A row without token holds f, root and eight longs of parity bits: a difference
    flips the bit of its hash, so the bits of x and y differ in |Mx| + |Dx| + |My| + |Dy|
    - 2 r places at most, which bounds r from above.
    """

    SCHEMA = pa.schema([("a", pa.int64()), ("x", pa.int64()), ("token", pa.int64()), ("way", pa.int8()), ("left", pa.bool_()), ("rest", pa.int32()), ("f", pa.float64()), ("root", pa.int64()), ("bits", pa.list_(pa.int64()))])
    DDL = "a long, x long, token long, way byte, left boolean, rest int, f double, root long, bits array<long>"
    BITS = 512

    def __init__(self, threshold: float):
        self.t, self.k = threshold, threshold / (1 + threshold)

    def __call__(self, got: list) -> Iterator[pa.RecordBatch]:
        parts, about = [], []
        for r, ref, e in got:
            own = _held(ref, e)
            besides, lacks = e[~own], ref[~_held(e, ref)]
            n, both = len(besides) + len(lacks), int(own.sum())
            like = both / max(1, len(ref) + len(e) - both)
            f, edge = self.k * len(e) + len(lacks) - len(ref) / 2, (0.5 - self.k) * len(ref)
            token = np.concatenate([besides, lacks])
            # (way, left side, least overlap of differences)
            if like >= self.t - 1e-12:
                roles = [(1, True, f + edge)]
            else:
                roles = [(1, False, f - edge)] * (like >= 2 * self.t - 1 - 1e-9) + [(2, True, 2 * f), (2, False, f + edge)]
            some = False
            for way, left, need in roles:
                m = n - max(1, int(np.ceil(need - 1e-9))) + 1
                if m > 0:
                    some = True
                    parts.append((r["a"], r["b"], token[:m].view(np.int64), way, left, n - np.arange(m, dtype=np.int32)))
            if some:
                odd = np.bincount((token % np.uint64(self.BITS)).astype(np.int64), minlength=self.BITS) & 1
                about.append((r["a"], r["b"], n, f, r["root"], np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
        if parts:
            size = [len(p[2]) for p in parts]
            spread = lambda i, kind: pa.array(np.repeat(np.array([p[i] for p in parts], kind), size))
            n = sum(size)
            columns = [spread(0, np.int64), spread(1, np.int64), pa.array(np.concatenate([p[2] for p in parts])), spread(3, np.int8), spread(4, bool), pa.array(np.concatenate([p[5] for p in parts])), *(pa.nulls(n, t.type) for t in list(self.SCHEMA)[6:])]
            yield pa.RecordBatch.from_arrays(columns, schema=self.SCHEMA)
            m = len(about)
            columns = [pa.array([x[0] for x in about]), pa.array([x[1] for x in about]), *(pa.nulls(m, t.type) for t in list(self.SCHEMA)[2:5]), pa.array([x[2] for x in about], pa.int32()), *(pa.array([x[i] for x in about], t.type) for i, t in zip((3, 4, 5), list(self.SCHEMA)[6:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=self.SCHEMA)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``_crowds``: each leader a before its members b, CROWD of them at a time, so a hot leader makes no hot task."""
    size = pairs.groupBy("a").agg(F.count("*").alias("n"))
    crowds = F.floor((F.col("n") - 1) / CROWD).cast("int") + 1
    members = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), crowds).cast("int").alias("salt"), F.lit(1).alias("role"), "b", "root")
    leaders = size.select("a", F.explode(F.sequence(F.lit(0), crowds - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), F.lit(None).cast("long").alias("root"))
    rows = members.unionByName(leaders).join(texts.withColumnRenamed("kind", "b"), "b")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")


def _links(pairs: DataFrame, texts: DataFrame, size: int, threshold: float, bag: bool) -> DataFrame:
    """The pairs (a, b) of kinds that are similar enough."""
    rows = _compared(pairs.select("a", "b", F.lit(None).cast("long").alias("root")), texts)
    return rows.mapInArrow(text.tidy(_crowds(size, bag, _verify(threshold))), "a long, b long")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node of each component of the links (a, b).

    Alternating large-star and small-star steps; what is left is a star around
    each root. Every step writes a table, so lineage stays short.
    """
    edges = tables.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, tables.written(small, name)
        tables.remove(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _rooted(df: DataFrame, roots: DataFrame, side: str) -> DataFrame:
    """With the column r<side>: the root of the kind in column side."""
    own = roots.select(F.col("node").alias(side), F.col("root").alias("__root"))
    return df.join(own, side, "left").withColumn("r" + side, F.coalesce("__root", side)).drop("__root")


def _led(shared: DataFrame) -> DataFrame:
    """(bucket, b, a, central): every member with the most central one of its bucket."""
    lead = shared.groupBy("bucket").agg(F.max(F.struct("central", "b")).alias("lead"))
    return shared.join(lead, "bucket").select("bucket", "b", F.col("lead.b").alias("a"), F.col("lead.central").alias("central"))


def _to_first_leader(led: DataFrame) -> DataFrame:
    """Every member with the most central of its leaders."""
    return led.where("a <> b").groupBy("b").agg(F.max_by("a", F.struct("central", "a")).alias("a")).select("a", "b")


def _to_leaders(led: DataFrame, roots: DataFrame) -> DataFrame:
    """Every member with each of its leaders that is in another component."""
    pairs = led.where("a <> b").select("a", "b").distinct()
    return _rooted(_rooted(pairs, roots, "a"), roots, "b").where("ra <> rb").select("a", "b")


def _across(led: DataFrame, roots: DataFrame, texts: DataFrame, size: int, threshold: float, bag: bool, spent: list[DataFrame]) -> DataFrame:
    """Pairs of members of different components that may be similar though neither, or one alone, is similar to their leader.

    spent gets the table to remove once the pairs are written.
    """
    placed = _rooted(_rooted(led.select("bucket", "a", "b"), roots, "b"), roots, "a")
    mixed = placed.groupBy("bucket").agg(F.min("rb").alias("r0"), F.max("rb").alias("r1")).where("r0 <> r1").select("bucket")
    pairs = placed.join(mixed, "bucket").where("a <> b").select("a", "b", F.col("rb").alias("root")).distinct()
    found = tables.written(_compared(pairs, texts).mapInArrow(text.tidy(_crowds(size, bag, _Differences(threshold))), _Differences.DDL), "minhash-differences")
    tokens = found.where("token is not null").select("a", "x", "token", "way", "left", "rest").repartition("a", "token", "way")  # dealt once, for the counts and the join
    shared = tokens.groupBy("a", "token", "way").agg(F.count_if("left").alias("n"), F.count("*").alias("m")).where("n > 0 and m > n").drop("n", "m")
    tokens = tokens.join(shared, ["a", "token", "way"])
    about = found.where("token is null").select("a", "x", F.col("rest").alias("size"), "f", "root", "bits")
    tokens = tables.written(tokens.join(about, ["a", "x"]), "minhash-differences")
    tables.remove(found)
    spent.append(tokens)
    p, q = (tokens.where("left" if x == "p" else "not left").select("a", "token", "way", *[F.col(c).alias(c + x) for c in ("x", "root", "f", "rest", "size", "bits")]) for x in "pq")
    apart = sum((F.bit_count(F.col("bitsp")[i].bitwiseXOR(F.col("bitsq")[i])) for i in range(_Differences.BITS // 64)), F.lit(0))
    enough = F.col("fp") + F.col("fq") <= F.least("restp", "restq", (F.col("sizep") + F.col("sizeq") - apart) / 2) + 1e-9
    once = (F.col("way") == 1) | (F.struct("fp", "xp") < F.struct("fq", "xq"))
    met = p.join(q, ["a", "token", "way"]).where((F.col("rootp") != F.col("rootq")) & once & enough)
    return met.select(F.least("xp", "xq").alias("a"), F.greatest("xp", "xq").alias("b")).distinct()


def _among(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose uid is in ids (uid)."""
    bits = ids.select(F.bitmap_bucket_number("uid").alias("__k"), F.bitmap_bit_position("uid").alias("p")).groupBy("__k").agg(F.bitmap_construct_agg("p").alias("__bits"))
    bits = tables.written(bits, name)
    if bits.count() * 4096 > BITMAP_BYTES:
        return df.join(ids, "uid", "left_semi")
    spot = F.bitmap_bit_position("uid").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = df.withColumn("__k", F.bitmap_bucket_number("uid")).join(F.broadcast(bits), "__k")
    return own.where(F.getbit(byte, F.pmod(spot, F.lit(8))) == 1).drop("__k", "__bits")


def _classes(rows: DataFrame, shingle: int, threshold: float, bands: int, band_rows: int, bag: bool) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and by (lo, hi) their kind with class_id, class_size, keeper and n_links."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(_SIGNED).fields])
    signed = tables.written(rows.mapInArrow(text.tidy(_sign(shingle, bands, band_rows, bag, to_arrow_schema(schema))), schema), "minhash")
    # Kinds: rows of equal shingles, named by the row that stands for them.
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), "uid"))
    kinds = signed.groupBy("lo", "hi").agg(first.alias("first"), F.count("*").alias("n"))
    kinds = tables.written(kinds.select("lo", "hi", F.col("first.uid").alias("kind"), F.col("first.doc_id").alias("least"), "n"), "minhash-kinds")
    own = _among(signed.where("n_shingles > 0").select("uid", "bands"), kinds.select(F.col("kind").alias("uid")), "minhash-rows")
    banded = own.select(F.col("uid").alias("b"), F.explode("bands").alias("bucket")).repartition("bucket")  # dealt once, for the counts and the join
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    mates = tables.written(banded.join(sizes, "bucket").select("bucket", "b", "size"), "minhash-buckets")
    central = mates.groupBy("b").agg(F.sum("size").alias("central"))
    led = tables.written(_led(mates.drop("size").join(central, "b")), "minhash-led")
    texts = _among(signed.select("uid", F.col("__text").alias("text")), mates.select(F.col("b").alias("uid")).distinct(), "minhash-rows")
    texts = tables.written(texts.withColumnRenamed("uid", "kind"), "minhash-texts")
    tables.remove(mates)
    roots = tried = links = None
    spent: list[DataFrame] = []
    finds = (lambda _: _to_first_leader(led), lambda r: _to_leaders(led, r), lambda r: _across(led, r, texts, shingle, threshold, bag, spent))
    for find in finds:
        pairs = find(roots)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = tables.written(pairs, "minhash-pairs")
        tables.remove(*spent)
        if roots is not None and pairs.isEmpty():
            continue
        more = tables.written(_links(pairs, texts, shingle, threshold, bag), "minhash-links")
        links = more if links is None else links.unionByName(more)
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = components(links, "minhash-components")
    tables.remove(led, texts, tried)
    n_links = links.select(F.explode(F.array("a", "b")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_links"))
    named = _rooted(kinds, roots, "kind").withColumnRenamed("rkind", "cls").join(n_links, "kind", "left")
    classes = named.groupBy("cls").agg(F.min(F.struct("least", "kind")).alias("best"), F.sum("n").alias("class_size"))
    named = named.join(classes, "cls").select("lo", "hi", "class_size", F.col("best.least").alias("class_id"), F.col("best.kind").alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed, named


def _prepared(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    return df.select(df[text_col].cast("string").alias("__text"), df[id_col].cast("long").alias("doc_id"), *[df[c] for c in carry])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, bag: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, carry, class_id, class_size, n_shingles, n_links, keep.

    Words: runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    lower-cased.  Two texts are linked if the Jaccard similarity of their sets of
    ``shingle``-word shingles (bags, if ``bag``) reaches ``threshold``; classes
    are the components of all links.  class_id is the smallest doc_id of the
    class (a null id counts as the smallest); n_links is the number of other texts that
    this one was found linked to on the way (the class holds for all of them, pairs
    aren't expanded); keep holds for one row of each class,
    the first by doc_id.  A null text and one without words are classes of their
    own, so class_id is their own doc_id.  Rows that repeat are copies.  A text of
    any length is read whole; columns not named in ``carry`` don't pass through.
    """
    if clash := set(carry) & {id_col, "doc_id", "class_id", "class_size", "n_shingles", "n_links", "keep"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    signed, named = _classes(_prepared(df, id_col, text_col, carry), shingle, threshold, bands, band_rows, bag)
    out = signed.drop("bands", "__text").join(named, ["lo", "hi"])
    null = F.col("class_id") == _LEAST
    return out.select("doc_id", *carry, F.when(~null, F.col("class_id")).alias("class_id"), "class_size", "n_shingles", "n_links", (F.col("uid") == F.col("keeper")).alias("keep"))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, bag: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and carry of the rows that ``near_duplicates`` would keep; they aren't shuffled."""
    signed, named = _classes(_prepared(df, id_col, text_col, carry), shingle, threshold, bands, band_rows, bag)
    kept = _among(signed.select("uid", "doc_id", "__text", *carry), named.select(F.col("keeper").alias("uid")).distinct(), "minhash-rows")
    return kept.select("doc_id", F.col("__text").alias(text_col), *carry)
