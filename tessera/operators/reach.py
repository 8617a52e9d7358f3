"""What two steps over light nodes lead to, without a list for each neighbour of a node.

Asked rows are dealt over blocks, and lists over blocks of what is in them; each two blocks
meet once, in a cell, so what is shuffled grows with the lists times the blocks, not with the
degrees.  In a cell the distinct nodes of a row are counted; those of blocks of lists add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes in the lists of a block of rows, of a block of lists, and those gathered or marked at once.
ROWS, LISTS, AT_ONCE = 1 << 23, 1 << 24, 1 << 22
#: Blocks of rows, at least.
LEAST = 6
_OUT = "row long, mine long, other long, n long, m long, both long"


def dense(nodes: DataFrame) -> DataFrame:
    """nodes (stored) with ids from monotonically_increasing_id counted through from 0; one row a partition is collected."""
    sizes = {r["p"]: r["n"] for r in nodes.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    at = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), (F.shiftright("id", 33) + 1).cast("int"))
    return nodes.withColumn("id", (F.col("id").bitwiseAND((1 << 33) - 1) + at).cast("int" if total < 1 << 31 else "long"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists; null is empty."""
    lengths = [np.asarray(c.value_lengths().fill_null(0), dtype=np.int64) for c in column.chunks]
    values = [np.asarray(c.flatten()) for c in column.chunks]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
    return offsets, np.concatenate(values) if values else np.zeros(0, np.int64)


def _long(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(-1).combine_chunks(), dtype=np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class _Cell:
    """Lists of a block, and the nodes in them by place."""

    def __init__(self, right: pa.Table, asked: list[np.ndarray], blocks: int, block: int):
        v, shape = _long(right["v"]), _long(right["shape"])
        offsets, values = _flat(right["near"])
        places = [values // blocks, *[x[x % blocks == block] // blocks for x in asked]]
        held = np.zeros(max((int(p.max()) + 1 for p in places if len(p)), default=0), bool)
        for p in places:
            held[p] = True
        self.rank, self.size = np.cumsum(held, dtype=np.int64) - 1, int(held.sum())
        self.ids = np.flatnonzero(held) * blocks + block
        values = self.rank[places[0]]
        lengths = np.diff(offsets)
        shaped = np.flatnonzero(v < 0)
        self.shape = np.full(self.size, -1, np.int64)
        self.shape[values[_spread(offsets[shaped], lengths[shaped])]] = np.repeat(shape[shaped], lengths[shaped])
        order = np.argsort(v, kind="stable")[len(shaped) :]
        self.v, self.starts, self.lengths, self.values = v[order], offsets[order], lengths[order], values
        self.blocks, self.block = blocks, block

    def side(self, offsets: np.ndarray, near: np.ndarray) -> tuple:
        """For the neighbours of rows: (row's bounds, starts, lengths, ranks of those in the block or -1, bounds of what is gathered)."""
        at = np.minimum(np.searchsorted(self.v, near), max(len(self.v) - 1, 0))
        known = self.v[at] == near if len(self.v) else np.zeros(len(near), bool)
        starts, lengths = (np.where(known, x[at], 0) if len(self.v) else np.zeros(len(near), np.int64) for x in (self.starts, self.lengths))
        own = np.full(len(near), -1, np.int64)
        here = near % self.blocks == self.block
        own[here] = self.rank[near[here] // self.blocks]
        return offsets, starts, lengths, own, np.concatenate([[0], np.cumsum(lengths + (own >= 0))])

    def distinct(self, side: tuple, me: np.ndarray, first: int, last: int, stamp: np.ndarray) -> np.ndarray:
        """row * size + rank of what rows first .. last lead to, each once and without the row's own node."""
        offsets, starts, lengths, own, total = side
        lo, end, parts = offsets[first], offsets[last], []
        while lo < end:
            hi = min(end, max(lo + 1, np.searchsorted(total, total[lo] + AT_ONCE, "right") - 1))
            row = np.repeat(np.arange(last - first), np.diff(np.clip(offsets[first : last + 1], lo, hi)))
            base, direct = row * self.size, own[lo:hi]
            key = np.concatenate([np.repeat(base, lengths[lo:hi]) + self.values[_spread(starts[lo:hi], lengths[lo:hi])], (base + direct)[direct >= 0]])
            parts.append(_once(key, stamp))
            lo = hi
        key = parts[0] if len(parts) == 1 else _once(np.concatenate([np.zeros(0, np.int64), *parts]), stamp)
        return key[self.ids[key % self.size] != me[first + key // self.size]] if len(key) else key


def _once(key: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    turn = np.arange(len(key), dtype=np.int32)
    stamp[key] = turn
    return key[stamp[key] == turn]


def _plain(cell: _Cell, row: np.ndarray, me: np.ndarray, side: tuple, out: list) -> None:
    """Counts of rows without a shape and without b: nothing but the number of marks is needed."""
    offsets, starts, lengths, own, total = side
    gathered = total[offsets]
    step, first = max(1, AT_ONCE // max(cell.size, 1)), 0
    stamp = np.zeros(step * cell.size, np.int32)
    here = me % cell.blocks == cell.block
    place = np.minimum(me // cell.blocks, max(len(cell.rank) - 1, 0))
    held = here & (me // cell.blocks < len(cell.rank))
    while first < len(row):
        last = min(len(row), first + step, max(first + 1, int(np.searchsorted(gathered, gathered[first] + AT_ONCE, "right")) - 1))
        lo, hi = offsets[first], offsets[last]
        base = np.repeat(np.arange(last - first) * cell.size, np.diff(offsets[first : last + 1]))
        long, direct = lengths[lo:hi], own[lo:hi]
        key = np.repeat(base, long)
        key += cell.values[_spread(starts[lo:hi], long)]
        key = np.concatenate([key, (base + direct)[direct >= 0]])
        turn = np.arange(len(key), dtype=np.int32)
        stamp[key] = turn
        won = stamp[key] == turn
        at = np.concatenate([[0], np.cumsum(won, dtype=np.int64)])
        far = np.concatenate([[0], np.cumsum(long)])[offsets[first : last + 1] - lo]
        near = far[-1] + np.concatenate([[0], np.cumsum(direct >= 0)])[offsets[first : last + 1] - lo]
        n = np.diff(at[far]) + np.diff(at[near])
        # The row's own node, where it was marked, doesn't count.
        mine = np.flatnonzero(held[first:last])
        self_ = mine * cell.size + np.maximum(cell.rank[place[first + mine]], 0) if len(mine) else mine
        if len(mine) and len(key):
            t = np.minimum(stamp[self_], len(key) - 1)
            n[mine] -= (key[t] == self_) & (cell.ids[self_ % cell.size] == me[first + mine])
        some = np.flatnonzero(n)
        none = np.full(len(some), -1)
        out.append([row[first + some], none, none, n[some], np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)])
        first = last


def _shaped(cell: _Cell, row: np.ndarray, mine: np.ndarray, a: np.ndarray, b: np.ndarray, sides: list[tuple], out: list) -> None:
    """Counts by shape, of a, of b and of both."""
    work = np.cumsum(sum(np.diff(s[4][s[0]]) for s in sides))
    step, first = max(1, AT_ONCE // max(cell.size, 1)), 0
    stamp, mark = np.zeros(step * cell.size, np.int32), np.zeros(step * cell.size, bool)
    while first < len(row):
        before = work[first - 1] if first else 0
        last = min(len(row), first + step, max(first + 1, int(np.searchsorted(work, before + AT_ONCE, "right"))))
        ka, kb = cell.distinct(sides[0], a, first, last, stamp), cell.distinct(sides[1], b, first, last, stamp)
        mark[ka] = True
        both = kb[mark[kb]]
        mark[ka] = False
        keys = np.concatenate([ka, kb, both])
        which = np.repeat(np.arange(3), [len(ka), len(kb), len(both)])
        owner = keys // max(cell.size, 1)
        # Shapes matter to rows that have one only.
        shape = np.where(mine[first + owner] >= 0, cell.shape[keys % max(cell.size, 1)], -1) if len(keys) else keys
        kinds, code = np.unique(shape, return_inverse=True)
        n = np.bincount((owner * len(kinds) + code) * 3 + which, minlength=(last - first) * len(kinds) * 3).reshape(-1, 3)
        some = np.flatnonzero(n.any(axis=1))
        at = first + some // max(len(kinds), 1)
        out.append([row[at], mine[at], kinds[some % max(len(kinds), 1)], *n[some].T])
        first = last


def _counted(left: pa.Table, right: pa.Table, blocks: int) -> pa.Table:
    out: list[list[np.ndarray]] = []
    if left.num_rows:
        cell = _Cell(right, [_flat(left[c])[1] for c in ("near_a", "near_b")], blocks, int(left["cell"][0].as_py()) % blocks)
        plain = pc.and_(pc.is_null(left["mine"]), pc.is_null(left["b"]))
        for part, quick in ((left.filter(plain), True), (left.filter(pc.invert(plain)), False)):
            row, mine, a, b = (_long(part[c]) for c in ("row", "mine", "a", "b"))
            sides = [cell.side(*_flat(part[c])) for c in ("near_a", "near_b")]
            if quick:
                _plain(cell, row, a, sides[0], out)
            else:
                _shaped(cell, row, mine, a, b, sides, out)
    names = ["row", "mine", "other", "n", "m", "both"]
    columns = [np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]).astype(np.int64) for i in range(6)]
    return pa.table({c: pa.array(x, pa.int64(), mask=x < 0) for c, x in zip(names, columns, strict=True)})


def _meeting(blocks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: _counted(left, right, blocks)


def counted(rows: DataFrame, lists: DataFrame, shapes: DataFrame) -> DataFrame:
    """(row, mine, other, n, m, both): how many nodes of shape ``other`` a's and b's neighbours and the lists of these lead to, without a or b itself, and how many are common.

    rows: (row, mine, a, near_a, b, near_b), b may be null; lists: (v, near); shapes: (id, shape) of nodes that have one.
    ``other`` is null for all nodes without a shape, and for all nodes of a row where ``mine`` is null. Counts of a (row, other) are to be summed.
    """
    total = lambda df, *c: df.agg(F.sum(sum(F.greatest(F.size(x), F.lit(0)) for x in c))).first()[0] or 0
    sent, held = total(rows, "near_a", "near_b"), total(lists, "near")
    high, wide = max(LEAST, math.ceil(sent / ROWS)), max(1, math.ceil(held / LISTS))
    left = rows.withColumn("i", F.pmod(F.xxhash64("row"), F.lit(high)).cast("long"))
    left = left.select(F.explode(F.sequence(F.col("i") * wide, F.col("i") * wide + wide - 1)).alias("cell"), F.col("row").cast("long").alias("row"), "mine", "a", "near_a", "b", "near_b")
    part = lists.select("v", "near", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("j"))
    part = part.select("v", F.lit(None).cast("long").alias("shape"), F.filter("near", lambda x: x % F.lit(wide) == F.col("j")).alias("near"), "j")
    kind = shapes.groupBy("shape", (F.col("id") % wide).cast("int").alias("j"), F.floor(F.col("id") / (1 << 20)).alias("k")).agg(F.collect_list("id").alias("near"))
    part = part.unionByName(kind.select(F.lit(None).cast(lists.schema["v"].dataType).alias("v"), "shape", "near", "j")).where("size(near) > 0")
    right = part.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda i: (i * wide + F.col("j")).cast("long"))).alias("cell"), "v", "shape", "near")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_meeting(wide), _OUT)
