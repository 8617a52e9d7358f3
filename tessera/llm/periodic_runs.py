"""Runs (maximal repetitions) of words in documents, from the longest previous factors.

All documents of a chunk are treated at once; a symbol is a word of a document, so
nothing matches across documents.

1. Prefix doubling gives the suffix array; the classes of every round (equal stretches
   of 2^k words) are kept, and tell how far two places agree, forwards and backwards.
2. Neighbours in the suffix array give the common prefixes; a document without one of
   LEAST / 2 words has no run and is done.
3. The longest previous factor of a place is the longer of its common prefixes with the
   nearest earlier places on either side of the suffix array, found by pointer jumping.
   Greedy factors make the blocks of the Lempel-Ziv parse.
4. A run that touches a block boundary b is found from there: a period p to the right
   (at most the block's length) or to the left (less than the block and its predecessor
   have words) makes one if the extensions from b and b + p, or b - p and b, add up to
   p words.  The extensions aren't cut, so each run comes out whole.
5. A run inside a block is a copy of one inside the block's source: blocks are taken
   from left to right, with the runs known so far in order of their starts.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

LEAST = 12
CHUNK_BYTES = 1 << 20


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, classes): classes[k] tells stretches of 2^k symbols apart; what lies beyond the end is equal to nothing."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    own = symbols[order]
    fresh = np.concatenate([[True], own[1:] != own[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    classes, step = [rank], 1
    several = ~(fresh & np.concatenate([fresh[1:], [True]])) if n else fresh
    act = order[several]
    while len(act):
        ahead = act + step
        key = rank[act].astype(np.int64) * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        act, key = act[by], key[by]
        group = rank[act]
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(opens)
        slot = group + (np.arange(len(act)) - first[np.cumsum(opens) - 1])
        order[slot] = act
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[act] = slot[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        act = act[~(fresh & np.concatenate([fresh[1:], [True]]))]
        if len(act):
            classes.append(rank)
        step *= 2
    return order, classes


def ahead(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i on and from j on agree (i and j differ)."""
    n, i, j = len(classes[0]), i.copy(), j.copy()
    begin = i.copy()
    for k in range(len(classes) - 1, -1, -1):
        same = (np.maximum(i, j) < n) & (classes[k][np.minimum(i, n - 1)] == classes[k][np.minimum(j, n - 1)])
        i += same.astype(np.int64) << k
        j += same.astype(np.int64) << k
    return i - begin


def behind(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j agree."""
    i, j = i.copy(), j.copy()
    begin = i.copy()
    for k in range(len(classes) - 1, -1, -1):
        step = 1 << k
        far = np.minimum(i, j) >= step
        same = far & (classes[k][np.where(far, i - step, 0)] == classes[k][np.where(far, j - step, 0)])
        i -= same.astype(np.int64) << k
        j -= same.astype(np.int64) << k
    return begin - i


def common(classes: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The common prefix of each place in the suffix array with the one before it."""
    out = np.zeros(len(order), np.int64)
    i, j = order[:-1], order[1:]
    alive, reach = np.arange(len(i)), []
    for c in classes:  # pairs that agree in 2^k symbols, of fewer and fewer
        alive = alive[c[i[alive]] == c[j[alive]]]
        if not len(alive):
            break
        reach.append(alive)
    for k in range(len(reach) - 1, -1, -1):
        at = reach[k]
        a, b = i[at] + out[at + 1], j[at] + out[at + 1]
        inside = np.maximum(a, b) < len(order)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        out[at + 1] += (inside & (classes[k][a] == classes[k][b])).astype(np.int64) << k
    return out


def _nearest(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By rank: the last rank before that is of an earlier place, and the common prefix with it (0: none)."""
    to, length = np.arange(len(order)) - 1, lcp.copy()
    act = np.flatnonzero((length > 0) & (order[to] > order))
    while len(act):  # all between a rank and the one it points to are of later places, whether it has settled or not
        via = to[act]
        length[act], to[act] = np.minimum(length[act], length[via]), to[via]
        act = act[(length[act] > 0) & (order[to[act]] > order[act])]
    return to, length


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By rank: length of the longest previous factor of the rank's place, and where it starts."""
    left, ll = _nearest(order, lcp)
    right, rl = _nearest(order[::-1], np.concatenate([[0], lcp[1:][::-1]]))
    right, rl = len(order) - 1 - right[::-1], rl[::-1]
    return np.maximum(ll, rl), order[np.where(ll >= rl, left, np.minimum(right, len(order) - 1))]


def _touching(classes: list[np.ndarray], b: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs of period p that the places b and b + p show."""
    if least > 4:  # extensions add up to least / 2 at least, so one of them has two words
        if len(classes) < 2:
            return np.zeros((0, 3), np.int64)
        end, two, q = len(classes[0]) - 1, classes[1], b + p
        right = (q <= end) & (two[np.minimum(b, end)] == two[np.minimum(q, end)])
        left = (b >= 2) & (two[np.maximum(b - 2, 0)] == two[np.maximum(q - 2, 0)])
        b, p = b[right | left], p[right | left]
    before, after = behind(classes, b, b + p), ahead(classes, b, b + p)
    keep = (before + after >= p) & (before + after + p >= least)
    return np.stack([b - before, b + p + after, p], 1)[keep]


def runs(symbols: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs of ``least`` symbols at least.

    Document d is symbols[first[d]:first[d + 1]]; documents have no symbol in common.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(symbols):
        return none
    order, classes = suffixes(symbols)
    lcp = common(classes, order)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    can = np.zeros(len(first) - 1, bool)
    can[document[order[lcp >= -(-least // 2)]]] = True
    kept = can[document[order]]
    order, lcp = order[kept], lcp[kept]
    if not len(order):
        return none
    longest, source = previous_factors(order, lcp)
    step, origin = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    step[order], origin[order] = np.maximum(1, longest), source
    ahead_by, blocks = step.tolist(), []
    for d in np.flatnonzero(can):
        i, end = int(first[d]), int(first[d + 1])
        while i < end:
            blocks.append(i)
            i += ahead_by[i]
        blocks.append(end)  # an empty block: runs that end with the document touch it
        blocks.append(-1)
    at = np.array(blocks)
    size = np.diff(at, append=0)
    ends = at < 0
    size[ends | np.append(ends[1:], False)] = 0
    before = np.where(np.concatenate([[True], ends[:-1]]), 0, np.concatenate([[0], size[:-1]]))
    b, size, before = at[~ends], size[~ends], before[~ends]
    head = np.repeat(first[np.flatnonzero(can)], np.diff(np.concatenate([[-1], np.flatnonzero(ends)])) - 1)
    wide = np.minimum(size + before, b - head)
    found = [
        _touching(classes, np.repeat(b, size), text.ragged(np.ones(len(b), np.int64), size), least),
        _touching(classes, np.repeat(b, wide) - (back := text.ragged(np.ones(len(b), np.int64), wide)), back, least),
    ]
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # of a stretch the smallest period is its own
    found = found[new]
    holding = (size >= least + 2) & (b < len(symbols))
    return _copied(found, b[holding], size[holding], origin[b[holding]]) if len(found) else found


def _copied(found: np.ndarray, b: np.ndarray, size: np.ndarray, source: np.ndarray) -> np.ndarray:
    """With the runs inside blocks: those inside a block's source again, each where the block has it."""
    known = [tuple(r) for r in found.tolist()]
    for at, n, src in zip(b.tolist(), size.tolist(), source.tolist(), strict=True):
        k = bisect_right(known, (src + 1,))
        while k < len(known) and known[k][0] < src + n:
            start, end, period = known[k]
            if end < src + n:
                insort(known, (start + at - src, end + at - src, period))
            k += 1
    return np.array([(s, e, p) for s, p, e in sorted((s, p, e) for s, e, p in known)], np.int64).reshape(-1, 3)


def planted(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """Which word stands at each place: where h = crc32(id) is divisible by ten, words repeat from a on with period p."""
    out = np.arange(first[-1])
    for d, i in enumerate(ids):
        n = int(first[d + 1] - first[d])
        if i is None or not n:
            continue
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return out


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _chunk(ids: list[int | None], chunk: text.Chunk, plant: bool, least: int) -> pa.RecordBatch:
    w = text.words(chunk)
    first, size = w.first, w.ends - w.starts
    place = planted(ids, first) if plant else np.arange(first[-1])
    # Exact codes of the words, then one symbol for each word of a document.
    body = chunk.data[text.ragged(w.starts, size)]
    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode().indices.to_numpy() if len(size) else np.zeros(0, np.int64)
    symbols = w.row() * max(1, len(size)) + code[place]
    found = runs(symbols, first, least)
    of = np.searchsorted(first, found[:, 0], "right") - 1
    # Words that go: from the second period of a run on.
    edge = np.zeros(len(size) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    words = place[kept]
    row_words = np.concatenate([[0], np.cumsum(kept)])[first]
    at = np.concatenate([[0], np.cumsum(size[words] + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = chunk.data[text.ragged(w.starts[words], size[words])]
    raw, bounds = out.tobytes(), at[row_words].tolist()
    bucket = np.searchsorted(of, np.arange(len(first))).tolist()
    rows = []
    for d, i in enumerate(ids):
        own = found[bucket[d] : bucket[d + 1]]
        best = (None,) * 4
        start, length, period = own[:, 0] - first[d], own[:, 1] - own[:, 0], own[:, 2]
        if len(own):
            k = np.lexsort((period, start, -length))[0]
            best = (int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]))
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        kept_text = raw[bounds[d] : max(bounds[d], bounds[d + 1] - 1)]
        rows.append((i, len(own), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept_text).hexdigest()))
    names = [c.split()[0] for c in _OUT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def periodic_runs(docs: DataFrame, plant: bool = True, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_runs, its longest run (start, length, period, exponent_milli) and digests.

    Words are what white space parts.  A run is a stretch with a smallest period q and of
    max(least, 2 q) words at least that can't be extended; of equally long ones the first,
    then that of the smaller period is shown.  runs_sha256 is of all runs' lines
    ``start,length,period``, collapsed_sha256 of the words left when each run keeps its first
    period.  With ``plant``, documents whose crc32 of the id is divisible by ten are first made periodic.

    Null and empty texts have no words, no run, and nulls for the longest.  Rows of a null
    id aren't planted; repeated rows come out each for itself.  A document is held by one
    task as a whole, in some 40 bytes a word and 4 more for each doubling of its longest
    repeat.  An empty table gives no rows.  Other columns don't matter, whatever their names.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for c in text.chunks(b.column(1), CHUNK_BYTES):
                yield _chunk(ids[c.first : c.first + c.rows], c, plant, least)

    return docs.select(docs[id_col].cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(text.tidy(go), _OUT)
