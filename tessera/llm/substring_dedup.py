"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference.  Every window of ``window`` words holds exactly
one *seed*, the leftmost smallest hash among its word grams (a minimizer), so two
equal windows hold equal seeds.  Seeds are dealt by hash into reference blocks;
every document is factored against every block that indexes one of its seeds:

1. ``packed``    documents -> chunks (compressed text, one row for ~4 MB);
2. seeds         chunk -> one blob of distinct seeds for each block; a block
                 answers with a bitmap: which seeds occur elsewhere too;
3. windows       only windows around such seeds are hashed and dealt to blocks
                 (the earliest of each in its chunk); a block answers with the
                 earliest start in the corpus of every window that starts earlier
                 elsewhere;
4. factors       each document is parsed greedily from left to right: a factor
                 goes on while the next window too has an earlier start on the
                 same diagonal of its source. A factor shorter than ``window``
                 words can't arise; where one factor ends, the windows across the
                 boundary are looked up like all others, so a repeat that changes
                 its source midway loses no word.

The words of the factors are what is removed.  Windows are equal if two independent
64-bit hashes of their words are.

Blobs are sorted numpy arrays: what is shuffled is about 8 bytes a seed and about
18 a repeated window, and a passage shared by all documents is sent once for each
chunk, so no block grows with the number of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import packed, tables, text

WINDOW, GRAM = 20, 8
#: Stands in a chunk's carried columns for the text, which the chunk holds anyway: is it null?
_NULL = "__null"

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("src_doc", pa.int64()), ("src_start", pa.int64())]))),
    ]
)
_OUT_DDL = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, "
    "spans array<struct<start:long,n_words:long,src_doc:long,src_start:long>>"
)


class _Parsed:
    """Words, seeds and windows of one chunk; the same in every pass."""

    def __init__(self, row: dict, window: int, gram: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.chunk = packed.text_of(row)
        self.words = text.words(self.chunk)
        h, first, span = self.words.hashes, self.words.first, window - gram + 1
        ok = text.within(first, window)
        self.at = np.flatnonzero(ok)  # window starts
        g = text.grams(h, gram)
        best, seed = g[: len(ok)].copy(), np.arange(len(ok), dtype=np.int32)
        for i in range(1, span):  # leftmost smallest gram of each window
            x = g[i : i + len(ok)]
            less = x < best
            best = np.where(less, x, best)
            seed[less] = np.flatnonzero(less) + i
        self.seed_at = seed[self.at]  # of each window
        self.seed_hash = best[self.at]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds of the chunk, and whether the chunk has each more than once."""
        keep = np.ones(len(self.at), bool)
        keep[1:] = self.seed_at[1:] != self.seed_at[:-1]
        h, n = np.unique(self.seed_hash[keep], return_counts=True)
        return h, n > 1

    def windows(self, repeated: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts (sorted) and both hashes of the windows around repeated seeds."""
        if not len(repeated) or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        spot = np.minimum(np.searchsorted(repeated, self.seed_hash), len(repeated) - 1)
        at = self.at[repeated[spot] == self.seed_hash]
        h, g = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for lo in range(0, len(at), 1 << 18):
            s = at[lo : lo + (1 << 18)]
            x = y = self.words.hashes[s]
            for i in range(1, window):
                w = self.words.hashes[s + i]
                x, y = x * text._U64(text._G2) + w, y * text._U64(text._G1) + text.mix(w)
            h[lo : lo + len(s)], g[lo : lo + len(s)] = text.mix(x), text.mix(y)
        return at, h, g

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and start within the document."""
        row = np.searchsorted(self.words.first, at, "right") - 1
        return self.ids[row], at - self.words.first[row]

    def earliest(self, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """For each window, the index of the chunk's earliest one that is equal."""
        return _leads(h, g, *self.place(at))


def _leads(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each entry, the first by (doc, start) of those with its two hashes."""
    order = np.lexsort((start, doc, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _send_seeds(blocks: int, window: int, gram: int):
    def go(batches):
        for r in packed.rows(batches):
            h, many = _Parsed(r, window, gram).seeds()
            out = [(k, r["chunk"], packed.squeeze(h[i], np.packbits(many[i]))) for k, i in packed.split(packed.block_of(h, blocks))]
            if out:
                yield packed.frame(packed.BLOB, out)

    return go


def _answer_seeds(group: pa.Table) -> pa.Table:
    """Per blob a bitmap of the seeds that occur more than once in the corpus."""
    got = [packed.stretch(x.as_py(), np.uint64, np.uint8) for x in group.column("blob")]
    every = np.concatenate([h for h, _ in got])
    times = np.concatenate([np.unpackbits(m, count=len(h)) for h, m in got]).astype(np.int64) + 1
    keys, back = np.unique(every, return_inverse=True)
    hit = (np.bincount(back, times, len(keys)) > 1)[back]
    at, rows = 0, []
    for (h, _), chunk, block in zip(got, group.column("chunk").to_pylist(), group.column("block").to_pylist(), strict=True):
        rows.append((chunk, block, np.packbits(hit[at : at + len(h)]).tobytes()))
        at += len(h)
    return pa.Table.from_batches([packed.frame(packed.REPLY, rows)])


def _repeated(p: _Parsed, replies: pa.Table, blocks: int) -> np.ndarray:
    """The chunk's seeds that occur more than once, sorted."""
    h, _ = p.seeds()
    mark = np.zeros(len(h), bool)
    bits = dict(zip(replies.column("block").to_pylist(), replies.column("blob").to_pylist(), strict=True))
    for k, i in packed.split(packed.block_of(h, blocks)):
        mark[i] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(i)).astype(bool)
    return h[mark]


def _sent(p: _Parsed, at: np.ndarray, h: np.ndarray, lead: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, indices into at) of the chunk's earliest windows, by (doc_id, start)."""
    own = np.flatnonzero(lead == np.arange(len(at)))
    doc, start = p.place(at[own])
    own = own[np.lexsort((start, doc))]
    for k, i in packed.split(packed.block_of(h[own], blocks)):
        yield k, own[i]


def _send_windows(blocks: int, window: int, gram: int):
    def go(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows or not replies.num_rows:
            return packed.BLOB.empty_table()
        r = chunk.to_pylist()[0]
        p = _Parsed(r, window, gram)
        at, h, g = p.windows(_repeated(p, replies, blocks), window)
        out = []
        for k, i in _sent(p, at, h, p.earliest(at, h, g), blocks):
            doc, start = p.place(at[i])
            out.append((k, r["chunk"], packed.squeeze(h[i], g[i], packed.delta(doc), packed.delta(start.astype(np.int32)))))
        return pa.Table.from_batches([packed.frame(packed.BLOB, out)]) if out else packed.BLOB.empty_table()

    return go


def _answer_windows(group: pa.Table) -> pa.Table:
    """Per blob: which windows start earlier elsewhere, and there earliest."""
    got = []
    for x in group.column("blob"):
        h, g, d, s = packed.stretch(x.as_py(), np.uint64, np.uint64, np.int64, np.int32)
        got.append((h, g, np.cumsum(d), np.cumsum(s, dtype=np.int64)))
    h, g, doc, start = (np.concatenate([x[i] for x in got]) for i in range(4))
    lead = _leads(h, g, doc, start)
    hit = (doc[lead] != doc) | (start[lead] != start)
    at, rows = 0, []
    for own, chunk, block in zip(got, group.column("chunk").to_pylist(), group.column("block").to_pylist(), strict=True):
        m = hit[at : at + len(own[0])]
        src = lead[at : at + len(own[0])][m]
        if m.any():
            rows.append((chunk, block, packed.squeeze(np.packbits(m), packed.delta(doc[src]), packed.delta(start[src]))))
        at += len(own[0])
    return pa.Table.from_batches([packed.frame(packed.REPLY, rows)]) if rows else packed.REPLY.empty_table()


def _factor(blocks: int, window: int, gram: int, texts: bool, empty: pa.Schema, source: str):
    def go(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return empty.empty_table()
        r = chunk.to_pylist()[0]
        p = _Parsed(r, window, gram)
        kinds = replies.column("kind").to_pylist()
        seeds = replies.filter(pa.array([k == 0 for k in kinds], pa.bool_()))
        found = dict(zip(*(replies.filter(pa.array([k == 1 for k in kinds], pa.bool_())).column(c).to_pylist() for c in ("block", "blob")), strict=True))
        at, h, g = p.windows(_repeated(p, seeds, blocks), window) if seeds.num_rows else p.windows(np.zeros(0, np.uint64), window)
        lead = p.earliest(at, h, g)
        doc, start = p.place(at)
        src_doc, src_start = doc[lead], start[lead]  # the chunk's earliest ...
        for k, i in _sent(p, at, h, lead, blocks):
            if k in found:  # ... or an earlier one of another chunk
                m, d, s = packed.stretch(found[k], np.uint8, np.int64, np.int64)
                j = i[np.unpackbits(m, count=len(i)).astype(bool)]
                src_doc[j], src_start[j] = np.cumsum(d), np.cumsum(s)
        src_doc, src_start = src_doc[lead], src_start[lead]
        hit = (src_doc != doc) | (src_start != start)
        return _parse(p, r, at[hit], src_doc[hit], src_start[hit], start[hit], window, texts, source)

    return go


def _parse(p: _Parsed, r: dict, at, src_doc, src_start, start, window: int, texts: bool, source: str) -> pa.Table:
    w, rows = p.words, p.chunk.rows
    n = len(w.starts)
    # Greedy factors: from a window on, as long as the next one too is found on the diagonal of its source.
    # Where one ends, the windows across its end were looked up as well, and begin factors of their own.
    row = np.searchsorted(w.first, at, "right") - 1
    same = np.zeros(len(at), bool)
    same[1:] = (np.diff(at) == 1) & (np.diff(row) == 0) & (np.diff(src_doc) == 0) & (np.diff(src_start) == 1)
    lo = np.flatnonzero(~same)
    length = np.diff(np.append(lo, len(at))) + window - 1
    # A word of any factor goes.
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, at[lo], 1)
    np.add.at(cover, at[lo] + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    factor = pa.StructArray.from_arrays([pa.array(x) for x in (start[lo], length, src_doc[lo], src_start[lo])], ["start", "n_words", "src_doc", "src_start"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[lo], np.arange(rows + 1)).astype(np.int32)), factor)
    # Kept words, each row's joined by one space.
    keep = np.flatnonzero(~gone)
    sizes = w.ends[keep] - w.starts[keep] + 1
    body = np.full(int(sizes.sum()), 0x20, np.uint8)
    ends = np.cumsum(sizes)
    body[text.ragged(ends - sizes, sizes - 1)] = p.chunk.data[text.ragged(w.starts[keep], sizes - 1)]
    edge = np.searchsorted(keep, w.first)
    byte = np.concatenate([[0], ends])[edge]
    joined = [body[byte[i] : max(byte[i], byte[i + 1] - 1)].tobytes() for i in range(rows)]
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
    null = p.ids == packed.NULL_ID
    out = pa.table(
        [
            pa.array(p.ids, mask=null),
            pa.array(w.counts()),
            pa.array(removed.astype(np.int64)),
            pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
            pa.array(joined, pa.binary()).cast(pa.string()) if texts else pa.nulls(rows, pa.string()),
            spans,
        ],
        schema=_OUT,
    )
    if (rest := packed.rest_of(r)) is not None:
        for name in rest.schema.names:
            out = out.append_column(*((name, rest.column(name)) if name != _NULL else (source, _source(p.chunk, rest.column(name)))))
    return out


def _source(chunk: text.Chunk, null: pa.ChunkedArray) -> pa.Array:
    """The texts that a chunk was made of."""
    whole = pa.Array.from_buffers(pa.large_binary(), chunk.rows, [None, pa.py_buffer(chunk.offsets), pa.py_buffer(chunk.data)])
    return pc.if_else(null.combine_chunks(), pa.scalar(None, pa.large_string()), whole.view(pa.large_string())).cast(pa.string())


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: its words, and those left after substring dedup.

    Words are runs of anything but ASCII white space.  A word goes if some window
    of ``window`` words over it starts earlier too: in a row of smaller id, or
    earlier in the same row.  Columns: doc_id, n_words, n_removed, kept_sha256,
    kept (null unless ``texts``), spans (the factors that were removed: start,
    n_words, and the doc and start of the earliest source), then those of ``carry``.

    Null text has no words; a text of fewer than ``window`` words keeps all; a
    null id counts as the smallest id.  Rows that repeat an id are read as one
    document each with the same place in the order: equal starts in them don't
    remove each other.  Columns not named in ``carry`` don't pass through.
    """
    spark = df.sparkSession
    if clash := set(carry) & set(_OUT.names):
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    own = text_col if df.schema[text_col].dataType == T.StringType() else None  # else the text that is carried isn't the chunk's
    docs = df.select(df[id_col].cast("long").alias("__id"), df[text_col].cast("string").alias("__text"), *[df[text_col].isNull().alias(_NULL) if c == own else df[c] for c in carry])
    out = T.StructType([*T._parse_datatype_string(_OUT_DDL).fields, *[df.schema[c] for c in carry]])
    empty = to_arrow_schema(out)
    chunks, blocks = packed.chunked(docs, "substring-chunks")
    seeds = chunks.mapInArrow(text.tidy(_send_seeds(blocks, window, gram)), packed.BLOB_DDL)
    repeated = seeds.groupBy("block").applyInArrow(_answer_seeds, packed.REPLY_DDL)
    repeated = tables.written(repeated, "substring-seeds")
    windows = chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(text.tidy_groups(_send_windows(blocks, window, gram)), packed.BLOB_DDL)
    earlier = windows.groupBy("block").applyInArrow(_answer_windows, packed.REPLY_DDL)
    replies = repeated.withColumn("kind", F.lit(0)).unionByName(earlier.withColumn("kind", F.lit(1)))
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(text.tidy_groups(_factor(blocks, window, gram, texts, empty, text_col)), out)
