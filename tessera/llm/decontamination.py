"""Benchmark decontamination by a prefix-filtered set join.

A *window* is ``window`` consecutive words of a benchmark item (a shorter item is
one window).  Containment of a whole window needs every one of its words, so the
prefix that has to meet in the join is the window's rarest word alone: windows
are indexed by it (rarity: how many windows hold the word, then its hash).  A
document word that equals an index key proposes a start; it stands if the whole
window fits between the document's ends (length bound) at the offset the key has
in it (position bound), and if all its words agree there (exact verification).

The benchmark side is read in blocks of at most ``block_windows`` windows; each
block's index is broadcast (a size bound by that parameter) and the documents are
scanned against it without any shuffle.  With more than one block, a document's
hits travel with its text from one block's scan to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tables, text

WINDOW = 10
#: A block's index takes about 150 bytes a window: 75 MB.
BLOCK_WINDOWS = 500_000
_SLOTS = 1 << 20
_STATE = "hits binary, items array<long>"
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"


@dataclass
class Index:
    """Windows by their rarest word; entries of key k: first[k] to first[k + 1]."""

    keys: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    body: np.ndarray
    body_at: np.ndarray
    item: np.ndarray
    slots: np.ndarray


def _item_words(texts: list[str | None]) -> text.Words:
    chunk = next(text.chunks(pa.array(texts, pa.string()), 1 << 62), None)
    if chunk is None:
        chunk = text.Chunk(0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return text.words(chunk, text.ALNUM, text.LOWER)


def build_index(ids: list[int], texts: list[str | None], window: int) -> Index:
    w = _item_words(texts)
    n = w.counts()
    per = np.where(n == 0, 0, np.maximum(1, n - window + 1))
    at = text.ragged(w.first[:-1], per)
    row = np.repeat(np.arange(len(n)), per)
    length = np.minimum(n[row], window)
    place = text.ragged(at, length)
    owner = np.repeat(np.arange(len(at)), length)
    h = w.hashes[place]
    values, back = np.unique(h, return_inverse=True)
    freq = np.bincount(back, minlength=len(values))
    order = np.lexsort((h, freq[back], owner))
    lead = order[np.searchsorted(owner, np.arange(len(at)))] if len(at) else np.zeros(0, np.int64)
    begin = np.searchsorted(owner, np.arange(len(at)))
    key, offset = h[lead], lead - begin
    by = np.argsort(key, kind="stable")
    keys, first = np.unique(key[by], return_index=True)
    slots = np.zeros(_SLOTS, bool)
    slots[(keys & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    ids_ = np.asarray(ids, np.int64)
    return Index(keys, np.append(first, len(by)), offset[by], length[by], w.hashes, at[by], ids_[row[by]] if len(by) else np.zeros(0, np.int64), slots)


def _meet(w: text.Words, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, entry) of every window of the index that occurs in the chunk."""
    h = w.hashes
    maybe = np.flatnonzero(x.slots[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
    if not len(maybe) or not len(x.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(x.keys, h[maybe]), len(x.keys) - 1)
    ok = x.keys[k] == h[maybe]
    maybe, k = maybe[ok], k[ok]
    begin, count = x.first[k], x.first[k + 1] - x.first[k]
    outs, outs_e = [], []
    edges = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 20))
    for lo, hi in zip(edges, [*edges[1:], len(k)], strict=True):
        if lo >= hi:
            continue
        entry = text.ragged(begin[lo:hi], count[lo:hi])
        start = np.repeat(maybe[lo:hi], count[lo:hi]) - x.offset[entry]
        row = np.searchsorted(w.first, np.repeat(maybe[lo:hi], count[lo:hi]), "right") - 1
        fit = (start >= w.first[row]) & (start + x.length[entry] <= w.first[row + 1])
        start, entry = start[fit], entry[fit]
        for i in range(int(x.length.max(initial=0))):  # word by word, those still equal
            far = i < x.length[entry]
            same = ~far
            same[far] = h[start[far] + i] == x.body[x.body_at[entry[far]] + i]
            start, entry = start[same], entry[same]
            if not len(start):
                break
        outs.append(start)
        outs_e.append(entry)
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(outs), np.concatenate(outs_e)


def _scan(index, schema: pa.Schema, rest: int, last: bool):
    """Reads text, the carried columns and, from a pass before, hits and items."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            for c in text.chunks(batch.column(0)):
                w = text.words(c, text.ALNUM, text.LOWER)
                start, entry = _meet(w, x)
                n = len(w.hashes)
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + x.length[entry], -1)
                hit = np.cumsum(cover[:-1]) > 0
                row = np.searchsorted(w.first, start, "right") - 1
                pair = np.unique(np.stack([row, x.item[entry]], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                items = [set(i.tolist()) for i in np.split(pair[:, 1], np.searchsorted(pair[:, 0], np.arange(1, c.rows)))]
                part = batch.slice(c.first, c.rows)
                if part.num_columns > rest + 1:
                    for i, (bits, more) in enumerate(zip(part.column(rest + 1).to_pylist(), part.column(rest + 2).to_pylist(), strict=True)):
                        items[i] |= set(more)
                        if bits is not None:
                            own = slice(w.first[i], w.first[i + 1])
                            hit[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=own.stop - own.start).astype(bool)
                total = np.concatenate([[0], np.cumsum(hit)])[w.first]
                kept = list(part.columns[1 : rest + 1])
                ids = pa.array([sorted(i) for i in items], pa.list_(pa.int64()))
                if last:
                    names = [",".join(sorted(map(str, i))) for i in items]
                    n_hit = np.diff(total)
                    out = [*kept, pa.array(w.counts()), pa.array(n_hit), pa.array([len(i) for i in items]), pa.array([hashlib.sha256(i.encode()).hexdigest() for i in names], pa.string()), pa.array(n_hit > 0), ids]
                else:
                    bits = [np.packbits(hit[w.first[i] : w.first[i + 1]]).tobytes() if total[i + 1] > total[i] else None for i in range(c.rows)]
                    out = [part.column(0), *kept, pa.array(bits, pa.binary()), ids]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)

    return go


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, and n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words: runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    lower-cased.  A word is hit if it lies in any occurrence of a window of an
    item.  Null texts have no words; an item without words has no window; items
    of null id or text take no part; items that repeat an id count once.  The
    text may be carried too.  Rows that repeat are judged each on its own.
    """
    spark = df.sparkSession
    if clash := set(carry) & {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    docs = df.select(df[text_col].cast("string").alias("__text"), *[df[c] for c in carry])
    kept = docs.schema.fields[1:]
    blocks = list(_blocks(items, item_id, item_text, window, block_windows))
    for k, block in enumerate(blocks):
        ids, texts = block()
        index = spark.sparkContext.broadcast(build_index(ids, texts, window))
        last = k == len(blocks) - 1
        schema = T.StructType([*kept, *_fields(_RESULT)] if last else [docs.schema.fields[0], *kept, *_fields(_STATE)])
        docs = docs.mapInArrow(text.tidy(_scan(index, to_arrow_schema(schema), len(kept), last)), schema)
        if not last:  # so that one block's index is held at a time
            docs = tables.written(docs, "decontamination")
            index.destroy()
    return docs


def _fields(ddl: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(ddl).fields)


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int, limit: int) -> Iterator[Callable[[], tuple[list, list]]]:
    """Readers of blocks of items of about limit windows each; one (empty) block at least."""
    own = items.select(items[item_id].cast("long").alias("id"), items[item_text].cast("string").alias("t")).where("id is not null and t is not null")
    # A text of b bytes has at most (b + 1) / 2 words.
    total = own.agg(F.sum((F.octet_length("t") + 1) / 2)).first()[0] or 0
    n = max(1, int(-(-total // limit)))

    def read(k: int) -> tuple[list, list]:
        got = (own if n == 1 else own.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k)).collect()
        return [r[0] for r in got], [r[1] for r in got]

    for k in range(n):
        yield lambda k=k: read(k)
