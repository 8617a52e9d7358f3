"""Chunks and blocks: how operators look words of all documents up in tables that grow with the corpus.

``pack`` turns documents into chunks of some MB of compressed text, one row each.
A chunk sends one blob of sorted numpy arrays to each hash block it has a key in;
a block answers each chunk with one blob in the same order.  A key that many
documents hold is sent once for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

PACK_BYTES = 4 << 20
#: Text that one block answers for.
BLOCK_BYTES = 32 << 20
NULL_ID = -(1 << 63)

CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("rest", pa.binary())])
BLOB = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
REPLY = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])
def squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) * a.itemsize for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def stretch(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, np.int64, len(types)), types, strict=True):
        out.append(np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, at))
        at += int(n)
    return out


def ipc(batch: pa.RecordBatch) -> bytes | None:
    if not batch.num_columns:
        return None
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def pack(batches: Iterator[pa.RecordBatch], limit: int = PACK_BYTES) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = np.array(batch.column(0).fill_null(NULL_ID))
        for c in text.chunks(batch.column(1), limit):
            rest = batch.select(batch.schema.names[2:]).slice(c.first, c.rows)
            row = [(part << 32) + seq, ids[c.first : c.first + c.rows].tobytes(), np.diff(c.offsets).tobytes(), zstandard.ZstdCompressor(3).compress(c.data.tobytes()), ipc(rest)]
            seq += 1
            yield pa.RecordBatch.from_pylist([dict(zip(CHUNK.names, row, strict=True))], CHUNK)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def split(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, indices) in order of index; block need not be sorted."""
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(block[part[0]]), part


def frame(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names}


def delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))




CHUNK_DDL = "chunk long, ids binary, sizes binary, body binary, rest binary"
BLOB_DDL = "block long, chunk long, blob binary"
REPLY_DDL = "chunk long, block long, blob binary"


def chunked(docs: DataFrame, name: str, limit: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """Chunks of (id, text, carried columns), of about limit bytes of text, and the number of hash blocks for them."""
    chunks = tables.written(docs.mapInArrow(text.tidy(lambda batches: pack(batches, limit)), CHUNK_DDL), name)
    volume = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return chunks, max(6, -(-3 * volume // BLOCK_BYTES))  # text is about three times its compressed form


def text_of(row: dict) -> text.Chunk:
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return text.Chunk(0, data, offsets)


def rest_of(row: dict) -> pa.Table | None:
    return pa.ipc.open_stream(row["rest"]).read_all() if row["rest"] else None
