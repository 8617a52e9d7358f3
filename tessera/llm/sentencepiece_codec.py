"""SentencePiece encoding and decoding with a shared-prefix Viterbi pass.

The text's spaces become marks (U+2581) after a dummy mark in front; since no
piece of a supported model has a mark after another character, the text splits
into *marked words* (marks, then others) that encode on their own.

Distinct marked words are sorted, so that they form a trie, and are visited
depth-first: going from one word to the next keeps the forward column up to their
common prefix.  The forward step at a prefix picks its last piece:

* unigram models: the piece that gives the best sum of scores (Viterbi);
* BPE models: the one piece with which the prefix's merge result can end. Merging
  always gives a sequence whose neighbouring pieces are each what merging their
  joined text gives, and there is just one such sequence for a prefix; so the step
  takes the longest piece that fits the column at its start.

Either way a prefix is solved once for all words under it, and the pieces are read
off backwards.  A character without a piece becomes its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A Python worker forgets its words and pairs beyond so many; results don't depend on it.
MEMO_WORDS = 400_000
MEMO_PAIRS = 400_000
CHUNK_BYTES = 1 << 20
_NORMAL, _UNUSED, _BYTE = 1, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Codec:
    """Pieces of a model file; encodes and decodes words."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.bytes = [-1] * 256
        self.score: list[float] = []
        self.kind: list[int] = []
        self.unigram, self.unknown = True, 0
        options = {3: 1, 4: 1, 5: 1}  # dummy mark in front, no extra space, space as mark
        charmap = b""
        for number, v in _fields(raw):
            if number == 1:
                f = dict(_fields(v))
                piece, kind = f[1].decode(), f.get(3, _NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                self.kind.append(kind)
                self.score.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                if kind == _NORMAL:
                    self.ids[piece] = i
                elif kind == _BYTE:
                    self.bytes[int(piece[3:5], 16)] = i
                elif kind == 2:
                    self.unknown = i
            elif number == 2:
                f = dict(_fields(v))
                self.unigram = f.get(3, 1) == 1
            elif number == 3:
                f = dict(_fields(v))
                options |= {k: x for k, x in f.items() if k in options}
                charmap = f.get(2, b"")
        if charmap or options[4] or not options[3] or not options[5]:
            raise ValueError("only models with the identity normaliser and the dummy mark are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans two words")
        self.byte_fallback = min(self.bytes) >= 0
        #: Control characters that no piece holds: nothing merges across them.
        held = set("".join(self.ids))
        self.barrier = np.array([b < 0x20 and chr(b) not in held for b in range(256)])
        self._fits: dict[int, bool] = {}
        self._floor = min(self.score[i] for i in self.ids.values()) - 10.0
        self._ends()

    def _ends(self) -> None:
        """Automaton over characters: each state's pieces that end there, longest first."""
        goto: list[dict[str, int]] = [{}]
        end, fail, link = [-1], [0], [[]]
        for piece, i in self.ids.items():
            s = 0
            for ch in piece:
                t = goto[s].get(ch)
                if t is None:
                    t = goto[s][ch] = len(goto)
                    goto.append({})
                    end.append(-1)
                    fail.append(0)
                    link.append([])
                s = t
            end[s] = i
        queue = [(0, ch, t) for ch, t in goto[0].items()]
        for s, ch, t in queue:
            if s:
                f = fail[s]
                while f and ch not in goto[f]:
                    f = fail[f]
                fail[t] = goto[f].get(ch, 0)
            i = end[t]
            own = [(len(self.pieces[i]), i)] if i >= 0 and (self.unigram or self._merge(self.pieces[i]) == [i]) else []
            link[t] = own + link[fail[t]]
            queue.extend((t, c, u) for c, u in goto[t].items())
        self.goto, self.fail, self.link = goto, fail, link

    def _merge(self, s: str) -> list[int]:
        """Plain BPE of a short string whose characters are all pieces: the best-scored pair first, leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the joined text of pieces a and b gives just these two."""
        if len(self._fits) > MEMO_PAIRS:
            self._fits.clear()
        got = self._fits[a << 24 | b] = self._merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return got

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word; words sorted, so that common prefixes are neighbours."""
        out: list[list[int]] = []
        state, last, size, score = [0], [-1], [0], [0.0]  # by length of prefix
        goto, fail, link, ids, fits = self.goto, self.fail, self.link, self.ids, self._fits
        before = ""
        for w in words:
            n = min(len(w), len(before))
            k = 0
            while k < n and w[k] == before[k]:
                k += 1
            del state[k + 1 :], last[k + 1 :], size[k + 1 :], score[k + 1 :]
            for i in range(k, len(w)):
                ch, s = w[i], state[i]
                while s and ch not in goto[s]:
                    s = fail[s]
                s = goto[s].get(ch, 0)
                state.append(s)
                if ch not in ids:
                    last.append(-2)
                    size.append(1)
                    score.append(score[i] + self._floor)
                    continue
                if self.unigram:
                    best = None
                    for length, piece in link[s]:
                        x = score[i + 1 - length] + self.score[piece]
                        if best is None or x > best[0]:
                            best = (x, piece, length)
                    score.append(best[0])
                    last.append(best[1])
                    size.append(best[2])
                    continue
                for length, piece in link[s]:
                    a = last[i + 1 - length]
                    if a < 0:
                        break
                    ok = fits.get(a << 24 | piece)
                    if ok is None:
                        ok = self._fit(a, piece)
                    if ok:
                        break
                last.append(piece)
                size.append(length)
                score.append(0.0)
            got, i = [], len(w)
            while i:
                if last[i] == -2:
                    if self.byte_fallback:
                        got.extend(self.bytes[x] for x in reversed(w[i - 1].encode()))
                    else:
                        got.append(self.unknown)
                else:
                    got.append(last[i])
                i -= size[i]
            got.reverse()
            out.append(got)
            before = w
        return out

    def decode(self, ids: list[int]) -> str:
        out = []
        for i in ids:
            if self.kind[i] == _BYTE:
                out.append(bytes([int(self.pieces[i][3:5], 16)]))
            elif self.kind[i] == 2:
                out.append(" ⁇ ".encode())
            elif self.kind[i] in (_NORMAL, 4):
                out.append(self.pieces[i].encode())
        s = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
        return s[1:] if s.startswith(" ") else s

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """For vectorised decoding: all pieces' bytes (mark as space), and offsets."""
        raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(MARK, " ").encode() if k in (_NORMAL, 4) else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, self.kind, strict=True)]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def load(path: str = MODEL) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def _marked(c: text.Chunk) -> text.Chunk:
    """The chunk with one space put in front of every row that isn't empty."""
    size = np.diff(c.offsets)
    grown = size + (size > 0)
    offsets = np.concatenate([[0], np.cumsum(grown)])
    data = np.full(int(offsets[-1]), 0x20, np.uint8)
    data[text.ragged(offsets[:-1] + (size > 0), size)] = c.data
    return text.Chunk(c.first, data, offsets)


def _cut(c: text.Chunk, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, spans and hashes of marked words, and each row's first word: spaces, then others, up to a barrier; or barriers."""
    b = c.data
    space = b == 0x20
    if (b == 0xE2).any():  # a mark that the text holds itself counts as a space
        at = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81))
        if len(at):
            keep = np.ones(len(b), bool)
            keep[at + 1] = keep[at + 2] = False
            b = b.copy()
            b[at] = 0x20
            kept = np.concatenate([[0], np.cumsum(keep)])
            c = text.Chunk(c.first, b[keep], kept[c.offsets])
            b, space = c.data, c.data == 0x20
            c_new = c
        else:
            c_new = c
    else:
        c_new = c
    start = space.copy()
    start[1:] &= ~space[:-1]
    stop = barrier[b]
    start[1:] |= stop[1:] != stop[:-1]
    first = c_new.offsets[:-1][np.diff(c_new.offsets) > 0]
    start[first] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(b))
    power, inverse = text.powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text._VALUE[b] * power[: len(b)])])
    h = text.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return b, np.stack([starts, ends]), h, np.searchsorted(starts, c_new.offsets)


class _Memo:
    """Words met by this Python worker: their ids, end to end, by hash."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def ids(self, b: np.ndarray, span: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[spot] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = b.tobytes()
            s, e = span[0][at[new]].tolist(), span[1][at[new]].tolist()
            words = [raw[i:j].decode("utf-8", "replace").replace(" ", MARK) for i, j in zip(s, e, strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            got = self.codec.encode_sorted([words[i] for i in order])
            sizes = np.array([len(g) for g in got], np.int64)
            flat = np.array([i for g in got for i in g], np.int32)
            all_keys = np.concatenate([self.keys, keys[new][order]])
            slot = np.concatenate([self.slot, len(self.first) - 1 + np.arange(len(new))])
            self.flat = np.concatenate([self.flat, flat])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            by = np.argsort(all_keys)
            self.keys, self.slot = all_keys[by], slot[by]
        slot = self.slot[np.searchsorted(self.keys, keys)][back]
        n = self.first[slot + 1] - self.first[slot]
        return self.flat[text.ragged(self.first[slot], n)], n


_memos: dict[str, _Memo] = {}


def _encode(model: str, schema: pa.Schema, check: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _memos:
            _memos[model] = _Memo(load(model))
        memo = _memos[model]
        codec = memo.codec
        body, offs = codec.spans()
        for batch in batches:
            for c in text.chunks(batch.column(0), CHUNK_BYTES):
                b, span, h, first = _cut(_marked(c), codec.barrier)
                flat, n = memo.ids(b, span, h) if len(h) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                edge = np.concatenate([[0], np.cumsum(n)])[first]
                ids = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat))
                # Decoding again: all pieces' bytes, without each row's dummy space.
                size = offs[flat + 1] - offs[flat]
                back = body[text.ragged(offs[flat], size)]
                ends = np.concatenate([[0], np.cumsum(size)])[edge]
                own = [back[ends[i] + 1 : ends[i + 1]].tobytes() for i in range(c.rows)]
                source = [c.data[c.offsets[i] : c.offsets[i + 1]].tobytes().replace(MARK.encode(), b" ") for i in range(c.rows)]
                same = pa.array([x == y for x, y in zip(own, source, strict=True)])
                part = batch.slice(c.first, c.rows)
                out = [*part.columns[1:], ids, pa.array(np.diff(edge)), same]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)

    return go


def encode(df: DataFrame, text_col: str = "text", model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, ids (array of int), n_tokens, round_trip (decoding gives the text again).

    Null and empty texts have no ids.  A mark (U+2581) inside a text decodes as a
    space, as the format can't tell them apart.  Every row is encoded whole.
    """
    if clash := set(carry) & {"ids", "n_tokens", "round_trip"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    docs = df.select(df[text_col].cast("string").alias("__text"), *[df[c] for c in carry])
    more = T._parse_datatype_string("ids array<int>, n_tokens long, round_trip boolean").fields
    schema = T.StructType([*docs.schema.fields[1:], *more])
    return docs.mapInArrow(text.tidy(_encode(model, to_arrow_schema(schema), True)), schema)


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, and text: what the ids spell. Null ids give null."""
    rows = df.select(df[ids_col].cast("array<int>").alias("__ids"), *[df[c] for c in carry])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def go(batches):
        codec = load(model)
        for batch in batches:
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], schema=arrow)

    return rows.mapInArrow(go, schema)
