"""Language-model scoring by a hidden Markov model.

The model.  Hidden states follow a Markov chain; a state emits a word, the end of
the text, or a word never seen.  Every training word has its own emissions.  Those
of words that several chunks hold live in hash blocks (see ``packed``): in each
iteration a block sends a chunk the rows of the chunk's own words and gets their
expected counts back, so no table of all words is ever in one place.  Rows and counts
travel as a word's split over the states, in half precision; the sums and the
likelihood are in double precision.

Smoothing.  A state's emission of a training word is its own share of expected counts
mixed with the unigram, (1 - SHARE) to SHARE.  An unknown word has what the unigram gives
it, in every state, whatever the size of the corpus; the rest of the mass is the words'.

Training.  All training documents are counted.  Word counts meet in hash blocks
(see ``packed``).  Baum-Welch then runs over all training documents: each chunk
runs scaled forward and backward recursions and sends its words' expected counts to
their blocks; sums over all chunks, a few numbers a state, are made in two levels.
Seeded noise in the first tables breaks symmetry.  Every
iteration takes all training documents; there are ``rounds`` of them at most, fewer
if the likelihood settles.

Scoring.  The scaled forward recursion over the whole text, whatever its length, is log10 of the text's exact probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import packed, tables, text

STATES, ROUNDS = 8, 14
#: The unigram's part in a state's emissions.
SHARE = 0.05
#: A gain of likelihood of less than this part of it ends training.
SETTLED = 1e-5
END = np.uint64(0x5EED0E4D5EED0E4D)
_BATCH = 1 << 20
#: A word of many texts moves once a chunk and round, and steps over time serve all rows of a chunk at once: few large chunks.
_CHUNK_BYTES = 16 << 20
_SEGMENT = 1 << 12
_OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(chunk: text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and row offsets."""
    w = text.words(chunk, text.SPACED, text.LOWER)
    return np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


class Model:
    """Emissions of a chunk's own words (word, state), moves and first states."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start
        self.size, self.states = emit.shape


def _batches(sizes: np.ndarray, limit: int = _BATCH):
    """Row numbers, longest first, in batches of about limit symbols."""
    order = np.argsort(-sizes, kind="stable")
    total = np.cumsum(sizes[order])
    lo = 0
    while lo < len(order):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + limit, "right")))
        yield order[lo:hi]
        lo = hi


def _by_time(sym: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of rows (longest first) by time, then row; and the number of rows at each time."""
    size = first[rows + 1] - first[rows]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) and size[0] else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(live)])
    out = np.empty(int(at[-1]), sym.dtype)
    time = text.ragged(np.zeros(len(rows), np.int64), size)
    out[at[time] + np.repeat(np.arange(len(rows)), size)] = sym[text.ragged(first[rows], size)]
    return out, live


def expected(sym: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's E-step over rows of symbols: counts of (symbol, state), moves, first states; log-likelihood."""
    k = m.states
    emit, move, start = np.ascontiguousarray(m.emit.T, np.float32), m.move.astype(np.float32), m.start.astype(np.float32)
    on = np.ascontiguousarray(move.T)
    gamma, xi, begun, like = np.zeros((m.size, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for rows in _batches(np.diff(first)):
        s, live = _by_time(sym, first, rows)
        if not len(s):
            continue
        at = np.concatenate([[0], np.cumsum(live)]).tolist()
        # A state's numbers lie side by side: sums over the states are of eight long vectors.
        alpha, scale = np.empty((k, len(s)), np.float32), np.empty(len(s), np.float32)
        for j in range(k):
            alpha[j] = emit[j][s]
        e, prior = alpha.copy(), None
        for t in range(len(live)):
            lo, hi = at[t], at[t + 1]
            a, c = alpha[:, lo:hi], scale[lo:hi]
            a *= start[:, None] if t == 0 else on @ prior[:, : hi - lo]
            np.add.reduce(a, 0, out=c)
            a /= c
            prior = a
        like += float(np.log(scale, dtype=np.float64).sum())
        e /= scale  # emission over scale from here on
        beta = np.ones((k, len(rows)), np.float32)
        for t in range(len(live) - 1, 0, -1):
            lo, hi, before = at[t], at[t + 1], at[t - 1]
            b, v = beta[:, : hi - lo], e[:, lo:hi]
            v *= b
            xi += alpha[:, before : before + hi - lo] @ v.T
            alpha[:, lo:hi] *= b
            np.matmul(move, v, out=b)
        alpha[:, : at[1]] *= beta[:, : at[1]]
        alpha /= alpha.sum(0)
        begun += alpha[:, : at[1]].sum(1)
        for j in range(k):
            gamma[:, j] += np.bincount(s, alpha[j], m.size)
    xi *= move
    return gamma, xi, begun, like


def likelihood(sym: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    """log10 of the probability of each row of symbols: scaled forward recursion."""
    out = np.zeros(len(first) - 1)
    size = np.diff(first)
    far = np.flatnonzero(size > 8 * _SEGMENT)
    for i in far:
        out[i] = _long(sym[first[i] : first[i + 1]], m)
    size = size.copy()
    size[far] = 0
    emit, on = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    for rows in _batches(size):
        rows = rows[size[rows] > 0]
        if not len(rows):
            continue
        s, live = _by_time(sym, first, rows)
        at, c, a = np.concatenate([[0], np.cumsum(live)]), np.empty(len(s)), None
        for t, n in enumerate(live):
            i = slice(at[t], at[t + 1])
            a = (m.start[:, None] if t == 0 else on @ a[:, :n]) * emit[:, s[i]]
            np.add.reduce(a, 0, out=c[i])
            a /= c[i]
        out[rows] = np.bincount(text.ragged(np.zeros(len(live), np.int64), live), np.log10(c), len(rows))
    return out


def _long(s: np.ndarray, m: Model) -> float:
    """A long row in segments, each run from every state at once, then chained."""
    k = m.states
    a = m.start * m.emit[s[0]]
    total = float(np.log10(a.sum()))
    a /= a.sum()
    rest = s[1:]
    n = len(rest) // _SEGMENT
    body = rest[: n * _SEGMENT].reshape(n, _SEGMENT)
    runs, logs = np.broadcast_to(np.eye(k), (n, k, k)).copy(), np.zeros((n, k))
    for t in range(_SEGMENT):
        runs = (runs @ m.move) * m.emit[body[:, t]][:, None, :]
        c = runs.sum(2)
        runs /= c[:, :, None]
        logs += np.log10(c)
    for i in range(n):
        top = logs[i].max()
        a = (a * 10 ** (logs[i] - top)) @ runs[i]
        total += top + float(np.log10(a.sum()))
        a /= a.sum()
    for x in rest[n * _SEGMENT :]:
        a = (a @ m.move) * m.emit[x]
        total += float(np.log10(a.sum()))
        a /= a.sum()
    return total


# ---- word counts ---------------------------------------------------------


def _send_counts(blocks: int):
    def go(batches):
        for r in packed.rows(batches):
            h, n = _counted(r)
            out = [(k, r["chunk"], packed.squeeze(h[i], n[i])) for k, i in packed.split(packed.block_of(h, blocks))]
            if out:
                yield packed.frame(packed.BLOB, out)

    return go


def _counted(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a chunk, and how often its training rows hold each."""
    h, first = tokens(packed.text_of(r))
    learn = packed.rest_of(r).column("__learn").to_numpy()
    keys, back = np.unique(h, return_inverse=True)
    return keys, np.bincount(back, np.repeat(learn, np.diff(first)), len(keys)).astype(np.int32)


def _answer_counts(group: pa.Table) -> pa.Table:
    got = [packed.stretch(x.as_py(), np.uint64, np.int32) for x in group.column("blob")]
    keys, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    n = np.bincount(back, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64)
    shared = np.bincount(back, minlength=len(keys)) > 1
    number = np.where(shared, np.cumsum(shared) - 1, -1).astype(np.int32)
    rows, lo = [], 0
    for g, chunk, block in zip(got, group.column("chunk").to_pylist(), group.column("block").to_pylist(), strict=True):
        i = back[lo : lo + len(g[0])]
        rows.append((chunk, block, packed.squeeze(n[i], number[i])))
        lo += len(g[0])
    # By way of a sum: the block's tokens and types.
    rows.append((_SUMS, rows[0][1], packed.squeeze(np.array([n.sum(), (n > 0).sum()], float))))
    return pa.Table.from_batches([packed.frame(packed.REPLY, rows)])


def _partial(batches):
    """The sum of a partition's vectors, as rows of place and value."""
    total = None
    for b in batches:
        for x in b.column(0):
            v = packed.stretch(x.as_py(), np.float64)[0]
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])


def _summed(blobs: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of ``size`` doubles, one a row: by partition, then by place."""
    out = np.zeros(size)
    for r in blobs.mapInArrow(_partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # size rows
        out[r["k"]] = r["v"]
    return out


# ---- Baum-Welch ----------------------------------------------------------


def _by_block(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by block, then hash; each block's number and count of them; and h as places among them."""
    keys, back = np.unique(h, return_inverse=True)
    parts = list(packed.split(packed.block_of(keys, blocks)))
    order = np.concatenate([i for _, i in parts])
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return keys[order], np.array([k for k, _ in parts]), np.array([len(i) for _, i in parts]), place[back]


def _known(block: np.ndarray, found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's words by block: training count in all chunks, and number among the block's shared words (-1: no other chunk has it)."""
    got = [packed.stretch(found[int(k)], np.int64, np.int32) for k in block]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


_STATIC = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("learn", pa.binary()), ("blob", pa.binary()), ("rest", pa.binary())])
_STATIC_DDL = "chunk long, ids binary, sizes binary, learn binary, blob binary, rest binary"
#: Kinds of blobs of a chunk, beside those for blocks 0, 1, ...
_STATS, _LOCAL, _FIRST, _SUMS = -1, -2, -3, -4


def _noise(keys: np.ndarray, states: int) -> np.ndarray:
    """A word's first split over the states, from its hash."""
    x = 0.5 + text.mix((keys[:, None] + np.arange(99, 99 + states, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).ravel()).astype(float).reshape(-1, states) / 2**64
    return (x / x.sum(1, keepdims=True)).astype(np.float16)


def _prepare(blocks: int):
    """A chunk's rows as symbols, with what is known of its words: its text isn't read again."""

    def go(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _STATIC.empty_table()
        r = chunk.to_pylist()[0]
        h, first = tokens(packed.text_of(r))
        learn = packed.rest_of(r).column("__learn").to_numpy(zero_copy_only=False).astype(bool)
        keys, block, count, sym = _by_block(h, blocks)
        total, number = _known(block, dict(zip(replies.column("block").to_pylist(), replies.column("blob").to_pylist(), strict=True)))
        own = np.bincount(sym[np.repeat(learn, np.diff(first))], minlength=len(keys)).astype(np.int32)
        planes = np.ascontiguousarray(sym.view(np.uint8).reshape(-1, 4).T)  # bytes of one weight side by side: they compress
        return pa.Table.from_batches([packed.frame(_STATIC, [(r["chunk"], r["ids"], np.diff(first).astype(np.int64).tobytes(), learn.tobytes(), packed.squeeze(planes.ravel(), total, own, number, block, count), r["rest"])])])

    return go


def _begin(states: int, blocks: int):
    """First splits of a chunk's words, and their counts by state."""

    def go(batches):
        for r in packed.rows(batches):
            words, n = _counted(r)
            keys, _, _, place = _by_block(words, blocks)
            own = np.empty(len(n))
            own[place] = n
            split = _noise(keys, states)
            stats = np.concatenate([np.zeros(states * states + states), (own[:, None] * split.astype(float)).sum(0), [0.0]])
            yield packed.frame(packed.BLOB, [(_FIRST, r["chunk"], packed.squeeze(split.ravel())), (_STATS, r["chunk"], packed.squeeze(stats))])

    return go


def _words(r: dict) -> list[np.ndarray]:
    """Row offsets, whether rows are learnt from, symbols; then of the words total, own, number, and of the blocks number and count."""
    planes, *of_words = packed.stretch(r["blob"], np.uint8, np.int64, np.int32, np.int32, np.int64, np.int64)
    sym = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return [np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], np.int64))]), np.frombuffer(r["learn"], bool), sym, *of_words]


def _mine(replies: pa.Table, number: np.ndarray, block: np.ndarray, states: int) -> np.ndarray:
    """Each word's split over the states: those of shared words by block, and the chunk's own."""
    found = dict(zip(replies.column("block").to_pylist(), replies.column("blob").to_pylist(), strict=True))
    take = lambda k: packed.stretch(found[k], np.float16)[0].reshape(-1, states)
    if _FIRST in found:
        return take(_FIRST)
    out = np.zeros((len(number), states), np.float16)
    out[number < 0] = take(_LOCAL) if _LOCAL in found else 0
    shared = [take(int(k)) for k in block if int(k) in found]
    if shared:
        out[number >= 0] = np.concatenate(shared)
    return out


def _emissions(split: np.ndarray, total: np.ndarray, counts: np.ndarray, mass: float) -> np.ndarray:
    """Emissions of words with ``total`` training counts, which the states have ``counts`` of in all; mass: the unigram's divisor.

    Over all training words and one unknown word they sum to 1 in each state.
    """
    unknown = 0.5 / mass
    unigram = ((total + 0.5) / max(mass - 0.5, 0.5))[:, None]
    own = split.astype(float) * total[:, None] / np.maximum(counts, 1e-300)
    mixed = np.where(counts > 0, (1 - SHARE) * own + SHARE * unigram, unigram)
    return np.where(total[:, None] > 0, (1 - unknown) * mixed, unknown)


def _expect(shared, mass: float):
    def go(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return packed.BLOB.empty_table()
        move, start, under = shared.value
        r, k = chunk.to_pylist()[0], len(start)
        first, learn, sym, total, own, number, block, count = _words(r)
        size = np.diff(first)
        sym, first = sym[np.repeat(learn, size)], np.concatenate([[0], np.cumsum(size[learn])])
        gamma, xi, begun, like = expected(sym, first, Model(_emissions(_mine(replies, number, block, k), total, under, mass), move, start))
        stats = np.concatenate([xi.ravel(), begun, gamma.sum(0), [like]])
        split = (gamma / np.maximum(own, 1)[:, None]).astype(np.float16)
        out, at = [(_STATS, r["chunk"], packed.squeeze(stats)), (_LOCAL, r["chunk"], packed.squeeze(split[number < 0].ravel()))], 0
        for b, n in zip(block, count, strict=True):
            i = at + np.flatnonzero(number[at : at + n] >= 0)
            at += n
            if len(i):
                out.append((int(b), r["chunk"], packed.squeeze(packed.delta(number[i]), own[i], split[i].ravel())))
        return pa.Table.from_batches([packed.frame(packed.BLOB, out)])

    return go


def _answer_rows(states: int):
    """A block's expected counts summed up, each word's as its split over the states, to the chunks that hold the word."""

    def go(group: pa.Table) -> pa.Table:
        got, size = [], 0
        for x in group.column("blob"):
            number, own, split = packed.stretch(x.as_py(), np.int32, np.int32, np.float16)
            got.append((np.cumsum(number), own, split))
            size = max(size, int(got[-1][0][-1]) + 1)
        total = np.zeros((size, states))
        for number, own, split in got:
            total[number] += own[:, None] * split.reshape(-1, states).astype(float)  # a chunk's words are distinct
        split = (total / np.maximum(total.sum(1, keepdims=True), 1e-300)).astype(np.float16)
        rows = [(chunk, block, packed.squeeze(split[number].ravel())) for (number, _, _), chunk, block in zip(got, group.column("chunk").to_pylist(), group.column("block").to_pylist(), strict=True)]
        return pa.Table.from_batches([packed.frame(packed.REPLY, rows)])

    return go


def _free(*frames: DataFrame) -> None:
    """Files of a round that is over go at once."""
    tables.remove(*frames)
    _free_shuffles(frames[0].sparkSession)


def _free_shuffles(spark) -> None:
    """Shuffles of plans that are over go with the driver's objects that hold them."""
    spark.sparkContext._jvm.System.gc()


def _learn_all(chunks: DataFrame, counts: DataFrame, blocks: int, states: int, rounds: int, mass: float) -> tuple[DataFrame, DataFrame, tuple]:
    """Baum-Welch over all words: chunks as symbols, replies (chunk, block, splits of the chunk's words), and moves, first states and the rows' divisors.

    Only words that several chunks hold go through the blocks; a chunk keeps the rest.
    Symbols are dealt by chunk once, so that in a round no more than splits moves; the
    texts and counts that they come from go before the first.
    """
    spark = chunks.sparkSession
    learned = tables.dealt(chunks.groupBy("chunk").cogroup(counts.where("chunk >= 0").groupBy("chunk")).applyInArrow(text.tidy_groups(_prepare(blocks)), _STATIC_DDL), "chunk", "lm-symbols")
    _free(counts)  # and the shuffles of counting and dealing, more than those of a round
    sent = tables.written(chunks.mapInArrow(text.tidy(_begin(states, blocks)), packed.BLOB_DDL), "lm-expected")
    tables.remove(chunks)
    move, start = np.full((states, states), 0.1 / max(1, states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    under, before = _stats(sent, states)[-1 - states : -1], -np.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((move, start, under))
        fresh = tables.written(learned.groupBy("chunk").cogroup(_replies(sent, states).groupBy("chunk")).applyInArrow(text.tidy_groups(_expect(shared, mass)), packed.BLOB_DDL), "lm-expected")
        x = _stats(fresh, states)
        xi, begun, like = x[: states * states].reshape(states, states), x[states * states : states * states + states], float(x[-1])
        move, start, under = (xi + 1) / (xi.sum(1, keepdims=True) + states), (begun + 1) / (begun.sum() + states), x[-1 - states : -1]
        shared.destroy()
        _free(sent)
        sent = fresh
        if like - before < SETTLED * abs(like):
            break
        before = like
    return learned, _replies(sent, states), (move, start, under)


def _replies(sent: DataFrame, states: int) -> DataFrame:
    own = sent.where(F.col("block").isin(_LOCAL, _FIRST)).select("chunk", "block", "blob")
    return sent.where("block >= 0").groupBy("block").applyInArrow(_answer_rows(states), packed.REPLY_DDL).unionByName(own)


def _stats(sent: DataFrame, states: int) -> np.ndarray:
    """Sums over the chunks, of some numbers each: moves, first states, counts by state, likelihood."""
    return _summed(sent.where(F.col("block") == _STATS).select("blob"), states * states + 2 * states + 1)


# ---- scoring -------------------------------------------------------------


def _score_all(shared, schema: pa.Schema, total: int, types: int, states: int):
    """Scores of a chunk's rows, by the splits of its words."""
    mass = total + 0.5 * (types + 1)

    def go(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        r = chunk.to_pylist()[0]
        move, start, under = shared.value
        first, _, sym, known, _, number, block, _ = _words(r)
        c = known[sym]
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        base = np.bincount(row, np.log10(c + 0.5) - np.log10(mass), rows)
        emit = _emissions(_mine(replies, number, block, states), known, under, mass)
        return _scored(r, schema, first, c, row, total, base, likelihood(sym, first, Model(emit, move, start)))

    return go


def _scored(r: dict, schema: pa.Schema, first: np.ndarray, c: np.ndarray, row: np.ndarray, total: int, base: np.ndarray, score: np.ndarray) -> pa.Table:
    rows = len(first) - 1
    rest = packed.rest_of(r).drop_columns(["__learn"])
    ids = np.frombuffer(r["ids"], np.int64)
    out = [pa.array(ids, mask=ids == packed.NULL_ID), *rest.columns, pa.array(np.diff(first)), pa.array(np.bincount(row, c > 0, rows).astype(np.int64)), pa.array(np.full(rows, total)), pa.array(base), pa.array(score)]
    return pa.table([a.cast(f.type) for a, f in zip(out, schema, strict=True)], schema=schema)


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows where ``learn`` holds, score all rows.

    Columns: doc_id, those of carry, n_tokens, n_known, train_tokens, base_score
    (log10 by the smoothed unigram), score (log10 by the model).  Tokens: runs of
    anything but ASCII white space with A-Z lower-cased, then one end.  Null text
    is empty: its one token is the end.  Where ``learn`` is null the row isn't
    learnt from.  Rows that repeat count as often as they occur.  With nothing to
    learn from, all words are unknown and the states stay uniform.
    """
    if clash := set(carry) & {id_col, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "__learn"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("__text"), F.coalesce(learn, F.lit(False)).cast("int").alias("__learn"), *[df[c] for c in carry])
    chunks, blocks = packed.chunked(docs, "lm-chunks", _CHUNK_BYTES)
    counts = tables.written(chunks.mapInArrow(text.tidy(_send_counts(blocks)), packed.BLOB_DDL).groupBy("block").applyInArrow(_answer_counts, packed.REPLY_DDL), "lm-counts")
    total, types = (int(x) for x in _summed(counts.where(F.col("chunk") == _SUMS).select("blob"), 2))
    schema = T.StructType([*docs.drop("__text", "__learn").schema.fields, *T._parse_datatype_string(_OUT).fields])
    learned, rows, model = _learn_all(chunks, counts, blocks, states, rounds if total else 0, total + 0.5 * (types + 1))
    return learned.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(text.tidy_groups(_score_all(spark.sparkContext.broadcast(model), to_arrow_schema(schema), total, types, states)), schema)
