import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, decontamination, hmm, langid, minhash_dedup, sentencepiece_codec, substring_dedup
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    vocab = [word() for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = text(45)
    out = []
    for i in range(n):
        t = text(r.randint(0, 120))
        if r.random() < 0.3:
            t = f"{t} {shared} {text(10)}"
        if i > 5 and r.random() < 0.3:
            w = out[r.randrange(len(out))][1].split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        out.append((i, t.title() if r.random() < 0.1 else t))
    return out + [(n, ""), (n + 1, "... !!"), (n + 2, "one"), (n + 3, "ab " * 3000), (n + 4, shared + " " + shared), (n + 5, shared + "\n\t" + shared)]


def frame(spark, rows):
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


def test_substrings(spark):
    rows = corpus()
    df = frame(spark, [*rows, (len(rows), None)])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(df, carry=("lang",)).collect()}
    assert got == brute.substrings([*rows, (len(rows), None)])


def test_substrings_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], DOC)
    assert substring_dedup.dedup_substrings(empty).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    out = substring_dedup.dedup_substrings(frame(spark, [(1, t), (1, t), (None, t), (2, t)])).collect()
    assert sorted(((r["doc_id"] or 0), r["n_removed"]) for r in out) == [(0, 0), (1, 30), (1, 30), (2, 30)]
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(empty, carry=("doc_id",))


def test_substrings_carry_the_text_once(spark, monkeypatch):
    """The carried text comes back as it was, from the chunk that is parsed: no copy of it travels beside that."""
    rows = [(0, None), (1, ""), (2, " \u00e9\U0001f600 a\tb\n"), *[(i, f"d{i} " + " ".join(f"w{j}" for j in range(40))) for i in range(3, 9)]]
    seen, real = [], substring_dedup.packed.chunked
    monkeypatch.setattr(substring_dedup.packed, "chunked", lambda docs, name: seen.append(docs.columns) or real(docs, name))
    out = substring_dedup.dedup_substrings(frame(spark, rows), carry=("lang", "text", "n_chars"))
    assert out.columns[-3:] == ["lang", "text", "n_chars"] and "text" not in seen[0]
    assert {r["doc_id"]: (r["text"], r["lang"]) for r in out.collect()} == {i: (t, "en") for i, t in rows}


def test_words_of_a_large_chunk_take_little_memory():
    import pyarrow as pa

    rows = [" ".join(f"w{i * j}" for j in range(300)) for i in range(2000)] + ["x" * 700_000 + " y"]
    chunk = next(substring_dedup.text.chunks(pa.array(rows), 1 << 30))
    substring_dedup.text.powers(1)
    tracemalloc.start()
    w = substring_dedup.text.words(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chunk.data) > 3 << 20 and peak < 20 * len(chunk.data)
    one = [h for t in (rows[7], rows[-1]) for h in substring_dedup.text.words(next(substring_dedup.text.chunks(pa.array([t])))).hashes]
    assert one == [*w.hashes[w.first[7] : w.first[8]], *w.hashes[w.first[-2] :]]


@pytest.mark.parametrize("block", [500_000, 40])
def test_contamination(spark, block):
    rows = corpus(2)
    items = [(1, rows[10][1][:200]), (2, rows[64][1][:90]), (3, "one"), (4, ""), (5, None), (None, rows[12][1][:90]), (3, rows[20][1][:150])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(frame(spark, [*rows, (99, None)]), bench, block_windows=block).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out}
    assert got == brute.contamination([*rows, (99, None)], [i for i in items if i[0] is not None])
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out)
    none = decontamination.decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count()
    assert none == 0


def test_near_duplicates(spark):
    rows = corpus(3, 80)
    out = minhash_dedup.near_duplicates(frame(spark, rows), carry=("source",)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute.near(rows)
    assert sum(r["keep"] for r in out) == len({r["class_id"] for r in out})


def test_near_duplicates_of_a_hub(spark):
    """Copies that are near their source but not each other make one class."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(12):
        w = list(base)
        for i in range(4):
            w[r.randrange(200)] = f"x{k}_{i}"
        rows.append((k, " ".join(w)))
    rows += [(600, None), (601, None), (700, " ".join(base)), (700, " ".join(base))]
    out = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    want = brute.near(sorted({x for x in rows if x[1]}))
    assert all(x["class_id"] == min(want[x["doc_id"]], x["doc_id"]) for x in out if x["doc_id"] < 600)
    assert sum(x["keep"] for x in out) == len(set(want.values())) + 2
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("bag", [False, True])
def test_near_duplicates_around_the_threshold(spark, bag):
    """A crowd of copies just above and below the threshold, of which some are linked to each other and not to the text they come from."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(160)]
    rows = [(1000, " ".join(base))]
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(160)] = f"x{k}_{r.randrange(99)}"
        rows.append((k, " ".join(w)))
        if k % 3 == 0:
            w[r.randrange(160)] = f"y{k}"
            rows.append((100 + k, " ".join(w)))
    out = minhash_dedup.near_duplicates(frame(spark, rows), bag=bag).collect()
    want = brute.near(sorted(rows))
    assert {x["doc_id"]: x["class_id"] for x in out} == want and 1 < len(set(want.values())) < len(rows)
    kept = minhash_dedup.distinct_texts(frame(spark, rows), bag=bag, carry=("lang",)).collect()
    assert {x["doc_id"] for x in kept} == set(want.values()) and all(x["text"] == dict(rows)[x["doc_id"]] for x in kept)


def test_bags_tell_repetition_apart(spark):
    rows = [(1, "a b c d e f g " * 40), (2, "a b c d e f g " * 20), (3, "a b c d e f g " * 39)]
    classes = lambda bag: {x["doc_id"]: x["class_id"] for x in minhash_dedup.near_duplicates(frame(spark, rows), bag=bag).collect()}
    assert classes(False) == {1: 1, 2: 1, 3: 1} and classes(True) == {1: 1, 2: 2, 3: 1}
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(frame(spark, rows), carry=("keep",))


def test_signatures_estimate_weighted_similarity():
    h = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = np.zeros(300, np.int64)
    sig = lambda w: minhash_dedup.signatures(row, h, w, 1, 1024)[0]
    a, b = np.ones(300), np.r_[np.full(150, 3.0), np.ones(150)]
    c = np.r_[np.full(150, 0.25), np.ones(150)]
    for x, y in ((a, b), (a, c), (b, c), (a, a)):
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((sig(x) == sig(y)).mean() - want) < 0.06


def test_lm_scores(spark):
    rows = corpus(4)
    df = frame(spark, [*rows, (200, None)])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    out = hmm.score_texts(df, ~held, rounds=2).collect()
    tok = {i: [*brute.spaced((t or "").translate(brute.LOWER)), None] for i, t in [*rows, (200, None)]}
    c = Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, types = sum(c.values()), len(c)
    for r in out:
        w = tok[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    nothing = hmm.score_texts(df, F.lit(False)).collect()
    assert all(r["n_known"] == 0 for r in nothing) and len(nothing) == len(rows) + 1


def test_lm_learns_from_all_documents_in_every_round(spark, monkeypatch):
    likes, real = [], hmm._stats
    monkeypatch.setattr(hmm, "_stats", lambda *a: likes.append(x[-1]) or x if (x := real(*a))[-1] else x)
    df = frame(spark, corpus(4))
    score = lambda n: {r["doc_id"]: r["score"] for r in hmm.score_texts(df.repartition(n, "doc_id"), F.lit(True)).collect()}
    one, many = score(1), score(8)
    assert len(likes) > 4 and all(b > a - 1 for a, b in zip(likes[: len(likes) // 2], likes[1 : len(likes) // 2], strict=False))
    assert all(math.isclose(many[i], one[i], rel_tol=2e-3) for i in one)


def test_lm_rare_words_have_their_own_emissions(spark):
    """Of 72,000 words that occur once, half stand among words of one kind and half among those of another."""
    r = random.Random(5)
    word = lambda kind, i: f"x{2 * i + kind:06d}0"
    common = [[f"{k}{j}" for j in range(12)] for k in ("alpha", "beta")]
    rows = []
    for i in range(600):
        k = i % 2
        w = [word(k, i // 2 * 120 + j) for j in range(120)] + [r.choice(common[k]) for _ in range(120)]
        r.shuffle(w)
        rows.append((i, " ".join(w)))
    held = [(1000 + 2 * n + k, " ".join(x for j in range(30) for x in (common[0][j % 12], word(k, n * 300 + j)))) for n in range(20) for k in (0, 1)]
    out = {x["doc_id"]: x for x in hmm.score_texts(frame(spark, rows + held), F.col("doc_id") < 1000).collect()}
    assert all(out[i]["n_known"] == out[i]["n_tokens"] for i in range(1000, 1040))
    assert sum(out[1000 + 2 * n]["score"] - out[1001 + 2 * n]["score"] for n in range(20)) / 20 > 5
    assert math.isclose(out[1000]["base_score"], out[1001]["base_score"], rel_tol=1e-9)


def brute_hmm(train, every, states, rounds):
    """Baum-Welch in plain loops, from the same first split; log10 of each text's probability."""
    words = list(dict.fromkeys(w for t in train for w in t))
    at = {w: i for i, w in enumerate(words)}
    n = Counter(w for t in train for w in t)
    mass = sum(n.values()) + 0.5 * (len(words) + 1)
    unigram = {w: (n[w] + 0.5) / (mass - 0.5) for w in words}
    gamma = np.array([n[w] * hmm._noise(np.array([word_hash(w)]), states)[0].astype(float) for w in words])
    move, start = np.full((states, states), 0.1 / (states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.9)
    emit = lambda w, g, u: (1 - 0.5 / mass) * ((1 - hmm.SHARE) * g[at[w]] / u + hmm.SHARE * unigram[w]) if w in at else np.full(states, 0.5 / mass)
    rows = lambda t, g, u: np.array([emit(w, g, u) for w in t])
    for _ in range(rounds):
        under, fresh, xi, begun = gamma.sum(0), np.zeros_like(gamma), np.zeros((states, states)), np.zeros(states)
        for t in train:
            e, alpha, scale = rows(t, gamma, under), [], []
            for i in range(len(t)):
                a = (start if i == 0 else alpha[-1] @ move) * e[i]
                scale.append(a.sum())
                alpha.append(a / a.sum())
            beta = np.ones(states)
            for i in range(len(t) - 1, -1, -1):
                g = alpha[i] * beta
                fresh[at[t[i]]] += g / g.sum()
                if i:
                    v = e[i] * beta / scale[i]
                    xi += np.outer(alpha[i - 1], v) * move
                    beta = move @ v
                else:
                    begun += g / g.sum()
        gamma, move, start = fresh, (xi + 1) / (xi.sum(1, keepdims=True) + states), (begun + 1) / (begun.sum() + states)
    under, out = gamma.sum(0), []
    for t in every:
        a, total = None, 0.0
        for i, e in enumerate(rows(t, gamma, under)):
            a = (start if i == 0 else a @ move) * e
            total += math.log10(a.sum())
            a = a / a.sum()
        out.append(total)
    return out


def word_hash(w):
    if w is None:
        return hmm.END
    import pyarrow as pa

    return hmm.text.words(next(hmm.text.chunks(pa.array([w]))), hmm.text.SPACED, hmm.text.LOWER).hashes[0]


@pytest.mark.parametrize("parts", [1, 5])
def test_lm_scores_equal_plain_baum_welch(spark, parts):
    """Of words that one chunk alone holds (one part), and of those that several do."""
    rows = corpus(14, 40)[:42]
    df = frame(spark, [*rows, (200, None), (201, rows[3][1]), (201, rows[3][1])]).repartition(parts, "doc_id")
    learn = F.col("doc_id") % 3 != 1
    tok = lambda t: [*brute.spaced((t or "").translate(brute.LOWER)), None]
    texts = {**dict(rows), 200: None, 201: rows[3][1]}
    train = [tok(t) for i, t in texts.items() if i % 3 != 1] + [tok(rows[3][1])] * (201 % 3 != 1)
    want = dict(zip(texts, brute_hmm(train, [tok(t) for t in texts.values()], 3, 4), strict=True))
    out = hmm.score_texts(df, learn, states=3, rounds=4).collect()
    assert len(out) == 45 and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=4e-3) for r in out)


def test_lm_holds_symbols_alone_in_its_rounds(spark, monkeypatch):
    """Texts and word counts go before the first round, symbols move without a shuffle, and long rows among short ones have the same likelihood both ways."""
    place = hmm.tables.shared_dir(spark).removeprefix("file:")
    kinds = lambda: {x for x in os.listdir(place) if x.startswith(("lm-chunks", "lm-counts"))}
    old, held, plans, real = kinds(), [], [], hmm._expect
    monkeypatch.setattr(hmm, "_expect", lambda *a: held.append(kinds() - old) or real(*a))
    dealt = hmm.tables.dealt
    monkeypatch.setattr(hmm.tables, "dealt", lambda *a: plans.append(x := dealt(*a)) or x)
    assert hmm.score_texts(frame(spark, corpus(4)), F.lit(True), rounds=2).count() == 66
    assert held == [set(), set()]
    plan = plans[0].groupBy("chunk").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    r = np.random.default_rng(1)
    first, m = np.array([0, 900, 905, 905, 1200]), hmm.Model(*(r.dirichlet(np.ones(n), k) for n, k in ((4, 9), (4, 4))), r.dirichlet(np.ones(4)))
    s = r.integers(0, 9, 1200).astype(np.uint32)
    gamma, xi, begun, like = hmm.expected(s, first, m)
    assert math.isclose(like, math.log(10) * hmm.likelihood(s, first, m).sum(), rel_tol=1e-5)
    assert np.allclose([gamma.sum(), xi.sum(), begun.sum()], [1200, 1197, 3], rtol=1e-4)


def test_lm_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOC)
    assert hmm.score_texts(empty, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hmm.score_texts(empty, F.lit(True), carry=("score",))


def test_forward_recursion_is_a_distribution_and_long_rows_agree(monkeypatch):
    r = np.random.default_rng(0)
    total, split = np.array([30, 20, 1, 9, 0]), r.dirichlet(np.ones(3), 5)
    mass = total.sum() + 0.5 * (4 + 1)
    emit = hmm._emissions(split, total, (split * total[:, None]).sum(0), mass)
    assert np.allclose(emit.sum(0), 1) and np.allclose(emit[4], 0.5 / mass)
    assert np.allclose(hmm._emissions(np.zeros((5, 3)), total, np.zeros(3), mass).sum(0), 1)
    m = hmm.Model(emit, r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(3)))
    s = np.array([(i, j) for i in range(m.size) for j in range(m.size)], np.uint16).ravel()
    like = hmm.likelihood(s, np.arange(0, len(s) + 1, 2), m)
    assert math.isclose((10**like).sum(), 1, rel_tol=1e-9)
    s = r.integers(0, m.size, 500).astype(np.uint16)
    whole = hmm.likelihood(s, np.array([0, 500]), m)[0]
    monkeypatch.setattr(hmm, "_SEGMENT", 16)
    assert math.isclose(hmm.likelihood(s, np.array([0, 500]), m)[0], whole, rel_tol=1e-9)
    before = -1e18
    for _ in range(5):
        g, x, b, ll = hmm.expected(s, np.array([0, 200, 500]), m)
        assert ll > before - 1 and math.isclose(g.sum(), 500, rel_tol=1e-4)
        before = ll
        m = hmm.Model((g + 1e-3) / (g + 1e-3).sum(0), (x + 1) / (x.sum(1, keepdims=True) + 3), (b + 1) / (b.sum() + 3))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lm_beats_the_unigram_on_texts_that_it_did_not_learn(spark, sf):
    """As registered: over all held-out texts, over those with unknown words and over those without."""
    out = queries.op1_lm_scoring(spark, f"/root/testdata/{sf}").where("held_out").toPandas()
    for part in (out, out[out.n_known < out.n_tokens], out[out.n_known == out.n_tokens]):
        assert len(part) > 2 and part.score.sum() > part.base_score.sum() + 0.1 * part.n_tokens.sum()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_symbols")]



def test_sentencepiece_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(9)
    texts = [t for _, t in corpus(6)] + ["", " ", "Hello  world", " a\n b\tc ", "日本😀x", "<s> <0x41>", "a" * 700, "Ⅻ ﬁ"]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FFF), 32])) for _ in range(r.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(2)
    out = {x["doc_id"]: x for x in sentencepiece_codec.encode(df).collect()}
    for i, t in enumerate([*texts, None]):
        assert out[i]["ids"] == sp.encode(t or "") and out[i]["n_tokens"] == len(out[i]["ids"]) and out[i]["round_trip"]
    back = {x["doc_id"]: x["text"] for x in sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))


def test_unigram_viterbi_equals_the_library(tmp_path):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sentencepiece_codec.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = -2.0 - (zlib.crc32(p.piece.encode()) % 100_003) / 9000
    lib, own = sp.SentencePieceProcessor(model_proto=m.SerializeToString()), sentencepiece_codec.Codec(m.SerializeToString())
    words = sorted({"▁" + w for w in re.findall(r"\w+", "the quick brown foxes were jumping over thousands of lazy dogs internationally")})
    for w, ids in zip(words, own.encode_sorted(words), strict=True):
        assert ids == lib.encode(w[1:])


def test_language_id(spark):
    r = random.Random(3)
    syl = {"aa": ["the", "ing", "th", "wh"], "bb": ["sch", "ung", "ein", "ä"], "cc": ["ñ", "ción", "los", "os"]}
    rows = []
    for i in range(240):
        lang = r.choice(list(syl))
        rows.append((i, " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 ... !", "bb"), (903, "sch ung", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df, F.col("doc_id") % 4 != 2)
    out = {x["doc_id"]: x for x in langid.identify(df, net).collect()}
    held = [(i, lang) for i, _, lang in rows[:240] if i % 4 == 2]
    assert sum(out[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= x["score"] <= 1 for x in out.values())
    none = langid.identify(df, langid.train(df, F.lit(False))).select("lang_pred").distinct().collect()
    assert [x[0] for x in none] == ["und"]
