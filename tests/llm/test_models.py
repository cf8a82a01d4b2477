"""Trained operators: held-out quality, proper probabilities, gradients, odd rows; the pipeline."""

import re
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, by, docs_of, odd

from tessera.llm import common, langid, mixing, queries, toxicity


def test_lm_scores(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    got = by(queries.op1_lm_scoring(spark, sf_dir))
    c = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            c.update(mixing.tokens(t))
            c[mixing.END] += 1
    total, distinct = sum(c.values()), len(c)
    for i, t in docs:
        tok = [*mixing.tokens(t), mixing.END]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok), sum(c[w] > 0 for w in tok), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        want = sum(np.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tok)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        nats = -r.score * np.log(10)
        assert r.bits_per_byte is None if not r.n_bytes else abs(r.bits_per_byte - nats / np.log(2) / r.n_bytes) < 1e-9
    held = [r for r in queries.op1_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_lm_odd(spark):
    for rows in (ODD, [(1, None)], [(0, "a b"), (None, "a"), (0, "a b")]):
        got = mixing.score_texts(odd(spark, rows), common.remainder("doc_id", 10) != 0).collect()
        assert len(got) == len(rows) and all(np.isfinite(r.score) and r.score <= 0 for r in got)
        same = {r.score for r in got if r.doc_id == 0}
        assert len(same) <= 1
    assert mixing.score_texts(odd(spark, []), common.remainder("doc_id", 10) != 0).count() == 0


@pytest.fixture(scope="module")
def lm(spark, sf_dir):
    """(model, what scoring needs beside it, speller, word counts, coded texts) of the smallest table."""
    common.ship(spark)
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", (common.remainder("doc_id", 10) != 0).alias("learnable"))
    texts = src.where("learnable").select("text")
    counts = common.written(mixing.word_counts(texts, mixing.start_kinds(texts)), "counts")
    code, rest = mixing.code_of(counts)
    speller = mixing.learn_speller(counts.where("n = 1"), rest["once"])
    coded = mixing.coded_texts(src, counts, rest, speller)
    return mixing.learn_model(coded, code, rest["total"])[0], rest, speller, counts, coded


def test_code(lm):
    """A prefix code over all units, and units whose counts are those of the words."""
    model, rest, _, counts, _ = lm
    code = model.code
    for k in range(mixing.KINDS):
        paths = [tuple(code.steps[f : f + s].tolist()) for f, s in zip(code.first[k], code.size[k], strict=True)]
        assert len(set(paths)) == len(paths) and abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-9
        assert len({p[-1] >> 1 for p in paths if p}) == 1  # all begin at the root (paths are listed from the leaf)
    n = {bytes(r.word): r for r in counts.collect()}
    for w, c in zip(rest["words"], rest["n"], strict=True):
        assert n[w].n == c >= mixing.LEAST_COUNT and sum(n[w].by_kind) == c
    left = [r for r in n.values() if r.word not in set(rest["words"])]
    for (kind, size), (_, total) in rest["groups"].items():
        assert total == sum(r.n for r in left if r.kind == kind and r.n.bit_length() - 1 == size)


def test_encoding_by_hand(lm):
    """A text's units: its own words, groups with shares, repeats, spelled words; and without its own counts."""
    model, rest, speller, counts, _ = lm
    rows = {bytes(r.word): r for r in counts.collect()}
    known = set(rest["words"])
    rare = sorted(w for w in rows if w not in known)
    once, twice, new = next(w for w in rare if rows[w].n == 1), next(w for w in rare if rows[w].n == 2), b"qqqzzz"
    end, X = rest["words"].index(mixing.END), mixing.OTHER
    units, own = np.array([X, 3, X, X, X, X, end], np.uint16), np.array([0, 2, 0, 1, 2], np.uint32)
    n, kind = np.array([1, 2, 0]), np.array([rows[once].kind, rows[twice].kind, 0])
    none = np.array([end], np.uint16), np.empty(0, np.uint32)
    size, n_known, base, spelt, coded, places, instead = mixing.encode([units, none[0], units], [own, none[1], own], np.array([True, True, False]), n, kind, [new], rest, speller)
    group = lambda w: rest["groups"][rows[w].kind, rows[w].n.bit_length() - 1]
    want = [group(once)[0], 3, rest["spelled"], rest["again"], group(twice)[0], rest["again"], end]
    assert [np.frombuffer(c, np.uint16).tolist() for c in coded] == [want, [end], want]
    spelled = np.log(1 / group(once)[1]) + speller.log_prob([new])[0] + np.log(1 / 2) + np.log(2 / group(twice)[1]) + np.log(1 / 4)
    assert np.allclose(spelt, [spelled, 0, spelled]) and size.tolist() == [7, 1, 7] and n_known.tolist() == [5, 1, 5]
    c = [1, rest["n"][3], 0, 1, 2, 0, rest["n"][end]]
    assert np.allclose(base[0], sum(np.log10((x + 0.1) / (rest["total"] + 0.1 * (rest["distinct"] + 1))) for x in c))
    left = {0: rest["spelled"], 4: rest["groups"].get((rows[twice].kind, 0), (rest["spelled"],))[0]}
    assert dict(zip(np.frombuffer(places[0], np.uint32).tolist(), np.frombuffer(instead[0], np.uint16).tolist(), strict=True)) == {k: v for k, v in left.items() if v != want[k]}
    assert places[1:] == [b"", b""] == instead[1:]


def test_blocks(spark):
    """Tokens as numbers of a block's words; kinds of a block's texts by a plain loop."""
    texts = ["The cat  THE", None, "", "a\tb\x0bc", "é ñ É"]
    block = mixing.Block(texts)
    assert [[block.words[int(c)].as_py() for c in block.codes[f : f + s]] for f, s in zip(block.first, block.size, strict=True)] == [[*mixing.tokens(t), mixing.END] for t in texts]
    kinds = mixing.Kinds([mixing.tokens(t) for t in ["a b c", "the cat", "the dog", "a b d"]])
    assert kinds.of(block).tolist() == [int((kinds.log_w + kinds.log_p @ kinds.vector(mixing.tokens(t))).argmax()) for t in texts]


def test_kinds_come_from_all_texts(spark, monkeypatch):
    """Pairs of cells are those of a plain loop over every text, whatever the tasks; two vocabularies are told apart however
    many copies and odd rows there are, and the cell of a word is that of a plain loop over its bytes."""
    rng = np.random.default_rng(4)
    vocabulary = [[f"{c}{i}" for i in range(40)] for c in ("left", "r\u00efght")]
    rows = [" ".join(rng.choice(vocabulary[k % 2], 30)) for k in range(1700)] + ["same text again"] * 300 + [None, "", "one", "a " + 5_000 * "b"]
    taken = []
    monkeypatch.setattr(mixing, "Kinds", lambda pairs, real=mixing.Kinds: taken.append(pairs) or real(pairs=pairs))
    kinds = mixing.start_kinds(spark.createDataFrame([(t,) for t in rows], "text string").repartition(5))
    assert [mixing.start_kinds(spark.createDataFrame(some, "text string")).log_w.shape for some in ([], [(None,)])] == [(mixing.KINDS,)] * 2

    def cell(word):
        if len(word) > mixing.LONG:
            return zlib.crc32(word) % mixing.CELLS
        known = 0
        for i, b in enumerate(word):
            known = (known + (b + 1) * pow(0x9E3779B97F4A7C15, i + 1, 2**64)) % 2**64
        return ((known ^ known >> 32) * 0x9E3779B97F4A7C15 % 2**64 >> 32) % mixing.CELLS

    want = np.zeros((mixing.CELLS, mixing.CELLS))
    for t in rows:
        x = np.bincount([cell(w) for w in mixing.tokens(t)], minlength=mixing.CELLS)
        want += np.outer(x, x) / max(1, x.sum() - 1) if x.sum() > 1 else 0
    assert np.allclose(taken[0], want, rtol=1e-5)
    got = kinds.of(mixing.Block(rows[:1700]))
    assert not set(got[::2]) & set(got[1::2])


def test_slots_hold_all_training_texts(lm):
    """Slots are filled by every training text, those that taught the weights too: by a plain loop over all of them."""
    model, _, _, _, coded = lm
    zero_one = np.zeros((2 << (model.bits + 1)), np.int64)
    for r in coded.where("learnable").select("units", "places", "instead").collect():
        units = np.frombuffer(r.units, np.uint16).copy()
        units[np.frombuffer(r.places, np.uint32)] = np.frombuffer(r.instead, np.uint16)
        known = np.zeros((1, mixing.KINDS))
        for begin, end in mixing.spans([units]):
            e = mixing.Events(model.code, model.bits, [units], begin, end, known)
            np.add.at(zero_one, 2 * e.last + e.bit.astype(np.int64), 1)
            np.add.at(zero_one, 2 * e.pair + e.bit[e.upper].astype(np.int64), 1)
    n0, n1 = zero_one[::2], zero_one[1::2]
    st = np.clip(np.rint(np.log((n1 + mixing.DELTA) / (n0 + mixing.DELTA)) * 15), -120, 120)
    sure = sum((n0 + n1 >= k).astype(int) for k in (1, 4, 64))
    assert (model.slots == np.rint(st * (sure / 3.0))).all() and coded.where("tuning and learnable").count() > 5


def mixed32(x):
    x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
    x = (x ^ x >> 13) * 0x297A2D39 % 2**32
    return x


def scored_by_loop(model, doc):
    """The score of one document, bit by bit."""
    code, K = model.code, mixing.PREDICTORS
    bounds = mixing.chunk_bounds(len(doc)).tolist()
    shift, hits = np.zeros(K), {}
    own, nats, post, kind = Counter(), 0.0, np.array(code.log_w, float), int(np.argmax(code.log_w))
    begin = 0
    for end in bounds:
        chunk = doc[begin:end].tolist()
        if not chunk:
            break
        pull, events, met, bits = np.zeros(K), 0, [], []
        for place, u in enumerate(chunk, begin):
            one = int(doc[place - 1]) + 1 if place else 0
            two = int(doc[place - 2]) + 1 if place > 1 else 0
            for at in code.steps[code.first[kind, u] : code.first[kind, u] + code.size[kind, u]].tolist():
                node, bit = at >> 1, float(at & 1)
                h = node * 0x9E3779B1 % 2**32
                last = mixed32((h + one * 0x85EBCA77) % 2**32)
                pair = mixed32((h + one * 0x85EBCA77 + two * 0xC2B2AE3D + 1) % 2**32)
                slot = mixed32(h) >> 32 - mixing.OWN_BITS
                prior = 1 / (1 + np.exp(-float(code.plain[node])))
                x = [float(code.plain[node]), model.slots[last >> 32 - model.bits] / 15, model.slots[(pair >> 32 - model.bits) + (1 << model.bits)] / 15 if code.level[node] < 2 else 0.0]
                x.append(np.log((own[slot, 1] + mixing.OWN_PULL * prior) / (own[slot, 0] + mixing.OWN_PULL * (1 - prior))))
                x = np.array([*x, 0.3])
                n = own[slot, 0] + own[slot, 1]
                gate = code.level[node] * mixing.SEEN + (n > 0) + (n > 3) + (n > 15)
                s = np.clip((model.start.weights[:, gate] + shift) @ x, 0.01 - mixing.SPREAD, mixing.SPREAD - 0.01)
                p = 1 / (1 + np.exp(-s))
                pull, events = pull + (bit - p) * x, events + 1
                cell = (s + mixing.SPREAD) * (mixing.BUCKETS - 1) / (2 * mixing.SPREAD)
                low = int(cell)
                table = lambda j: (model.start.map[code.level[node], j] * mixing.MAP_CALM + hits.get((code.level[node], j), [0, 0])[1]) / (mixing.MAP_CALM + hits.get((code.level[node], j), [0, 0])[0])  # noqa: B023, E731
                p = 0.5 * p + 0.5 * (table(low) + (cell - low) * (table(low + 1) - table(low)))
                nats += np.log(p if bit else 1 - p)
                met.append(((code.level[node], low + (cell - low >= 0.5)), bit))
                bits.append((slot, int(bit)))
        shift = np.clip(shift + mixing.RATE * pull / (events + mixing.CALM), -mixing.MOST_SHIFT, mixing.MOST_SHIFT)
        for cell, bit in met:
            hits.setdefault(cell, [0, 0])
            hits[cell][0] += 1
            hits[cell][1] += bit
        own.update(bits)
        post += code.log_p[chunk].sum(axis=0)
        kind = int(post.argmax())
        begin = end
    return nats


def test_scores_against_a_loop(lm):
    """Documents side by side get the scores of a loop over their bits, whatever stands beside them."""
    model, *_, coded = lm
    docs = [d for d in (np.frombuffer(r.units, np.uint16) for r in coded.where("not learnable").collect()) if len(d) < 600][:8]
    got = mixing.walk_all(docs, model.walk)
    assert np.allclose(got, [scored_by_loop(model, d) for d in docs], rtol=1e-3)
    assert np.allclose(got, [mixing.walk_all([d], model.walk)[0] for d in docs], rtol=1e-5)
    assert (got < 0).all()


def test_long_documents_go_span_by_span(lm, monkeypatch):
    """A document's score doesn't depend on how many tokens are held at a time, nor do its tokens on how it is read."""
    model = lm[0]
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 5, 900, 9000)]
    want = model.walk(docs)
    for most in (1, 700):
        monkeypatch.setattr(mixing, "SPAN_TOKENS", most)
        assert len(list(mixing.spans(docs))) > 3 and np.allclose(model.walk(docs), want, rtol=1e-6)
    text = "one two\tthree  four" * 50
    for size in (1, 7, 64):
        assert [w for p in mixing.parts_of(text, size) for w in mixing.tokens(p)] == mixing.tokens(text)
    assert np.allclose(lm[2].log_prob([b"ab" * 40_000, b"cat"])[1], lm[2].log_prob([b"cat"])[0])


def test_mixed_bits_are_a_distribution(lm):
    """Over all units that may stand first in a text the mixed bits' probabilities sum to 1."""
    model = lm[0]
    total = sum(np.exp(mixing.walk_all([np.array([u], np.uint16)], model.walk)[0]) for u in range(model.code.size.shape[1]))
    assert abs(total - 1) < 1e-3


def test_mixing_makes_the_score(lm):
    """On held-out texts the mixed bits do better than the nodes' counts alone, and weights that move do better still."""
    model, *_, coded = lm
    docs = [np.frombuffer(r.units, np.uint16) for r in coded.where("not learnable").collect()]
    plain = 0.0
    for d in docs:
        e = mixing.Events(model.code, model.bits, [d], 0, len(d), np.zeros((1, mixing.KINDS)))
        st = model.code.plain[e.node].astype(float)
        plain -= np.log1p(np.exp(np.where(e.bit > 0, -st, st))).sum()
    assert mixing.walk_all(docs, model.walk).sum() > plain


def test_spelling(lm):
    """Over all next bytes after a prefix the spelled bits' probabilities sum to 1; likely words are likelier."""
    speller = lm[2]
    p = 0.0
    for v in range(256):
        bit, _, gate, s, cell, _ = speller._mix([b"th" + bytes([v])])
        at = slice(16, 24)
        low = cell[at].astype(int)
        q = 0.5 / (1 + np.exp(-s[at])) + 0.5 * (speller.start.map[gate[at], low] + (cell[at] - low) * (speller.start.map[gate[at], low + 1] - speller.start.map[gate[at], low]))
        p += np.where(bit[at] > 0, q, 1 - q).prod()
    assert abs(p - 1) < 1e-3
    assert speller.log_prob([b"thention"])[0] > speller.log_prob([b"xqzkvwjj"])[0] and len(speller.log_prob([])) == 0
    long = speller.log_prob([b"a" * 5000, b"the"])
    assert np.isfinite(long).all()


def test_language_gradient():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.random.default_rng(0).integers(97, 110, (4, 5)).astype(np.uint8)
    label = np.array([0, 1, 2, 1])
    grad = net.gradient(data, label)[1]
    for k, w in net.p.items():
        at = (1, int(data[0, 2]), 2) if k == "x" else tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = net.gradient(data, label)[0]
        w[at] -= 2e-5
        down = net.gradient(data, label)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6


def test_language_spans_equal_training_pass():
    """The lockstep reader and the training pass agree on one span."""
    net = langid.Network(["a", "b"])
    texts = [b"hello world", b"abc", b""]
    got = net.texts(texts, span=64)
    for t, p in zip(texts[:2], got, strict=False):
        loss, _ = net.gradient(np.frombuffer(t, np.uint8)[None], np.array([0]))
        one = net.texts([bytes([c]) for c in t], span=64)
        assert np.isclose(p.sum(), 1, atol=1e-5) and one.shape == (len(t), 2) and loss > 0
    assert np.allclose(net.texts(texts, lanes=1), net.texts(texts), atol=1e-6) and not got[2].any()


def test_languages(spark, sf_dir):
    got = by(queries.op9_language_id(spark, sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang]
    assert all(got[r.doc_id].held_out for r in held) and len(got) == len(rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.9


def test_languages_by_hand(spark, sf_dir):
    """The registered query's labels and scores against a reader that goes byte by byte."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.learn(docs, common.remainder("doc_id", 5) != 0)
    got = by(queries.op9_language_id(spark, sf_dir))
    sig = lambda v: 1 / (1 + np.exp(-v))
    H, p = net.hidden, {k: v.astype(float) for k, v in net.p.items()}
    for i, t in [x for x in docs_of(spark, sf_dir) if len(x[1] or "") < 700][:40]:
        raw = (t or "").encode()
        total = np.zeros(len(net.labels))
        for at in range(0, len(raw), langid.SPAN):
            span = raw[at : at + langid.SPAN]
            states = []
            for d, order in ((0, range(len(span))), (1, range(len(span) - 1, -1, -1))):
                h, own = np.zeros(H), {}
                for k in order:
                    a, g = p["x"][d][span[k]], p["u"][d] @ h
                    z, r = sig(a[:H] + g[:H]), sig(a[H : 2 * H] + g[H : 2 * H])
                    c = np.tanh(a[2 * H :] + r * (g[2 * H :] + p["c"][d][:, 0]))
                    h = (1 - z) * c + z * h
                    own[k] = h
                states.append(own)
            for k in range(len(span)):
                e = np.exp(p["o"][0] @ states[0][k] + p["o"][1] @ states[1][k] + p["b"][:, 0])
                total += e / e.sum()
        if any(map(str.isalpha, t or "")):
            prob = total / len(raw)
            assert abs(prob[net.labels.index(got[i].lang_pred)] - prob.max()) < 1e-4 and abs(got[i].score - prob.max()) < 1e-4
        else:
            assert got[i].lang_pred == "und"


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(300)] + [(900, "zzqx qzx xqz qqz", "zz"), (901, None, "xx"), (902, "123", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.learn(docs, F.lit(True), sample=20)
    assert net.labels == ["en", "zz"]


def test_languages_odd(spark):
    docs = odd(spark).selectExpr("doc_id", "text", "'en' as lang", "id", "h")
    got = by(langid.predict(docs, langid.learn(docs, common.remainder("doc_id", 5) != 0)))
    for i, t in ODD:
        assert (got[i].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= got[i].score <= 1
    assert by(langid.predict(docs, None))[8].lang_pred == "und"
    assert langid.learn(docs.limit(0), common.remainder("doc_id", 5) != 0) is None


def test_toxicity(spark, sf_dir):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    yes = [r.score for r in got if r.toxic]
    no = [r.score for r in got if not r.toxic]
    assert np.mean([a > b for a in yes for b in no]) > 0.7
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for sheet in (labels, labels.limit(0)):
        model = toxicity.learn(odd(spark), sheet, common.remainder("doc_id", 4) != 2)
        got = toxicity.score(odd(spark), model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark, []), model).count() == 0


def test_isotonic_never_falls():
    for k in range(60):
        rng = np.random.default_rng(k)
        s = np.round(rng.normal(size=400 + 40 * k), 1 + k % 3)
        y = (rng.random(len(s)) < 1 / (1 + np.exp(-s))).astype(float)
        at, value = toxicity.isotonic(s, y)
        assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all() and value.min() >= 0 and value.max() <= 1
        plain = np.interp(s, at, value)
        assert abs(plain.mean() - y.mean()) < 0.02


def test_toxicity_features_by_hand():
    """Counts of a text against plain loops; hits beyond the ten-thousandth count like any other."""
    lexicon = toxicity.Lexicon({"vile": 2.0, "vile*": 1.5, "scum*": 1.0})
    text = "You VILE vilest thing!! sc0ummy v1le AAA " + "word " * 12_000 + "vile you"
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = len(words)
    hits = [i for i, w in enumerate(words) if w == "vile" or (len(w) > 4 and w.startswith(("vile", "scum")))]
    people = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    assert f["word_density"] == 1000 * words.count("vile") / n and f["word_odds"] == 2.0 and f["stem_odds"] == 1.5
    assert f["second_person_near"] == sum(any(abs(i - p) <= toxicity.NEAR for p in people) for i in hits) == 3
    assert f["second_person"] == 1000 * len(people) / n and f["capitals"] == sum(map(str.isupper, text)) / len(text)
    assert f["obfuscated_hits"] == 1 and f["exclamation"] == 2000 / len(text)
    many = "vile you " * 15_000
    assert dict(zip(toxicity.FEATURES, toxicity.features(many, lexicon), strict=True))["second_person_near"] == 15_000


def test_toxicity_scores_by_hand(spark):
    """The registered query's scores: trees walked node by node, calibration by plain interpolation."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), common.remainder("doc_id", 4) != 2)
    got = by(queries.op2_toxicity(spark, "/root/testdata/sf0.01"))
    for i, t in docs_of(spark, "/root/testdata/sf0.01"):
        x = toxicity.features(t, model.lexicon)
        total = model.trees.base
        for feature, cut, leaf in model.trees.trees:
            node = 0
            for level in range(toxicity.DEPTH):
                j = feature[level][node]
                code = sum(e < x[j] for e in model.trees.edges[j]) if j >= 0 else 0
                node = 2 * node + (1 if j >= 0 and code > cut[level][node] else 0)
            total += leaf[node]
        k = sum(a <= total for a in model.at)
        if k in (0, len(model.at)):
            want = model.value[max(0, k - 1)]
        else:
            want = model.value[k - 1] + (total - model.at[k - 1]) / (model.at[k] - model.at[k - 1]) * (model.value[k] - model.value[k - 1])
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_isotonic():
    at, value = toxicity.isotonic(np.array([0.1, 0.4, 0.3, 0.9, 0.8]), np.array([0, 1, 0, 1, 0]))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    s = toxicity.Trees().fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((s > 0) == (y[2000:] > 0)).mean() > 0.93


def test_pipeline_stages(spark, sf_dir):
    """Each stage against brute force or its operator's own verdicts on the stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        columns = docs.columns
        docs = common.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id for r in docs.collect()})
    before, after = kept["language_id"]
    assert after == {i for i, t in before if any(map(str.isalpha, t or ""))}
    before, after = kept["simhash_near_dedup"]
    assert after == {c for _, c in brute.simhash(before).values()}
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert after == {i for i, x in brute.contamination(before, items).items() if not x[4]}
    before, after = kept["toxicity"]
    assert len(after) > 0.75 * len(before)
    pieces = corpus_pipeline.packed(spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == kept["decontamination"][1]


@pytest.mark.parametrize("rows", [[], [(1, "one two three four"), (1, "one two three four"), (None, "one two three four"), (None, "alone here it is"), (None, "alone here it is"), (2, None), (3, "...")]])
def test_pipeline_odd(spark, sf_dir, rows):
    docs = odd(spark, rows)
    out = corpus_pipeline.distinct(spark, docs, sf_dir).collect()
    got = sorted((r.doc_id or -1, r.text or "") for r in out)
    want = [(-1, "alone here it is"), (1, "one two three four"), (2, ""), (3, "...")] if rows else []
    assert got == want
    left = corpus_pipeline.decontaminated(spark, docs, sf_dir)
    assert left.count() == len(rows) and left.columns == docs.columns


def test_pipeline_keeps_clean_rows(spark, sf_dir):
    """Rows are known by doc_id and text: a shared or missing doc_id costs no other document."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r.text or "").split()) >= 10)
    clean = [(None, "a clean text without an id"), (None, "one more of these"), (7, "seven is clean here"), (8, "eight"), (9, None)]
    left = corpus_pipeline.decontaminated(spark, odd(spark, [*clean, (None, item), (7, item)]), sf_dir)
    assert sorted(((r.doc_id or -1, r.text or "") for r in left.collect())) == sorted((i or -1, t or "") for i, t in clean)

    got = corpus_pipeline.distinct(spark, odd(spark, [(3, "a b c d"), (5, "a b c d"), (5, "wholly other words here")]), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, "a b c d"), (5, "wholly other words here")]
    # rows without an id: one of each group of near copies, none where the group has an id
    own = " ".join(f"w{k}" for k in range(400))
    near = {t: brute.fingerprint_of(t) for t in (own.replace("w200", "w200" + "x" * k) for k in range(60))}
    a, b = next((a, b) for a in near for b in near if 0 < (near[a] ^ near[b]).bit_count() <= 2)
    got = corpus_pipeline.distinct(spark, odd(spark, [(None, a), (None, b), (None, "far off")]), sf_dir).collect()
    assert sorted(r.text for r in got) == sorted([min(a, b), "far off"])
    assert [r.doc_id for r in corpus_pipeline.distinct(spark, odd(spark, [(None, a), (8, b)]), sf_dir).collect()] == [8]

    rows = [(1, "apples and pears on the table"), (2, "apples and pears on the table"), (2, "some wholly other words stand here"), (2, "some wholly other words stand here"), (3, "x y z"), (3, "u v w"), (None, "apples and pears on the table"), (None, "alone here it is"), (None, "alone here it is"), (None, "k l m")]
    got = corpus_pipeline.distinct(spark, odd(spark, rows), sf_dir)
    assert got.columns == odd(spark, []).columns
    want = [(1, rows[0][1]), (2, rows[2][1]), (3, "u v w"), (3, "x y z"), (-1, "alone here it is"), (-1, "k l m")]
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted(want)
