"""Operators against brute force, on the small tables and on tables of odd rows."""

import base64
import hashlib
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import fingerprint, packing, phrases, queries, simhash, tokens, urls, warc

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("h", T.StringType())])
LONG = "the cat of the house " * 4000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "One two three four five six."), (6, "One two three four five six."), (7, "漢字だけの文章です"), (8, "a"), (9, LONG), (10, "...!!!"), (11, "é ñ ü"), (12, "<|endoftext|> x  y\n\n z")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOC)


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_simhash(spark, sf_dir):
    got = by(queries.op7_simhash_near_dedup(spark, sf_dir))
    want = brute.simhash(docs_of(spark, sf_dir))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == want


def test_simhash_odd(spark):
    got = by(simhash.components(simhash.fingerprints(odd(spark))), "id")
    want = brute.simhash(ODD)
    assert {i: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for i, r in got.items()} == want
    assert simhash.components(simhash.fingerprints(odd(spark, []))).count() == 0
    again = simhash.components(simhash.fingerprints(odd(spark, [(5, "x y z"), (5, "x y z"), (None, "x y z")]))).collect()
    assert [r.component_id for r in again] == [5, 5, 5]


@pytest.mark.parametrize(("crowd", "few"), [(2, simhash.FEW), (64, simhash.FEW), (64, 0)])
def test_simhash_links(spark, crowd, few, monkeypatch):
    """Chains, crowded balls and far points keep exactly the components of all pairs, with either length of segments."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:5].tolist():
        fps |= {b ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i, 12)}
        x = b
        for k in range(0, 60, 2):
            x ^= 3 << k
            fps.add(x)
    rows = list(enumerate(fps))
    near = [(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= 2]
    want = brute.components(near, [i for i, _ in rows])
    src = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "id long, fp long")
    assert {r.id: r.component_id for r in simhash.components(src).collect()} == want


def test_decontamination(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = by(queries.op4_decontamination(spark, sf_dir))
    want = brute.contamination(docs_of(spark, sf_dir), items)
    assert {i: tuple(r[1:]) for i, r in got.items()} == want
    assert any(x[4] for x in want.values())


def test_decontamination_odd(spark):
    items = [(1, "Cat of the house the cat"), (10, "cat"), (2, None), (3, "-- "), (9, "one two three four five six seven eight nine ten eleven"), (5, "漢字だけの文章です"), (6, "ñ")]
    sheet = spark.createDataFrame(items, "item_id long, text string")
    got = by(phrases.decontaminate(odd(spark), sheet))
    assert {i: tuple(r[1:]) for i, r in got.items()} == brute.contamination(ODD, items)
    none = phrases.decontaminate(odd(spark), sheet.limit(0))
    assert [r.contaminated for r in none.collect()] == [False] * len(ODD)
    assert phrases.decontaminate(odd(spark, []), sheet).count() == 0
    twice = phrases.decontaminate(odd(spark, [(8, "a cat"), (8, "a cat"), (8, "dog"), (None, "cat")]), sheet).collect()
    assert sorted((r.n_hit, r.n_words) for r in twice) == [(0, 1), (1, 1), (1, 2), (1, 2)]
    named = spark.createDataFrame([("a", "a cat"), ("b", "dog"), (None, "cat"), ("", "dog")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_hit) for r in phrases.decontaminate(named, sheet).collect()) == [("", 0), ("None", 1), ("a", 1), ("b", 0)]


def test_proximity(spark):
    docs = odd(spark, [(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma x x x x x x beta alpha")])
    win = phrases.windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), 10)
    each = win.selectExpr("phrase", "len", "posexplode(words) as (off, word)")
    terms = each.selectExpr("word", "xxhash64(word) as term")
    index = phrases.build_index(docs, terms, 3)
    look = each.selectExpr("phrase", "len", "off", "xxhash64(word) as term")
    assert {r.id for r in phrases.occurrences(index, look).collect()} == {2}
    assert {r.id for r in phrases.occurrences(index, look, slop=1).collect()} == {1, 2}


def test_warc(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = by(queries.op3_warc_revisits(spark, sf_dir), "page_id")
    assert {i: tuple(r[1:]) for i, r in got.items()} == brute.warc(pages)


PAGES = [(1, None), (2, ""), (3, "x\r\n\r\nWARC/1.1\r\n"), (4, "é" * 50_000), (5, "x\r\n\r\nWARC/1.1\r\n"), (6, "\r\n\r\n"), (0, "é" * 50_000), (7, "z")]


@pytest.mark.parametrize("small", [0, warc.SMALL_ROWS])
def test_warc_odd(spark, tmp_path, monkeypatch, small):
    """With revisits broadcast or found by a Bloom filter; records of several size classes; an empty table."""
    monkeypatch.setattr(warc, "SMALL_ROWS", small)
    monkeypatch.setattr(warc, "CLASS_BYTES", 8)
    src = spark.createDataFrame([(i, f"http://a/{i}\n", t, "clash") for i, t in PAGES], "page_id long, url string, html string, payload string")
    for n, rows in enumerate((src, src.limit(0))):
        path = f"file://{tmp_path}/{n}"
        warc.archive(rows, path)
        back = warc.read_archives(spark, path)
        want = brute.warc(PAGES) if not n else {}
        plain = lambda r: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        assert {i: plain(r) for i, r in by(back, "id").items()} == want
        # lengths of revisits come from the responses where their own headers don't say
        bare = back.withColumn("payload_bytes", F.expr("if(record_type = 'revisit', null, payload_bytes)"))
        assert {i: plain(r) for i, r in by(warc.with_originals(bare), "id").items()} == want
    big = warc.resolve_revisits(warc.headers_of(src), least_bytes=10).collect()
    assert {r.id: r.record_type for r in big} == {i: x[2] for i, x in brute.warc(PAGES, 10).items()}


def test_warc_ids(spark, tmp_path):
    """String ids with line ends, repeated and null ids: every row has its record, with a name of its own."""
    rows = [("a\nb", "u", "x"), ("a\nb", "u2", "x"), ("c", "u", "x"), ("c", "u", "y"), (None, "u", "x"), (None, "v", "q"), ("", None, "q")]
    warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/w", compression="none")
    got = warc.read_archives(spark, f"file://{tmp_path}/w", "string").collect()
    assert sorted((r.id or "-", r.payload_digest[:4], r.record_type, r.refers_to or "-") for r in got) == sorted(
        (i or "-", base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()[:4], "response" if (i, h) in {("a\nb", "x"), ("c", "y"), ("", "q")} else "revisit", "-" if (i, h) in {("a\nb", "x"), ("c", "y"), ("", "q")} else {"x": "a\nb", "q": "-"}[h])
        for i, _, h in rows
    )
    heads = [head for f in tmp_path.glob("w/part-*") for head, _ in warc.parse(f.open("rb"))]
    assert len({h["warc-record-id"] for h in heads}) == len(rows)
    responses = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in responses for h in heads if h["warc-type"] == "revisit")


def test_warc_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "CLASS_BYTES", 100)
    src = spark.createDataFrame([(i, "u", chr(97 + i % 26) * (i * 7 % 1500)) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    warc.archive(src, f"file://{tmp_path}/w", least_bytes=10**9, compression="none")
    for f in tmp_path.glob("w/part-*"):
        sizes = [len(block) for _, block in warc.parse(f.open("rb"))]
        assert sum(sizes) - 85 * len(sizes) <= 4000 or len(sizes) == 1
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 400


def test_urls(spark):
    cases = [None, "", "no scheme", "http://Example.COM/en/7?x#y", "http://a.example.com/en/8", "HTTP://example.net/de/81", "http://x.example.net/de/9", "http://notcom/en/", "http://a.org/es/", "http://a.org/ES/", "http://org?/es/", "ftp://u@com/en/x://y", "http://a.com#/en/", "x://", "http://.com/en/", "http://a\nb.com/en/\n?z"]
    got = by(urls.judge_urls(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")), "page_id")
    for i, url in enumerate(cases):
        host, path = brute.split_url(url)
        fits = [(len(r), r, v) for v, r in urls.RULES if path.startswith(r[r.index("/") :]) and (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")]))]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), url
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert by(urls.judge_urls(spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string"), rules=()), "page_id")[1].verdict == "allow"


def test_url_key_collisions(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s))
    found = urls.Rules(urls.digest_array([("block", "a.b/x"), ("allow", "c.d/x"), ("block", "e/long")], str(tmp_path)))
    assert found.judge(["a.b", "c.d", "z.z", "q.c.d"], ["/x", "/xx", "/x", "/x"]) == (["a.b/x", "c.d/x", None, "c.d/x"], [True, False, None, False])


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = by(tokens.token_counts(odd(spark), path))
    for i, t in ODD:
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids), i
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    assert tokens.token_counts(odd(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_other_tokenizers(spark, name):
    import public_tokenizers

    got = by(tokens.token_counts(odd(spark), public_tokenizers.path(name)))
    assert got[2].n_tokens == got[1].n_tokens == 0 and got[4].n_tokens > 4000


def test_token_counts_whole_table(spark, sf_dir):
    """The registered query against the library, text by text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = by(queries.op8_token_counts(spark, sf_dir))
    docs = docs_of(spark, sf_dir)
    assert len(got) == len(docs)
    for i, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_fast_ids_of_every_code_point():
    """The fast encoder equals the library for every code point after a letter, a digit and a space."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    assert enc.plain is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}b1{c} {c}" for c in points[at : at + 4096])
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_safe_parts():
    text = "ab cd  ef\ngh ij" * 50
    for size in (1, 7, 64):
        parts = list(tokens.safe_parts(text, size))
        assert "".join(parts) == text
        assert all(p[0] == " " and p[1] != " " and not q[-1].isspace() for q, p in zip(parts, parts[1:], strict=False))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(odd(spark), path)).collect()
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 2048 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.pieces(odd(spark, []), path)).count() == 0


@pytest.mark.parametrize("open_first", [False, True])
def test_sum_of_squares(open_first):
    """Each step is a least-squares choice among the gaps allowed, and the bins are those of a plain loop."""
    rng = np.random.default_rng(5)
    n = rng.integers(1, 101, 3000)
    bins, at = packing.sum_of_squares(n, 100, open_first)
    assert np.bincount(bins, n).max() <= 100
    gaps, made = {}, 0
    for i in np.argsort(-n, kind="stable"):
        s = n[i]
        cost = {g: 1 - 2 * gaps[g] + (1 + 2 * gaps.get(g - s, 0) if g > s else 0) for g in gaps if gaps[g] and s <= g < 100}
        if not (open_first and cost):
            cost[100] = 1 + 2 * gaps.get(100 - s, 0) if s < 100 else 0
        g = 100 - at[i]
        assert g == min(k for k, c in cost.items() if c == min(cost.values()))
        if g < 100:
            gaps[g] -= 1
        else:
            made += 1
        if g > s:
            gaps[g - s] = gaps.get(g - s, 0) + 1
    assert made == bins.max() + 1 <= (1.02 if open_first else 1.05) * n.sum() / 100 + 1


def test_packing_whole_table(spark, sf_dir):
    """The registered query against the library's ids, text by text; nearly as few sequences as tokens allow."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs_of(spark, sf_dir)}
    got = queries.op6_best_fit_packing(spark, sf_dir).collect()
    pieces = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and len(own) == r.length
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, x in ids.items():
        n = len(x)
        first = n % 2048 or 2048
        assert sorted(pieces[i]) == [(k, 0 if not k else first + 2048 * (k - 1), first if not k else 2048) for k in range(-(-n // 2048))]
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in fill.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *[n for _, n in sorted(x)]])[:-1].tolist() and sum(n for _, n in x) <= 2048
    assert len(fill) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_packing_keeps_ids(spark):
    big = [2**53 + 1, 2**53 + 3, None, 2**62 + 1]
    got = packing.pack(packing.pieces(odd(spark, [(i, "a b c") for i in big]), queries.tokenizer_path())).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, big))


def test_fingerprints(spark, sf_dir):
    """The registered query on a whole table: fingerprints as a plain loop builds them, likeness as the two
    returned texts alone give it, and at step 0 the exact sets."""
    docs = docs_of(spark, sf_dir)
    want = brute.edited(docs)
    got = by(queries.op10_document_fingerprints(spark, sf_dir))
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute.versions(docs)
    for i, (text, edited, following) in want.items():
        r = got[i]
        assert r.fingerprint == brute.fingerprint(text) and r.edited_fingerprint == brute.fingerprint(edited)
        near, step, differing = brute.compared(r.fingerprint, r.edited_fingerprint)
        assert (r.near_edited, r.edited_step, r.edited_differing) == (near, step, differing)
        assert r.near_next == brute.compared(r.fingerprint, brute.fingerprint(following))[0]
        if step == 0:
            a, b = brute.digests(text), brute.digests(edited)
            assert differing == sorted(a ^ b) and abs(near - len(a & b) / len(a | b)) < 1e-12
    assert np.mean([r.edited_step == 0 for r in got.values()]) > 0.7
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.2


def test_whole_likeness(spark, sf_dir):
    """Of all digests, whatever the step: exact for each row, also where the fingerprints' likeness is of a sample."""
    want = brute.edited(docs_of(spark, sf_dir))
    got = by(queries.op10_document_fingerprints(spark, sf_dir))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, texts in want.items():
        r, (own, edited, following) = got[i], map(brute.digests, texts)
        assert (r.digests, r.edited_digests) == (sorted(own), sorted(edited))
        assert r.whole_near_edited == pytest.approx(jaccard(own, edited), abs=1e-12)
        assert r.whole_near_next == pytest.approx(jaccard(own, following), abs=1e-12)
    assert len(got) == len(want) and sum(r.edited_step > 0 and abs(r.near_edited - r.whole_near_edited) > 1e-9 for r in got.values()) >= 10


def test_whole_likeness_over_buckets(spark, monkeypatch):
    """A bucket's last row takes the next one's digests from its edge; empty and null texts have none."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(k * k * 7 - 50, " ".join(f"Line {j * (k % 3 + 1)}." for j in range(400)) if k % 5 else None) for k in range(40)]
    want, got = brute.edited(rows), by(fingerprint.edited_versions(odd(spark, rows)))
    for i, (text, _, following) in want.items():
        a, b = brute.digests(text), brute.digests(following)
        assert got[i].whole_near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-12)


def test_fingerprint_peeling(spark):
    """Few differing digests come out exactly, many leave an estimate near the truth."""
    rng = np.random.default_rng(2)
    rows = []
    for n in (0, 1, 2, 5, 9, 20, 40, 200, 1500):
        a = rng.choice(2**40, n, replace=False)
        for keep in (0, n // 2, max(0, n - 9), n):
            b = np.concatenate([a[:keep], rng.choice(2**40, n - keep, replace=False)])
            rows.append((a.tolist(), b.tolist(), sorted(set(a.tolist()) ^ set(b.tolist())), (keep / (2 * n - keep)) if n else 1.0))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want array<long>, near double")
    for c in "ab":
        df = df.withColumn(c, F.transform(c, lambda k: F.shiftleft(k, 24).bitwiseOR(F.xxhash64(k, F.lit(7)).bitwiseAND(F.lit(2**24 - 1)))))
    df = df.withColumn("x", fingerprint.ladder("a")).withColumn("y", fingerprint.ladder("b")).withColumn("o", fingerprint.compare("x", "y")).withColumn("got", fingerprint.likeness("o", "x", "y"))
    for r in df.select("want", "near", "o", "got").collect():
        assert abs(r.got - r.near) <= 0.3 and (r.o.step >= 0 or not r.want)
        if len(r.want) <= 40:
            assert sorted(r.o.d) == r.want and r.got == pytest.approx(r.near)


def test_fingerprints_odd(spark):
    got = by(fingerprint.edited_versions(odd(spark)))
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute.versions(ODD)
    assert got[4].fingerprint == got[9].fingerprint and got[1].fingerprint == got[2].fingerprint == ""
    assert fingerprint.edited_versions(odd(spark, [])).count() == 0
    assert fingerprint.edited_versions(odd(spark, [(1, "x"), (1, "x"), (None, "y")])).count() == 3
    alone = fingerprint.edited_versions(odd(spark, [(1, "One. Two.")])).collect()[0]
    assert alone.near_next == 1.0
    with pytest.raises(TypeError):
        fingerprint.edited_versions(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_paragraphs_follow_the_words(spark):
    """A word put in near the start changes the digests around it only, with and without sentence ends."""
    for end in (". ", " "):
        text = end.join(f"This is sentence number {k} of a very long line" for k in range(60))
        df = spark.createDataFrame([(text, text.replace("number 1 of", "number one more 1 of"))], "a string, b string")
        a, b = df.select(fingerprint.paragraph_digests(F.col("a")), fingerprint.paragraph_digests(F.col("b"))).collect()[0]
        assert len(a) >= 30 and len(set(a) ^ set(b)) <= 6
        assert {w >> 24 for w in (x % 2**64 for x in a)} == brute.digests(text)


def test_next_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(k * k * 7 - 50, f"text number {k}. " * (k % 5)) for k in range(60)] + [(10**15, "far"), (-(10**15), "away")]
    got = by(fingerprint.edited_versions(odd(spark, rows)))
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute.versions(rows)


def test_next_of_hot_ids(spark, monkeypatch):
    """A third of the rows have one id, a third none: they are cut by text hash and still follow one another."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(k, f"own {k}") for k in range(40)] + [(7, f"seven {k}") for k in range(40)] + [(None, f"none {k}") for k in range(40)]
    df = fingerprint.with_next(odd(spark, rows)).select("id", "t", "next_t", F.xxhash64("t").alias("h"), F.xxhash64("next_t").alias("nh"))
    got = df.collect()
    order = sorted(got, key=lambda r: (r.id if r.id is not None else -1, r.h), reverse=True)
    assert len(got) == 120 and all(a.next_t == b.t for a, b in zip(order, order[1:] + order[:1], strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall()
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE[name])
    names = [x[0] for x in cur.description]
    rows = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    plain = lambda row, at: tuple(str(row[at(c)]) for c in sorted(names))
    assert sorted(plain(r, str) for r in df.collect()) == sorted(plain(r, names.index) for r in rows)
