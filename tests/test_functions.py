"""Column and text helpers, with the known small cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions import identifiers as I
from tessera.functions import metrics as M
from tessera.functions import text as T
from tessera.operators import aggregates as G
from tessera.operators import filters as L
from tessera.operators import graph
from tessera.plans import contracts


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_kappa_cases(spark):
    r = one(spark, a=M.kappa(*lit(6, 4, 3, 3, 3, 3)), same=M.kappa(*lit(2, 2, 2, 0, 2, 0)), none=M.kappa(*lit(0, 0, 0, 0, 0, 0)), sens=M.rate(*lit(2, 3)), zero=M.rate(*lit(2, 0)))
    assert r.a == pytest.approx(1 / 3) and r.same == 1 and r.none is None and r.sens == pytest.approx(2 / 3) and r.zero is None


def test_mcnemar_cases(spark):
    r = one(spark, a=M.mcnemar(*lit(1, 0)), b=M.mcnemar(*lit(3, 1)), c=M.mcnemar(*lit(0, 0)), w=M.winner(*lit(2, 2), "a", "b"))
    assert (r.a, r.b, r.c, r.w) == (0, 0.25, None, "Tie")


def test_answers(spark):
    r = one(spark, a=A.normalized(F.lit(None).cast("array<string>"), F.lit('[" Yes ", 3, "no", "YES"]'), F.lit("x")), b=A.normalized(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(" ")), c=A.decision(F.array(F.lit("maybe"))), d=A.decision(F.array(F.lit("yes"), F.lit("no"))))
    assert (r.a, r.b, r.c, r.d) == (["yes", "no"], [], "include", None)
    assert A.filter_strategy("'a' | 'b'") == "enum" and A.filter_strategy("number[]") == "numeric" and A.filter_strategy(None) == "open"


def test_bins(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 26)], "v long")
    assert sorted(map(tuple, G.equal_width_bins(df, "v").collect()))[0] == (1, 3, 3)
    few = spark.createDataFrame([(3,), (3,), (5,), (None,)], "v long")
    assert sorted(map(tuple, G.equal_width_bins(few, "v").collect())) == [(3, 3, 2), (5, 5, 1)]
    assert sorted(map(tuple, G.quantile_bins(few, "v").collect())) == [(0, 3, 3, 1), (1, 5, 5, 1)]
    far = spark.createDataFrame([(i,) for i in [*range(30), 10_000]], "v long")
    got = sorted(map(tuple, G.quantile_bins(far, "v").collect()))
    assert got[-1][2] == 29 and sum(r[3] for r in got) == 30
    assert G.quantile_bins(df.limit(0), "v").count() == 0


def test_keyset_pages_cover_all_rows_once(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k int")
    order, seen, cursor = [("k", "desc"), ("id", "asc")], [], None
    while True:
        page = L.page(df, order, 7, cursor).collect()
        seen += [r.id for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = [page[6].k, page[6].id]
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_signatures_and_cursors():
    assert L.signature({"a": [2, 1, 1], "b": None}) == L.signature({"b": [], "a": [1, 2]}) != L.signature({"a": [1]})
    c = L.encode_cursor(contract="x", values=[1])
    assert L.decode_cursor(c, contract="x") == [1]
    with pytest.raises(ValueError, match="contract"):
        L.decode_cursor(c, contract="y")


def test_contracts(spark):
    assert contracts.admit("articles.list", filters={"what": [1]}) == "unknown filter"
    df = spark.createDataFrame([(i, f"t{i}", i % 5, "r") for i in range(9)], "article_id long, title string, created_s long, route string")
    page = contracts.read("articles.list", df, {"route": ["r"]}, 4).collect()
    cursor = contracts.cursor_after("articles.list", {"route": ["r"]}, page[3])
    more = contracts.read("articles.list", df, {"route": ["r"]}, 4, cursor).collect()
    assert page[4] == more[0]
    with pytest.raises(ValueError, match="signature"):
        contracts.read("articles.list", df, {}, 4, cursor)


@pytest.mark.parametrize("limit", [5, 12, 40, 1000])
@pytest.mark.parametrize("text", ["", "plain " * 30, "a\n\nb\n \n\nc\n\n" * 9, "intro\n# One\nbody body\n## Two\n" + "long line " * 12 + "\n\n" + "x" * 50])
def test_chunks(text, limit):
    how, chunks = T.chunk_text(text, limit)
    assert all(len(c) <= limit for c in chunks) and chunks
    if how == "article_paragraph_greedy":
        assert "".join(chunks) == text
        assert all(len(a) + len(b) > limit or not a or not b for a, b in zip(chunks, chunks[1:], strict=False)) or len(text) > limit
    assert how == ("article_heading_greedy" if "# One" in text else "article_paragraph_greedy")


def test_heading_line_is_repeated():
    _, chunks = T.chunk_text("# Head\n" + "word " * 20, 30)
    assert len(chunks) > 2 and all(c.startswith("# Head\n") for c in chunks)


def test_sections():
    md = "# P\n### A\naaaa\n### B\nbbbb\n### C\ncccc\n"
    chunks = T.chunk_sections(md, 24)
    assert all(c.startswith("# P\n") and len(c) <= 24 for c in chunks) and "".join(c[4:] for c in chunks) == md[4:]
    assert T.chunk_sections("x" * 9, 4) == ["xxxx"] and T.chunk_sections("no", 9) == ["no"]


def test_tolerant_json():
    assert T.tolerant_json('{"a": 1}') == ('{"a": 1}', "plain")
    assert T.tolerant_json('so ```json\n{"a": 1}\n``` then')[1] == "extracted"
    assert T.tolerant_json('x [1, 2] y') == ("[1, 2]", "extracted")
    assert T.tolerant_json(r'{"a": "\alpha \\beta"}') == (r'{"a": "\\alpha \\beta"}', "repaired")
    assert T.tolerant_json("no") == (None, "failed") == T.tolerant_json(None)


def test_merge_patch():
    assert T.merge_patch({"a": 1, "b": {"c": 2, "d": 3}}, {"a": None, "b": {"c": 9}, "e": [1]}) == {"b": {"c": 9, "d": 3}, "e": [1]}
    assert T.merge_patch([1], {"a": 1}) == {"a": 1} and T.merge_patch({"a": 1}, 5) == 5


def test_identifiers():
    assert I.normalize("doi", "(10.1/A.)") == ("accepted", "doi", "10.1/a", None)
    assert I.normalize("medrxiv", "10.1101/2020.02.02.20200001v3") == ("accepted", "doi", "10.1101/2020.02.02.20200001", "v3")
    assert I.normalize("url", "https://arxiv.org/abs/hep-th/9901001v1") == ("accepted", "arxiv", "hep-th/9901001", "v1")
    assert I.normalize("arxiv", "12.34")[3] == "malformed" and I.normalize("isbn", "1")[3] == "unsupported-kind"


def test_title_tokens(spark):
    assert one(spark, t=T.title_tokens(F.lit("Ünï-code  A1, a1!"))).t == ["uni", "code", "a1"]


def test_prefix_search_without_prefixes(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "xbc")], "article_id long, token string")
    assert {r[0] for r in L.prefix_search(df, ["a"]).collect()} == {1} and L.prefix_search(df, []).count() == 2


def test_long_chain_components(spark):
    n = 200
    rows = [(i, f"k{i}") for i in range(n)] + [(i + 1, f"k{i}") for i in range(n)] + [(1000, "z"), (None, "k1"), (7, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "node long, key string")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000}


def test_contribution_diff_is_a_recompute(spark):
    old = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long")
    new = spark.createDataFrame([("a", 2), ("c", 1)], "k string, v long")
    assert {tuple(r) for r in G.contribution_diff(old, new, ["k"], "v").collect()} == {("b", -3), ("c", 1)}


def test_columns_agree_with_functions(spark):
    """Column forms of the plain functions, on odd values."""
    types = ["'a' | 'b'", "number[]", None, "", "number | null", "null", "string", "'x'[]", " INTEGER "]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    for r in df.select("t", A.strategy_of(F.col("t")).alias("s"), A.options_of(F.col("t")).alias("o")).collect():
        assert (r.s, r.o) == (A.filter_strategy(r.t), A.enum_values(r.t or ""))
    cases = [(["explnation", "answer", "answers", "quotess", "other"], ["answer", "explanation", "quotes"]), ([], ["a"]), (["ab", "b"], ["a", "b"]), (["x", "xa"], ["x", "xb"])]
    df = spark.createDataFrame(cases, "f array<string>, e array<string>")
    for r in df.select("f", "e", T.remapped(F.col("f"), F.col("e")).alias("p")).collect():
        assert {x.found: x.expected for x in r.p} == T.remap_keys(r.f, r.e)


def test_ntile_over_ranges(spark):
    from pyspark.sql.window import Window

    from tessera.operators.rows import ntile

    df = spark.createDataFrame([(g, k * 3 % 101) for g, n in (("a", 50), ("b", 3), ("c", 101)) for k in range(n)], "g string, k long")
    want = df.withColumn("c", F.ntile(7).over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert ntile(df, 7, ["k"], "c", ["g"], buckets=5).exceptAll(want).isEmpty()


def test_read_shapes(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert contracts.shape_problems(a.limit(10), {"orders"}) == []
    assert contracts.shape_problems(a, {"nation"}) == ["unregistered relation orders", "more than 500 rows"]
    assert "join without a key" in contracts.shape_problems(a.crossJoin(a.limit(3).select("o_custkey")), {"orders"})
