from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import highlight_fallback, snippet, tokens
from tarn.operators import ranking, search
from tarn.operators.ranking import RankingConfig
from tarn.operators.standing import StandingIndex
from tarn.plans.query import Group, QueryError, Term, parse, rewrite_site

SCHEMA = "title string, body string, url string, collection string, indexed_at long"
DOCS = [
    ("Rust search", "tantivy powers fast indexes", "https://one.example/a", "tech", 1000),
    ("Pasta", "rust never sleeps in the kitchen", "https://two.example/b", "cooking", 1000),
    ("Red house", "a big red house", "https://one.example/c", "tech", 500),
    ("House", "the house was red and big", "https://three.example/d", "tech", 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def found(docs, q, **kw):
    return [r.url[-1] for r in search.candidates(docs, q, **kw).orderBy(F.desc("bm25"), "url").collect()]


def test_title_outranks_body(docs):
    assert found(docs, "rust") == ["a", "b"]


def test_scope_is_exact(docs):
    assert found(docs, "rust", collection="cooking") == ["b"]
    assert found(docs, "rust", collection="Cooking") == []


def test_phrase_needs_order(docs):
    assert found(docs, '"red house"') == ["c"]


def test_site_and_signs(docs):
    assert found(docs, "house site:one.example") == ["c", "a"]
    assert found(docs, "+house -big") == []
    assert found(docs, "rust AND tantivy") == ["a"]
    assert found(docs, "rust NOT kitchen") == ["a"]
    assert set(found(docs, "(pasta OR tantivy)")) == {"a", "b"}
    assert found(docs, "title:house body:tantivy") and "a" in found(docs, "title:house body:tantivy")


@pytest.mark.parametrize("q", ["", "  ", '"open', "+", "(a", "a)", "AND b", "a AND"])
def test_bad_queries_find_nothing(docs, q):
    with pytest.raises(QueryError):
        parse(q)
    assert found(docs, q) == []


@pytest.mark.parametrize(
    ("q", "want"),
    [("a site:x.y", "a +host:x.y"), ("site:x.y", "+host:x.y"), ('"site:x"', '"site:x"'), ("website:x", "website:x"), ("-site:x", "-+host:x"), ("(site:x)", "(+host:x)")],
)
def test_site_rewrite(q, want):
    assert rewrite_site(q) == want


def test_negated_site(docs):
    assert set(found(docs, "house -site:one.example")) == {"d"}


def test_parse_tree():
    assert parse("a +b -c") == Group(must=(Term(("b",)),), should=(Term(("a",)),), must_not=(Term(("c",)),))
    assert parse("title:a^2").should == (Term(("a",), "title", 2.0),)


def test_tokens(spark):
    got = spark.createDataFrame([("Ünï-Code_x 12 " + "y" * 40,)], "t string").select(tokens("t")).first()[0]
    assert got == ["ünï", "code", "x", "12"]


def test_snippet_is_escaped_and_marked(spark):
    df = spark.createDataFrame([("a <b> Rust & rusty",), ("no hit <here>",)], "t string")
    assert [r[0] for r in df.select(snippet("t", ["rust"])).collect()] == ["a &lt;b&gt; <mark>Rust</mark> &amp; rusty", "no hit &lt;here&gt;"]
    assert df.select(highlight_fallback("t", ["rust"])).first()[0] == "a &lt;b&gt; <mark>Rust</mark> &amp; <mark>rust</mark>y"


@pytest.mark.parametrize(("age", "half", "want"), [(0, 90.0, 1.0), (90, 90.0, 0.5), (180, 90.0, 0.25), (-5, 90.0, 1.0), (1000, 0.0, 1.0)])
def test_freshness(spark, age, half, want):
    got = spark.range(1).select(ranking.freshness(F.lit(0), age * 86400, half)).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_formula(spark):
    config = RankingConfig(90.0, {"local": 2.0}, {"a.b": 3.0})
    got = spark.range(1).select(ranking.final_score(F.lit(1.5), F.lit("local"), F.lit("a.b"), F.lit(0), 90 * 86400, config), ranking.final_score(F.lit(1.5), F.lit("peer"), F.lit("z"), F.lit(0), 0, config)).first()
    assert tuple(got) == pytest.approx((4.5, 1.5), abs=1e-6)


def test_rerank_only_sees_the_candidates(spark):
    rows = [("t", "word " * (9 - k) + "pad " * k, f"https://h{k}.example/", "c", 10**9 if k == 8 else 0) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    top = search.search(df, "word", 10**9, limit=2)  # eight candidates: the freshest is the ninth
    assert "https://h8.example/" not in [r.url for r in top.collect()]


def test_postings_agree_with_the_scan(spark, docs, tmp_path):
    index = StandingIndex(spark, str(tmp_path), buckets=4).build(docs)
    a = {r.url: round(r.bm25, 6) for r in index.candidates("body:red body:rust").collect()}
    tree = [("body", ("red",), 1.0), ("body", ("rust",), 1.0)]
    b = {r.url: round(r.bm25, 6) for r in search.bm25(search.tokenized(docs), tree).filter("bm25 > 0").collect()}
    assert a == b
