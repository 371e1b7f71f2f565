"""Ranked retrieval: statistics, BM25 over fields, boolean filters, two-stage ranking, snippets.

Term statistics are conditional sums over one scan for the query's own terms, for a corpus that is asked once; `standing`
answers the same queries from an inverted index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import has_phrase, snippet, tokens
from tarn.functions.urls import index_host, ranking_domain
from tarn.operators.ranking import RankingConfig, final_score
from tarn.plans.query import DEFAULT_FIELDS, Group, Node, QueryError, Range, Term, parse, range_boosts, scored_terms, words_of

K1, B = 1.2, 0.75
LIMIT, OVERFETCH = 25, 4


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that comes in fewer splits than there are cores is dealt out, any other is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokenized(docs: DataFrame) -> DataFrame:
    """docs with `host`, and the token arrays `title_tokens` and `body_tokens`."""
    return spread(docs).withColumn("host", index_host("url")).withColumn("title_tokens", tokens("title")).withColumn("body_tokens", tokens("body"))


def count_of(words: Column, term: str) -> Column:
    """Occurrences of a term: how much shorter the joined tokens get without it. Stays in generated code, unlike a lambda."""
    joined, one = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), f" {term} "
    return ((F.length(joined) - F.length(F.replace(joined, F.lit(one), F.lit("")))) / len(one)).cast("int")


def _occurs(words: Column, phrase: tuple) -> Column:
    return count_of(words, phrase[0]) if len(phrase) == 1 else F.when(_holds(words, phrase), F.lit(1)).otherwise(F.lit(0))


def _holds(words: Column, phrase: tuple) -> Column:
    """Whether the tokens hold a phrase, whose last word may be a beginning."""
    if not isinstance(phrase[-1], Range):
        return has_phrase(words, list(phrase))
    head, start = f" {' '.join(phrase[:-1])} ", phrase[-1].low
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(head + start))


def predicate(node: Node) -> Column:
    """Whether a tokenized document matches. Alternatives are optional once something is required."""
    if isinstance(node, Range):
        return node.holds(F.col(node.field)) if node.field in ("host", "url", "collection") else F.exists(f"{node.field}_tokens", node.holds)
    if isinstance(node, Term):
        if node.field in ("host", "url", "collection"):
            return F.col(node.field) == node.words[0]
        return reduce(Column.__or__, [_holds(F.col(f"{f}_tokens"), node.words) for f in (DEFAULT_FIELDS if node.field is None else (node.field,))])
    out = [predicate(n) for n in node.must]
    if not node.must:
        out.append(reduce(Column.__or__, [predicate(n) for n in node.should], F.lit(False)))
    out += [~predicate(n) for n in node.must_not]
    return reduce(Column.__and__, out)


def bm25(docs: DataFrame, terms: list[tuple[str, tuple[str, ...], float]]) -> DataFrame:
    """docs (tokenized) with `bm25`: the boosted sum over fields and terms, statistics over all of docs.

    One pass gathers the statistics into a single row, which is joined back; nothing is shuffled but that row.
    """
    fields = sorted({f for f, _, _ in terms})
    if not terms:
        return docs.withColumn("bm25", F.lit(0.0))
    tf = {f"_tf{i}": _occurs(F.col(f"{f}_tokens"), w) for i, (f, w, _) in enumerate(terms)}
    sizes = {f"_n_{f}": F.size(f"{f}_tokens") for f in fields}
    counted = docs.withColumns(tf | sizes)
    stats = counted.agg(F.count("*").alias("_n"), *[F.avg(f"_n_{f}").alias(f"_avg_{f}") for f in fields], *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, (f, _, boost) in enumerate(terms):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        t = F.col(f"_tf{i}").cast("double")
        score = score + F.when(t > 0, boost * idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col(f"_n_{f}") / F.col(f"_avg_{f}")))).otherwise(0.0)
    return joined.withColumn("bm25", score).drop(*tf, *sizes, "_n", *[f"_avg_{f}" for f in fields], *[f"_df{i}" for i in range(len(terms))])


def candidates(docs: DataFrame, query: str, collection: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Matching documents with `bm25`, the `limit` best (all if None), ties by url.

    A malformed or empty query gives no rows. Scores count the whole index; the collection only filters.
    """
    try:
        tree = parse(query)
    except QueryError:
        return tokenized(docs).withColumn("bm25", F.lit(0.0)).filter(F.lit(False))
    found = bm25(tokenized(docs), scored_terms(tree)).filter(predicate(tree))
    for clause, boost in range_boosts(tree):
        found = found.withColumn("bm25", F.col("bm25") + F.when(predicate(clause), boost).otherwise(0.0))
    if collection is not None:
        found = found.filter(F.col("collection") == collection)
    return found if limit is None else found.orderBy(F.desc("bm25"), "url").limit(limit)


def search(docs: DataFrame, query: str, now: int, collection: str | None = None, config: RankingConfig = RankingConfig(), limit: int = LIMIT, source: str = "local") -> DataFrame:  # noqa: B008
    """title, url, snippet_html, source, timestamp, score: the `limit` best.

    limit x 4 candidates by BM25 are ranked again by the full formula; both cuts are part of the answer.
    """
    return answers(candidates(docs, query, collection, limit * OVERFETCH), query, now, config, limit, source)


def answers(found: DataFrame, query: str, now: int, config: RankingConfig = RankingConfig(), limit: int = LIMIT, source: str = "local") -> DataFrame:  # noqa: B008
    """The second stage of `search`: candidates ranked by the full formula, the `limit` best with their snippets."""
    try:
        words = words_of(parse(query))
    except QueryError:
        words = []
    scored = found.withColumn("source", F.lit(source)).withColumn("score", final_score(F.col("bm25"), F.col("source"), ranking_domain("url"), F.col("indexed_at"), now, config))
    top = scored.orderBy(F.desc("score"), "url").limit(limit)
    return top.select("title", "url", snippet("body", words).alias("snippet_html"), "source", F.col("indexed_at").alias("timestamp"), "score")


def count_documents(docs: DataFrame, collection: str) -> DataFrame:
    return docs.filter(F.col("collection") == collection).agg(F.count("*").alias("n"))
