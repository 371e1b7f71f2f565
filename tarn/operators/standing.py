"""Search over a standing inverted index: a query reads its own terms' postings and the documents that it returns.

On disk, as Parquet:
    postings/bucket=b/   field, term, url, tf, length, positions, collection; b is a hash of the term; each file is sorted by
                         (field, term), so that a term's or a range's pages are found by their statistics
    terms/               field, term, df, cf: the dictionary
    documents/           the documents as they came
    fields/              field, n_docs, avg_len
Besides title and body, hosts, urls and collections are fields of one term a document. Documents are inverted where they
are read, each split by itself as a segment, and neither texts nor postings are shuffled: what the index takes on disk is
what it holds. No term is gathered in one task, neither to build the index nor to search it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import tokens
from tarn.functions.urls import index_host
from tarn.operators.ranking import RankingConfig
from tarn.operators.search import K1, LIMIT, OVERFETCH, B, answers, spread
from tarn.plans.query import BOOSTS, DEFAULT_FIELDS, Group, Node, QueryError, Range, Term, parse

BUCKETS = 16
TEXT_FIELDS = ("title", "body")
WHOLE_FIELDS = ("host", "url", "collection")
_POSTINGS = "field string, term string, url string, collection string, length int, tf int, positions array<int>"
#: Words that are inverted at once, in whole documents.
_WORDS = 1 << 20


def _inverted(words: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(row, term, tf, positions) of every distinct term of every row of token lists."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = row * max(len(coded.dictionary), 1) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[order].astype(np.int32)))
    return row[order][first], coded.dictionary.take(pa.array(code[order][first])), pa.array(np.diff(np.r_[first, len(key)]).astype(np.int32)), positions


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _POSTINGS.split(", ")]
    for batch in batches:
        n = np.cumsum(sum(batch.column(f).value_lengths().to_numpy(zero_copy_only=False) for f in TEXT_FIELDS))
        cuts = [0, *(np.flatnonzero(np.diff(n // _WORDS)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(i, j - i)
            url, collection = part.column("url"), part.column("collection")
            for f in TEXT_FIELDS:
                row, term, tf, positions = _inverted(part.column(f))
                length = part.column(f).value_lengths().cast(pa.int32())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(row), pa.string()), term, url.take(at), collection.take(at), length.take(at), tf, positions], names)
            for f in WHOLE_FIELDS:
                at = pa.array(np.flatnonzero(part.column(f).is_valid().to_numpy(zero_copy_only=False)))
                one = pa.array(np.ones(len(at), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.string()), part.column(f).take(at), url.take(at), collection.take(at), one, one, pa.nulls(len(at), pa.list_(pa.int32()))], names)


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, url, collection, length, tf, positions) of documents (collection, url, title, body); no row is moved."""
    rows = spread(docs.select("url", "collection", *TEXT_FIELDS)).select("url", "collection", index_host("url").alias("host"), *[tokens(f).alias(f) for f in TEXT_FIELDS])
    return rows.mapInArrow(_invert, _POSTINGS)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class StandingIndex:
    """The index at `root`, once `build` has written it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def build(self, docs: DataFrame) -> StandingIndex:
        """Writes the index of documents (collection, url, title, body, indexed_at)."""
        rows = postings(docs).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        packed = lambda df: df.write.mode("overwrite").option("compression", "zstd")
        packed(rows.sortWithinPartitions("bucket", "field", "term", "url")).partitionBy("bucket").parquet(f"{self.root}/postings")
        terms = self.postings().groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        packed(terms.sortWithinPartitions("field", "term")).parquet(f"{self.root}/terms")
        packed(docs.select("collection", "url", "title", "body", "indexed_at")).parquet(f"{self.root}/documents")
        n = self.documents().agg(F.count("*").alias("n_docs"))
        sizes = self.terms().filter(F.col("field").isin(*TEXT_FIELDS)).groupBy("field").agg(F.sum("cf").alias("n_tokens"))
        sizes.crossJoin(F.broadcast(n)).select("field", "n_docs", "n_tokens", (F.col("n_tokens") / F.col("n_docs")).alias("avg_len")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/fields")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema("field string, term string, url string, collection string, length int, tf int, positions array<int>, bucket int").parquet(f"{self.root}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("field string, term string, df long, cf long").parquet(f"{self.root}/terms")

    def documents(self) -> DataFrame:
        return self.spark.read.schema("collection string, url string, title string, body string, indexed_at long").parquet(f"{self.root}/documents")

    def fields(self) -> DataFrame:
        return self.spark.read.schema("field string, n_docs long, n_tokens long, avg_len double").parquet(f"{self.root}/fields")

    # ---------------------------------------------------------------- queries

    def scores(self, query: str, collection: str | None = None) -> DataFrame | None:
        """(url, bm25) of every match; None if the query is empty or malformed. Scores count the whole index."""
        try:
            tree = parse(query)
        except QueryError:
            return None
        match = _Match(tree)
        if not match.wanted:
            return self.postings().select("url", F.lit(0.0).alias("bm25")).filter(F.lit(False))
        rows = self.postings()
        if not match.ranges:
            # folded to literals, so only the terms' own folders are listed
            rows = rows.filter(F.col("bucket").isin(*[_bucket(F.lit(t), self.buckets) for t in match.terms()]))
            rows = rows.filter(F.col("term").isin(*match.terms()))
        if collection is not None:
            everywhere, rows = rows, rows.filter(F.col("collection") == collection)
        found = match.grouped(rows)
        stats = self._stats(match, found if collection is None else match.grouped(everywhere) if match.phrases() else None)
        scored = found.crossJoin(F.broadcast(stats)) if stats is not None else found
        return scored.filter(match.predicate(tree)).select("url", match.score().alias("bm25"))

    def _stats(self, match: _Match, found: DataFrame | None) -> DataFrame | None:
        """One row: document counts and lengths; df of words from the dictionary, of phrases from the rows found."""
        scored = match.scored
        if not scored:
            return None
        fields = sorted({f for f, _, _ in scored})
        words = sorted({(f, ws[0]) for f, ws, _ in scored if len(ws) == 1})
        own = self.fields().agg(F.max("n_docs").alias("_n"), *[F.max(F.when(F.col("field") == f, F.col("avg_len"))).alias(f"_avg_{f}") for f in fields])
        if words:
            dictionary = self.terms().filter(F.col("term").isin(*sorted({w for _, w in words}))).agg(*[F.coalesce(F.max(F.when((F.col("field") == f) & (F.col("term") == w), F.col("df"))), F.lit(0)).alias(match.df(f, (w,))) for f, w in words])
            own = own.crossJoin(F.broadcast(dictionary))
        phrases = [(f, ws) for f, ws in match.phrases() if any((f, ws) == (sf, sw) for sf, sw, _ in scored)]
        if phrases:
            own = own.crossJoin(F.broadcast(found.agg(*[F.count_if(match.holds(f, ws)).alias(match.df(f, ws)) for f, ws in phrases])))
        return own

    def candidates(self, query: str, collection: str | None = None, limit: int | None = LIMIT) -> DataFrame:
        """The documents that match with `bm25`, the `limit` best (all if None), ties by url."""
        found = self.scores(query, collection)
        if found is None:
            return self.documents().withColumn("bm25", F.lit(0.0)).filter(F.lit(False))
        if limit is None:
            return self.documents().join(found, "url")
        # `limit` rows, whatever the index
        return self.documents().join(F.broadcast(found.orderBy(F.desc("bm25"), "url").limit(limit)), "url")

    def search(self, query: str, now: int, collection: str | None = None, config: RankingConfig = RankingConfig(), limit: int = LIMIT, source: str = "local") -> DataFrame:  # noqa: B008
        """title, url, snippet_html, source, timestamp, score: as `search.search`, from the index."""
        return answers(self.candidates(query, collection, limit * OVERFETCH), query, now, config, limit, source)


class _Match:
    """What a tree wants of the postings: (field, word) pairs and term ranges, and expressions over what was found."""

    def __init__(self, tree: Group):
        self.pairs: dict[tuple[str, str], str] = {}
        self.ranges: dict[tuple[str, Range], str] = {}
        self.parts: dict[tuple[str, tuple], bool] = {}
        self.scored: list[tuple[str, tuple[str, ...], float]] = []
        self.constants: list[tuple[str, Range, float]] = []
        self._visit(tree, 1.0, True)

    @property
    def wanted(self) -> bool:
        return bool(self.pairs or self.ranges)

    def terms(self) -> list[str]:
        return sorted({t for _, t in self.pairs})

    def phrases(self) -> list[tuple[str, tuple]]:
        return list(self.parts)

    def _visit(self, node: Node, boost: float, counts: bool) -> None:
        if isinstance(node, Group):
            for n in (*node.must, *node.should):
                self._visit(n, boost * node.boost, counts)
            for n in node.must_not:
                self._visit(n, boost, False)
            return
        for f in DEFAULT_FIELDS if node.field is None else (node.field,):
            if isinstance(node, Range):
                self.ranges.setdefault((f, node), f"_r{len(self.ranges)}")
                if counts:
                    self.constants.append((f, node, boost * node.boost))
                continue
            for w in node.words:
                if isinstance(w, Range):
                    self.ranges.setdefault((f, w), f"_r{len(self.ranges)}")
                else:
                    self.pairs.setdefault((f, w), f"_t{len(self.pairs)}")
            if len(node.words) > 1:
                self.parts[f, node.words] = True
            if counts and f in BOOSTS:
                self.scored.append((f, node.words, boost * node.boost * BOOSTS[f]))

    def grouped(self, rows: DataFrame) -> DataFrame:
        """One row per url that any pair or range touches: frequencies, positions where a phrase needs them, lengths."""
        is_pair = {k: (F.col("field") == k[0]) & (F.col("term") == k[1]) for k in self.pairs}
        is_range = {k: (F.col("field") == k[0]) & k[1].holds(F.col("term")) for k in self.ranges}
        placed = {(f, w) for f, ws in self.parts for w in ws}
        out = [F.coalesce(F.max(F.when(c, F.col("tf"))), F.lit(0)).alias(self.pairs[k]) for k, c in is_pair.items()]
        out += [F.max(F.when(c, F.col("positions"))).alias(f"{self.pairs[k]}_at") for k, c in is_pair.items() if k in placed]
        out += [F.coalesce(F.max(c), F.lit(False)).alias(self.ranges[k]) for k, c in is_range.items()]
        out += [F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(f"{self.ranges[k]}_at") for k, c in is_range.items() if k in placed]
        out += [F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"_n_{f}") for f in sorted({f for f, _, _ in self.scored})]
        return rows.filter(reduce(Column.__or__, [*is_pair.values(), *is_range.values()])).groupBy("url").agg(*out)

    def holds(self, field: str, words: tuple) -> Column:
        """Whether a field holds a word, or words next to one another."""
        if len(words) == 1:
            return F.col(self.pairs[field, words[0]]) > 0
        at = [F.col(f"{self.pairs[field, w] if (field, w) in self.pairs else self.ranges[field, w]}_at") for w in words]
        return F.coalesce(F.exists(at[0], lambda p: reduce(Column.__and__, [F.array_contains(a, p + i) for i, a in enumerate(at) if i])), F.lit(False))

    def df(self, field: str, words: tuple) -> str:
        return f"_df_{field}_{list(dict.fromkeys((f, w) for f, w, _ in self.scored)).index((field, words))}"

    def predicate(self, node: Node) -> Column:
        if isinstance(node, Range):
            return reduce(Column.__or__, [F.col(self.ranges[f, node]) for f in (DEFAULT_FIELDS if node.field is None else (node.field,))])
        if isinstance(node, Term):
            return reduce(Column.__or__, [self.holds(f, node.words) for f in (DEFAULT_FIELDS if node.field is None else (node.field,))])
        out = [self.predicate(n) for n in node.must]
        if not node.must:
            out.append(reduce(Column.__or__, [self.predicate(n) for n in node.should], F.lit(False)))
        return reduce(Column.__and__, out + [~self.predicate(n) for n in node.must_not])

    def score(self) -> Column:
        score = F.lit(0.0)
        for f, ws, boost in self.scored:
            df = F.col(self.df(f, ws))
            idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
            t = (F.col(self.pairs[f, ws[0]]) if len(ws) == 1 else self.holds(f, ws).cast("int")).cast("double")
            score = score + F.when(t > 0, boost * idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col(f"_n_{f}") / F.col(f"_avg_{f}")))).otherwise(0.0)
        for f, r, boost in self.constants:
            score = score + F.when(F.col(self.ranges[f, r]), boost).otherwise(0.0)
        return score
