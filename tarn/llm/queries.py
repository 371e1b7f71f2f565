"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import interactions, kdtree, langid, pieces, pii, tokens, topk, toxicity, turns
from tarn.llm.common import held_out, table
from tarn.llm.decontam import contamination, is_contaminated
from tarn.llm.simhash import hex_fingerprint, near_duplicates
from tarn.llm.suffixes import repeated_passages
from tarn.llm.superkmer import substring_dedup


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.read_ranks())


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.read_model())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdtree.shards(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_pii, op3_decontamination, op4_topk, op5_simhash, op6_token_counts, op7_sentencepiece,
        op8_toxicity, op9_suffix_array, op10_substring_dedup, op11_structure_repair, op12_sharding, op13_filter_audit,
    )
    return {f.__name__: f for f in every}


_LUHN = "list_sum(list_transform(range(0, length(g)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(g[length(g) - j] AS INTEGER) WHEN CAST(g[length(g) - j] AS INTEGER) > 4 THEN 2 * CAST(g[length(g) - j] AS INTEGER) - 9 ELSE 2 * CAST(g[length(g) - j] AS INTEGER) END)) % 10 = 0"
_AT = "coalesce(list_sum(list_transform(p[1:i], lambda a: length(a))), 0) + coalesce(list_sum(list_transform(x[1:i - 1], lambda a: length(a))), 0)"

#: Matches with their places by the pieces between them; then the terms of entities' documents by document counts.
OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
v AS (SELECT * FROM (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), ('card', 3, '[0-9](?:[ -]?[0-9])+'), ('phone', 4, '\+[0-9][ ().0-9-]+[0-9]')) AS v(kind, k, pat)),
m AS (SELECT doc_id, t, kind, k, string_split_regex(t, pat) AS p, regexp_extract_all(t, pat) AS x FROM d, v),
u AS (SELECT doc_id, t, kind, k, p, x, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM m WHERE len(x) > 0),
f AS (SELECT doc_id, t, kind, k, s, CAST({_AT} AS BIGINT) AS b, regexp_replace(s, '[^0-9]', '', 'g') AS g FROM u
  WHERE kind = 'email' OR kind = 'ip' AND len(list_filter(string_split(s, '.'), lambda a: CAST(a AS DOUBLE) > 255)) = 0 OR kind = 'card' AND length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 OR kind = 'phone' AND length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 9 AND 15),
base AS (SELECT doc_id, t, kind, k, b, b + length(s) AS e, kind || ' ' || CASE kind WHEN 'email' THEN lower(s) WHEN 'ip' THEN s ELSE g END AS entity FROM f WHERE kind <> 'card' OR {_LUHN}),
ent AS (SELECT DISTINCT doc_id, entity FROM base),
tw AS (SELECT doc_id, string_split_regex(t, '\p{{L}}{{3,}}') AS p, regexp_extract_all(t, '\p{{L}}{{3,}}') AS x FROM d),
tu AS (SELECT doc_id, unnest(p[1:len(x)]) AS gap, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM tw WHERE len(x) > 0),
word AS (SELECT doc_id, lower(s) AS term, CAST(sum(length(gap) + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(s) AS l FROM tu),
trm AS (SELECT DISTINCT doc_id, term FROM word),
ne AS (SELECT entity, count(*) AS ne FROM ent GROUP BY entity),
nt AS (SELECT term, count(*) AS nt FROM trm GROUP BY term),
nb AS (SELECT entity, term, count(*) AS nb FROM ent JOIN trm USING (doc_id) GROUP BY entity, term),
risky AS (SELECT DISTINCT term FROM nb JOIN ne USING (entity) JOIN nt USING (term), (SELECT count(*) AS n FROM d) WHERE ne < n AND nb / CAST(nt + 1 AS DOUBLE) >= CAST(0.6 AS DOUBLE) AND ln(nb * CAST(n AS DOUBLE) / CAST(ne * (nt + 1) AS DOUBLE)) >= CAST(0.9 AS DOUBLE) * ln(CAST(n AS DOUBLE) / CAST(ne AS DOUBLE))),
terms AS (SELECT doc_id, e - l AS b, e FROM word SEMI JOIN risky USING (term)),
every AS (SELECT doc_id, kind, k, b, e FROM base UNION ALL SELECT doc_id, 'term', 5, b, e FROM terms q WHERE NOT EXISTS (SELECT 1 FROM base z WHERE z.doc_id = q.doc_id AND z.b < q.e AND q.b < z.e)),
out AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) FILTER (k < 5) AS own, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN out USING (doc_id)
"""

#: Words, then the windows of 13 words of both tables joined on their text.
OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hits AS (SELECT DISTINCT doc_id, p, ds.k, item_id FROM ds JOIN bw ON ds.k = bw.k AND array_to_string(w[p:p + ds.k - 1], ' ') = bw.s),
n_hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Windows of 50 words and the smallest document in which each starts.
REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM x JOIN m USING (h) WHERE least < doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.q) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS {gone}, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: Sign bits of every query against those of every row.
OP4 = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(list_sum(list_transform(range(1, len(c.b) + 1), lambda i: CASE WHEN q.b[i] <> c.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM c AS q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""

#: CRC-32 of the UTF-8 bytes, a byte at a time through the table of its polynomial.
_CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(i AS BIGINT)) AS c FROM range(256) AS r(i)))"""
_CRC_OF = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT)), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]), CAST(4294967295 AS BIGINT)), 4294967295)"
_GAP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _least(ways: list[str]) -> str:
    return f"least({', '.join(ways)})"


def _op11_ways(into: int) -> list[str]:
    """The cheapest audits into a state over one row, as strings that order by cost and then audit."""
    way = lambda s, cost, edits, when: f"CASE WHEN s{s} IS NOT NULL AND {when} THEN {{'cost': s{s}.cost + {cost}, 'audit': s{s}.audit || {edits}}} END"
    out = [way(into, 3, "'D'", "true")]
    if into == 1:
        out.append(way(0, "cut", "'K'", "live AND u = 's'"))
    if into >= 2:
        own = f"u = '{'ua'[into - 2]}'"
        for s, more in ({0: "", 1: "", 2: "I", 3: ""} if into == 2 else {0: "I", 1: "I", 2: "", 3: "I"}).items():
            out.append(way(s, f"cut + {2 * len(more)} + CASE WHEN {own} THEN 0 ELSE 2 END", f"'{more}' || CASE WHEN {own} THEN 'K' ELSE 'R' END", "live"))
    return out


#: Row by row, the cheapest audit into each state; then the audit is walked along the rows again.
OP11 = rf"""
WITH RECURSIVE {_CRC},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT raw.*, {_CRC_OF.format(s="k")} % 20 AS kind FROM raw, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {_GAP}) AS seen, left(role, 1) AS u FROM d),
f AS (SELECT *, seen = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(seen, 1) NOT IN ('.', '!', '?') AS short, lag(u) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
g AS (SELECT *, NOT blank AND NOT again AS live, CAST(short AS INTEGER) AS cut FROM f),
fold AS (SELECT DISTINCT conv_id, 0 AS i, {{'cost': 0, 'audit': ''}} AS s0, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR)) AS s1, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR)) AS s2, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR)) AS s3 FROM conversations
  UNION ALL SELECT fold.conv_id, fold.i + 1, {", ".join(_least(_op11_ways(s)) if s else _op11_ways(0)[0] for s in range(4))} FROM fold JOIN g ON g.conv_id IS NOT DISTINCT FROM fold.conv_id AND g.i = fold.i + 1),
ends AS (SELECT conv_id, least(s0, CASE WHEN s1 IS NOT NULL THEN {{'cost': s1.cost + 4, 'audit': s1.audit || 'II'}} END, CASE WHEN s2 IS NOT NULL THEN {{'cost': s2.cost + 2, 'audit': s2.audit || 'I'}} END, s3) AS best FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM ends),
walk AS (SELECT conv_id, p, audit[p] AS e, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS nth FROM edits),
put AS (SELECT w.conv_id, p, e, role, text, nth - max(CASE WHEN e = 'K' AND u = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS nth FROM walk AS w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i AND w.e <> 'I'),
whole AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM put WHERE e <> 'D' GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (live AND short) AS truncated, count(*) FILTER (was IS NOT NULL AND was || u NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("blank", "duplicate", "truncated", "illegal"))}, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ends LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


def _op12() -> str:
    """Four rounds: each part's widest dimension, the running bytes along it, the cut nearest to half."""
    first = lambda c: f"coalesce(CAST('0x' || rpad(substr(hex(encode({c})), 1, 14), 14, '0') AS BIGINT), -1)"
    parts = [f"""{_CRC},
l0 AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_CRC_OF.format(s="coalesce(text, '')")} AS crc, coalesce(doc_id, -1) AS k, {first("source")} AS d0, {first("lang")} AS d1, 0 AS node FROM documents, crc),
whole AS (SELECT {", ".join(f"max({c}) - min({c}) AS w_{c}" for c in ("d0", "d1", "size", "k"))} FROM l0)"""]
    for i in range(4):
        share = lambda c: f"coalesce((max({c}) - min({c})) / nullif(any_value(w_{c}), 0), 0)"
        parts.append(f"""x{i} AS (SELECT node, sum(size) AS total, {", ".join(f"{share(c)} AS p_{c}" for c in ("d0", "d1", "size", "k"))} FROM l{i}, whole GROUP BY node),
y{i} AS (SELECT *, greatest(p_d0, p_d1, p_size, p_k) AS top FROM x{i}),
z{i} AS (SELECT l{i}.*, total, CASE WHEN p_d0 = top THEN d0 WHEN p_d1 = top THEN d1 WHEN p_size = top THEN size ELSE k END AS along FROM l{i} JOIN y{i} USING (node)),
r{i} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY along, k, crc, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM z{i}),
l{i + 1} AS (SELECT doc_id, size, crc, k, d0, d1, 2 * node + CASE WHEN run * 2 < total OR run * 2 - total <= total - (run - size) * 2 AND (run - size) * 2 < total THEN 0 ELSE 1 END AS node FROM r{i})""")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY node ORDER BY k, crc, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM l4"""


#: Each document's failed filters, then each order step by step over the counts of equal ones.
OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN y USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o, CAST(step AS INTEGER) AS step, o[step:step] AS f, o[1:step - 1] AS before FROM p, range(1, 6) AS r(step) WHERE length(o) = 5),
e AS (SELECT part, o, step, f, contains(fails, f) AS hit, fails <> '' AND before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, fails = f AS only_f, n, good, toxic FROM h, s),
c AS (SELECT part, o, step, f, {", ".join(f"CAST(coalesce(sum({v}) FILTER ({k}), 0) AS BIGINT) AS {a}" for a, v, k in (("kept", "n", "NOT gone AND NOT hit"), ("removed", "n", "NOT gone AND hit"), ("redundant", "n", "gone AND hit"), ("unique_fails", "n", "only_f"), ("good_lost", "good", "NOT gone AND hit"), ("toxic_lost", "toxic", "NOT gone AND hit")))} FROM e GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pii": OP2,
        "op3_decontamination": OP3,
        "op4_topk": OP4,
        "op9_suffix_array": REPEATS.format(gone="n_repeated"),
        "op10_substring_dedup": REPEATS.format(gone="n_removed"),
        "op11_structure_repair": OP11,
        "op12_sharding": _op12(),
        "op13_filter_audit": OP13,
    }
