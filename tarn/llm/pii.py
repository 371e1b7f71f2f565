"""Personal data: base patterns, and the terms that give a found entity away, by corpus co-occurrence. Built-in functions only.

A term t discloses an entity e by PMI(t; e) / IC(e): the share of the entity's information content, -log p(e), that
seeing t removes. Probabilities are document frequencies over the whole corpus; every term of a document that holds an
entity is a candidate, whatever its count. p(e given t) is n_both / (n_term + 1), as if one document more held the term
without the entity: that two rare things met once proves nothing, that they always meet proves more the oftener they do.
A term is generalised (or removed) wherever it stands if its share reaches the threshold for some entity and it makes
that entity likelier than not; the second is what remains of the rule as the corpus grows and any entity becomes rare.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import KEY_BITS, checkpointed, free_names, identity, may_hold, maybe

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Policy:
    """share: disclosure from which a term goes; certainty: p(e given t) that it needs; held_back: documents of each term
    that are assumed to lack the entity; generalise: put the kind in place, else remove."""

    share: float = 0.9
    certainty: float = 0.6
    held_back: float = 1.0
    generalise: bool = True


# Patterns without nested repetition: Java keeps a stack for that, which very long matches overflow. Where the plain
# pattern nests, the text is first changed at equal length, so that a run of one character class says the same.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?:\G|(?<![0-9]))[0-9][0-9 -]{11,}[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TERM = r"\p{L}{3,}+"


_PLACED = "array<struct<start:int,end:int,own:string>>"
#: Items that are folded together; the results of these runs are folded afterwards, so the work grows with the items.
_RUN = 128


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, value, combine) -> Column:
    """array<struct<before, x>>: each item with the values of all items before it combined, 0 for the first.

    What a fold carries is copied at every step, so it carries numbers only.
    """
    none = F.array().cast("array<int>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def fold(run: Column, worth) -> Column:
        return F.aggregate(run, first, lambda acc, x: F.struct(combine(acc["at"], worth(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(every: Column, runs: Column) -> Column:
        bases = fold(runs, lambda r: r["at"])["out"]
        before = F.flatten(F.zip_with(runs, bases, lambda r, base: F.transform(r["out"], lambda v: combine(base, v))))
        return F.zip_with(every, before, lambda x, b: F.struct(b.alias("before"), x.alias("x")))

    def whole(every: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _RUN).cast("int"))
        return _let(F.transform(at, lambda k: fold(F.slice(every, k * _RUN + 1, F.lit(_RUN)), value)), lambda runs: joined(every, runs))

    return _let(items, lambda every: F.when(F.size(every) > 0, whole(every)))


def _located(text: Column, pattern: Column | str, when: Column) -> Column:
    """array<struct<start, end, own>> (code points) of the matches: between them lie the pieces that the pattern splits off."""

    def places(found: Column) -> Column:
        gaps = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
        both = F.filter(gaps, lambda x: x["size"].isNotNull())
        run = _running(both, lambda x: x["gap"] + x["size"], lambda a, b: a + b)
        start = lambda s: s["before"] + s["x"]["gap"]
        return F.zip_with(run, found, lambda s, m: F.struct(start(s).alias("start"), (start(s) + s["x"]["size"]).alias("end"), m.alias("own")))

    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return _let(found, lambda x: F.when(F.size(x) > 0, places(x)).otherwise(F.array().cast(_PLACED)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _matches(text: Column) -> Column:
    """array<struct<kind, start, end, own>> of the valid base matches, by kind as listed, then start. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_digit = text.rlike("[0-9]")
    email = _located(F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_"), _EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(_located(text, _IP, ascii_digit), lambda s: F.forall(F.split(s["own"], r"\."), lambda p: p.cast("double") <= 255))
    lone = F.regexp_replace(text, r"[ -](?=[ -])|(?<=[ -])[ -]", "x")
    card = F.filter(_located(F.when(ascii_digit, lone), _CARD, ascii_digit), lambda s: F.length(_digits(s["own"])).between(13, 19) & _luhn(_digits(s["own"])))
    phone = F.filter(_located(text, _PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["own"])).between(9, 15))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["own"].alias("own")))

    return F.concat(*[named(k, x) for k, x in zip(BASE, (email, ip, card, phone), strict=True)])


def _bare(matches: Column) -> Column:
    return F.transform(matches, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the valid base matches, by kind as listed, then start. Null is empty."""
    return _bare(_matches(text))


def _entity(s: Column) -> Column:
    return F.xxhash64(s["kind"], F.when(s["kind"] == "email", F.lower(s["own"])).when(s["kind"] == "ip", s["own"]).otherwise(_digits(s["own"])))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def disclosing(one: DataFrame, policy: Policy = Policy(), bits: int = KEY_BITS) -> DataFrame:  # noqa: B008
    """(term): the hashes of the terms that disclose some entity; one: rid, entities, terms (arrays of hashes) of each document.

    PMI(t; e) >= share * IC(e) says that p(e | t) >= p(e) ^ (1 - share). As a term meets an entity in no more documents
    than the entity stands in, n_e, this and the certainty can hold only for terms of at most n_e * (n / n_e) ^ (1 - share)
    and n_e / certainty documents, which grow with n_e: a term commoner than that for the commonest entity it meets is
    left out before anything is paired.
    Entities that stand in the same documents disclose alike, so one of them is paired. Counts are of the whole corpus,
    summed up before they are shuffled.
    """
    n = one.count()
    held = one.filter(F.size("entities") > 0)
    stands = checkpointed(held.select("rid", F.explode("entities").alias("entity")))
    documents = stands.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor("rid.a").alias("x"), F.bit_xor("rid.b").alias("y"))
    alike = checkpointed(documents.groupBy("n_entity", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n_entity"))
    paired = stands.join(alike, "entity")
    commonest = paired.groupBy("rid").agg(F.max("n_entity").alias("top"))
    tops = checkpointed(held.select("rid", "terms").join(commonest, "rid").select(F.explode("terms").alias("term"), "top").groupBy("term").agg(F.max("top").alias("top")))
    counts = maybe(one.select(F.explode("terms").alias("term")), "term", tops.select("term"), bits).groupBy("term").agg(F.count("*").alias("n_term"))
    total = F.lit(float(max(n, 1)))
    rare = checkpointed(counts.join(tops, "term").filter(F.col("n_term") + policy.held_back <= F.col("top") * F.least(F.pow(total / F.col("top"), F.lit(1 - policy.share)), F.lit(1 / policy.certainty)) * (1 + 1e-9)).select("term", "n_term"))
    words = maybe(held.select("rid", F.explode("terms").alias("term")), "term", rare.select("term"), bits).join(rare, "term")
    pairs = paired.join(words, "rid").groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    information = F.log(total / F.col("n_entity"))
    among = F.col("n_term") + F.lit(policy.held_back)
    pmi = F.log(F.col("n_both") * total / (F.col("n_entity") * among))
    return pairs.filter((information > 0) & (F.col("n_both") / among >= policy.certainty) & (pmi >= policy.share * information)).select("term").distinct()


def find(docs: DataFrame, policy: Policy = Policy(), bits: int = KEY_BITS) -> DataFrame:  # noqa: B008
    """One row for each row of docs: doc_id, rid (names the row by id and text), base, spans.

    `base` lists the valid base matches, `spans` these and then the disclosing terms: whole words of three letters or
    more, outside base matches, but the words of an entity itself count as terms of its document. Null and empty texts
    have none. Documents are counted once for each distinct pair of id and text; repeated rows get the same spans.
    Entities and terms travel as 64-bit hashes. Extra columns are ignored.
    """
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), identity(ids, text).alias("rid"))
    words = F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))
    based = rows.withColumn("found", _matches(F.col("text")))
    known = checkpointed(based.select("doc_id", "rid", _bare(F.col("found")).alias("base"), F.array_distinct(F.transform("found", _entity)).alias("entities"), F.array_distinct(F.transform(words, _term)).alias("terms")))
    # repeated rows are seldom: without any, nothing has to be brought together
    one = known if known.groupBy("rid").count().filter("count > 1").isEmpty() else known.select("rid", "entities", "terms").dropDuplicates(["rid"])
    risky = checkpointed(disclosing(one, policy, bits))
    flagged = maybe(one.select("rid", F.explode("terms").alias("term")), "term", risky, bits).join(risky, "term").select("rid.a").distinct()
    held = may_hold(rows.select("rid", "text"), F.col("rid.a"), checkpointed(flagged), "_held", bits).filter("_held")
    pieces = F.zip_with(F.split("text", _TERM, -1), words, lambda p, w: F.struct((F.length(p) + F.length(w)).alias("step"), F.length(w).alias("size"), _term(w).alias("term")))
    each = held.withColumn("copy", F.monotonically_increasing_id()).select("rid", "copy", F.posexplode(pieces).alias("i", "w")).filter("w.size is not null").select("rid", "copy", "i", "w.*")
    seen = each.withColumn("end", F.sum("step").over(Window.partitionBy("rid", "copy").orderBy("i")).cast("int")).select("rid", "term", (F.col("end") - F.col("size")).alias("start"), "end")
    terms = maybe(seen, "term", risky, bits).join(risky, "term").select("rid", "start", "end", F.lit(None).cast("int").alias("to"))
    # words inside a base match are not terms of their own: none begun before reaches into the word, none after begins in it
    inside = known.filter(F.size("base") > 0).select("rid", F.explode("base").alias("s")).select("rid", "s.start", "s.end", F.col("s.end").alias("to"))
    every = terms.unionByName(inside.join(terms.select("rid").distinct(), "rid", "left_semi"))
    up, down = Window.partitionBy("rid").orderBy("start"), Window.partitionBy("rid").orderBy(F.desc("start"))
    near = every.withColumn("before", F.max("to").over(up)).withColumn("after", F.min(F.when(F.col("to").isNotNull(), F.col("start"))).over(down))
    free = near.filter(F.col("to").isNull() & (F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end")))
    spans = free.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms"))
    return known.select("doc_id", "rid", "base").join(spans, "rid", "left").select("doc_id", "rid", "base", F.concat("base", F.coalesce("terms", F.array().cast(SPANS))).alias("spans"))


def digest(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Code points of the pieces that a text is cut from: to take a part of a text by its place means to read it from its start.
_PIECE = 1024


def redacted(text: Column, spans: Column, generalise: bool = True) -> Column:
    """text with each run of overlapping spans put as [KIND] of its first span, or removed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        joined = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(b > a, F.substring(joined, a - first * _PIECE + 1, b - a)).otherwise(F.lit(""))

    def put(run: Column, pieces: Column) -> Column:
        heads = F.filter(run, lambda s: s["x"]["start"] >= s["before"])
        mark = lambda s: F.concat(F.lit("["), F.upper(s["x"]["kind"]), F.lit("]")) if generalise else F.lit("")
        parts = F.transform(heads, lambda s: F.concat(cut(pieces, s["before"], s["x"]["start"]), mark(s)))
        last = F.array_max(F.transform(run, lambda s: -s["x"]["to"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, last, F.length(text)))

    run = _running(ordered, lambda x: -x["to"], lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))
    done = _let(run, lambda r: _let(pieces, lambda p: put(r, p)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitised(docs: DataFrame, policy: Policy = Policy(), bits: int = KEY_BITS) -> DataFrame:  # noqa: B008
    """docs, all rows and columns, with personal data in text generalised; a null text stays null.

    Rows are known by id and text, so repeated rows get the same text. Rows that hold nothing are never shuffled.
    """
    row, maybe_name, put = free_names(docs, "_row", "_maybe", "_put")
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    found = checkpointed(find(docs, policy, bits).filter(F.size("spans") > 0).select("rid", "spans").dropDuplicates(["rid"]))
    flagged = may_hold(docs.withColumn(row, identity(ids, text)), F.col(f"{row}.a"), found.select("rid.a"), maybe_name, bits)
    met = flagged.filter(maybe_name).join(found.select(F.col("rid").alias(row), F.col("spans").alias(put)), row, "left")
    changed = met.withColumn("text", F.when(F.col(put).isNull(), text).otherwise(redacted(text, F.col(put), policy.generalise)))
    return flagged.filter(~F.col(maybe_name)).select(*docs.columns).unionByName(changed.select(*docs.columns))
