"""The search query language: free text, `+` and `-`, quoted phrases, AND OR NOT, groups, `field:term`, `term^2`, `site:host`,
term ranges (`title:[a TO b}`, `body:>=m`, `*` for an open end) and phrases whose last word is a beginning (`"red ho"*`).

A query string becomes a small tree, which is then compiled to Column predicates and scored terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import tokenize

DEFAULT_FIELDS = ("title", "body")
FIELDS = {"title", "body", "host", "url", "collection"}
#: Title hits count three times.
BOOSTS = {"title": 3.0, "body": 1.0}


class QueryError(ValueError):
    """The string is no query; a search for it finds nothing."""


@dataclass(frozen=True)
class Range:
    """Terms between two ends, None for an open one; `prefix` for those that begin with `low`."""

    low: str | None
    high: str | None
    with_low: bool = True
    with_high: bool = True
    prefix: bool = False
    field: str | None = None
    boost: float = 1.0

    def holds(self, term: Column) -> Column:
        """Whether a term lies within, as comparisons that a scan can push down."""
        out = F.lit(True)
        if self.prefix:
            return (term >= self.low) & F.startswith(term, F.lit(self.low))
        if self.low is not None:
            out = out & ((term >= self.low) if self.with_low else (term > self.low))
        if self.high is not None:
            out = out & ((term <= self.high) if self.with_high else (term < self.high))
        return out


@dataclass(frozen=True)
class Term:
    """One word or phrase in one field, or in the default fields if field is None. The last word of a phrase may be a
    Range, which stands for the words that begin so."""

    words: tuple
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


Node = Group | Term | Range


@dataclass
class _Parser:
    tokens: list[tuple[str, str]]
    at: int = 0
    out: list = field(default_factory=list)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def group(self, inner: bool) -> Group:
        clauses: list[list] = []  # [occur, node, joined to the one before by AND]
        joined = negated = False
        while True:
            kind, value = self.peek()
            if kind == "end" or kind == ")":
                if kind == ")" and not inner:
                    raise QueryError("unbalanced )")
                break
            self.next()
            if kind == "op":
                if value == "NOT":
                    negated = True
                elif not clauses:
                    raise QueryError(f"{value} without a left side")
                elif value == "AND":
                    joined = True
                continue
            occur = "should"
            while kind in "+-":
                occur = "must_not" if kind == "-" else "must" if occur == "should" else occur
                kind, value = self.next()
            if negated:
                occur = "must_not"
            name = None
            while kind == "field":
                name = value
                kind, value = self.next()
                if kind in "+-":  # `host:` after a sign that a rewrite put there
                    kind, value = self.next()
            if kind == "(":
                node = self.group(True)
                if self.next()[0] != ")":
                    raise QueryError("unbalanced (")
            elif kind in ("word", "phrase", "prefix"):
                node = self.leaf(name, kind, value)
            elif kind == "range":
                node = self.span(name, value)
            else:
                raise QueryError("a sign or field without a term")
            if self.peek()[0] == "^":
                boost = float(self.next()[1])
                node = replace(node, boost=boost) if node else node
            if node is not None:
                if joined:
                    if clauses and clauses[-1][0] == "should":
                        clauses[-1][0] = "must"
                    if occur == "should":
                        occur = "must"
                clauses.append([occur, node])
            joined = negated = False
        if joined or negated:
            raise QueryError("an operator without a right side")
        pick = lambda occur: tuple(n for o, n in clauses if o == occur)
        return Group(pick("must"), pick("should"), pick("must_not"))

    @staticmethod
    def span(name: str | None, value: str) -> Range:
        if name is None:
            raise QueryError("a range without a field")
        if value[0] in "[{":
            low, _, high = value[1:-1].strip().partition(" TO ")
            ends, inside = (low.strip(), high.strip()), (value[0] == "[", value[-1] == "]")
        else:
            sign = re.match(r"[<>]=?", value)[0]
            end = value[len(sign) :]
            ends, inside = ((end, "*") if sign[0] == ">" else ("*", end)), (len(sign) == 2, len(sign) == 2)
        one = [None if e == "*" else e.strip('"') if name in ("url", "collection") else e.strip('"').lower() for e in ends]
        if one == [None, None]:
            raise QueryError("a range without an end")
        return Range(one[0], one[1], *inside, field=name)

    @staticmethod
    def leaf(name: str | None, kind: str, value: str) -> Term | Group | None:
        if name in ("host", "url", "collection"):
            return Term((value.lower() if name == "host" else value,), name)
        words = tuple(tokenize(value))
        if kind == "prefix":
            if len(words) < 2:
                raise QueryError("a beginning needs a word before it")
            words = (*words[:-1], Range(words[-1], None, prefix=True))
        return Term(words, name) if words else None


_TOKEN = re.compile(r'\s*(?:(?P<range>[\[{]\s*\S+\s+TO\s+[^\s\]}]+\s*[\]}]|[<>]=?[^\s()"^]+)|(?P<phrase>"[^"]*")(?P<prefix>\*)?|(?P<paren>[()])|(?P<sign>[+-](?=\S))|\^(?P<boost>\d+(?:\.\d+)?)|(?P<word>[^\s()"^+-][^\s()"^]*)|(?P<bad>["^+-]))')


def rewrite_site(query: str) -> str:
    """`site:h` as a required host clause, outside quotes, at the start or after white space, `(`, `-` or `+`."""
    parts = query.split('"')
    parts[::2] = [re.sub(r"(^|[\s(+-])site:", r"\1+host:", p) if i == 0 or p[:5] != "site:" else re.sub(r"(?<=[\s(+-])site:", "+host:", p) for i, p in enumerate(parts[::2])]
    return '"'.join(parts)


def parse(query: str) -> Group:
    """The tree of a query; QueryError if it is empty or malformed. Clauses are alternatives unless marked."""
    if not query.strip():
        raise QueryError("empty query")
    text, tokens = rewrite_site(query), []
    at = 0
    while at < len(text) and text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m or m["bad"]:
            raise QueryError(f"unexpected {text[at:].strip()[:10]!r}")
        at = m.end()
        if m["phrase"] is not None:
            tokens.append(("prefix" if m["prefix"] else "phrase", m["phrase"][1:-1]))
        elif m["range"]:
            tokens.append(("range", m["range"]))
        elif m["paren"]:
            tokens.append((m["paren"], ""))
        elif m["sign"]:
            tokens.append((m["sign"], ""))
        elif m["boost"]:
            tokens.append(("^", m["boost"]))
        elif m["word"] in ("AND", "OR", "NOT"):
            tokens.append(("op", m["word"]))
        else:
            name, colon, rest = m["word"].partition(":")
            if colon and name in FIELDS:
                tokens.append(("field", name))
                if rest[:1] in ("<", ">", "[", "{"):
                    at -= len(rest)  # a range, which may hold spaces
                elif rest:
                    tokens.append(("word", rest))
                elif at < len(text) and text[at] not in '"(':
                    raise QueryError("a field without a term")
            else:
                tokens.append(("word", m["word"]))
    parser = _Parser(tokens)
    return parser.group(False)


def scored_terms(node: Node, boost: float = 1.0) -> list[tuple[str, tuple[str, ...], float]]:
    """(field, words, boost) of every clause that adds to a score, with field boosts applied. Ranges add a constant."""
    if isinstance(node, Range):
        return []
    if isinstance(node, Term):
        fields = DEFAULT_FIELDS if node.field is None else (node.field,)
        return [(f, node.words, boost * node.boost * BOOSTS[f]) for f in fields if f in BOOSTS]
    return [t for n in (*node.must, *node.should) for t in scored_terms(n, boost * node.boost)]


def range_boosts(node: Node, boost: float = 1.0) -> list[tuple[Range, float]]:
    """The ranges that add to a score, each with what it adds where it matches."""
    if isinstance(node, Range):
        return [(node, boost * node.boost)]
    if isinstance(node, Term):
        return []
    return [r for n in (*node.must, *node.should) for r in range_boosts(n, boost * node.boost)]


def words_of(node: Node) -> list[str]:
    """The words to highlight."""
    return list(dict.fromkeys(w for _, words, _ in scored_terms(node) for w in words if isinstance(w, str)))
