"""Text expressions: tokens as the index sees them, phrases, snippets and highlighting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of as many bytes or more is dropped.
TOKEN_BYTES = 40
SNIPPET_CHARS = 220


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order, without the very long ones; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(runs, lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))


def tokenize(text: str) -> list[str]:
    """The same in Python, for query strings."""
    return [t for t in re.split(r"[^\w]|_", text.lower()) if t and len(t.encode()) < TOKEN_BYTES]


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the terms stand next to one another in order."""
    if not phrase:
        return F.lit(True)
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))  # noqa: E731  tokens hold no space
    return F.contains(spaced(F.array_join(words, " ")), F.lit(f" {' '.join(phrase)} "))


def html_escape(text: Column | str) -> Column:
    """`&`, `<`, `>` and `"` as entities; the apostrophe stays."""
    out = F.col(text) if isinstance(text, str) else text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def wrap(text: Column, needle: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of the needle, whatever its case, between `before` and `after`."""
    if not needle:
        return text
    return F.regexp_replace(text, "(?iu)(" + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", needle) + ")", f"{before}$1{after}")


def highlight_fallback(text: Column | str, terms: list[str]) -> Column:
    """The escaped text with each term wrapped, one after the other."""
    out = html_escape(text)
    for t in terms:
        out = wrap(out, t)
    return out


def snippet(body: Column | str, terms: list[str], chars: int = SNIPPET_CHARS) -> Column:
    """At most `chars` characters from the first hit of any term on, escaped, hits wrapped; the beginning if there is none."""
    body = F.col(body) if isinstance(body, str) else body
    if not terms:
        return html_escape(F.substring(body, 1, chars))
    any_of = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t))) + ")(?![\\p{L}\\p{N}])"
    at = F.length(F.split(body, any_of, 2)[0])
    start = F.when(at >= F.length(body), 0).otherwise(F.greatest(at - 40, F.lit(0)))
    return F.regexp_replace(html_escape(F.substring(body, start + 1, F.lit(chars))), any_of, "<mark>$1</mark>")
