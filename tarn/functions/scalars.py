"""Small expressions: hashes, fetch outcomes, versions, delays, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTOCOL_VERSION = "1.0"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(title: Column | str, text: Column | str) -> Column:
    """SHA-256 of title, NUL, text: what the crawler compares."""
    return F.sha2(F.concat(_c(title), F.decode(F.unhex(F.lit("00")), "UTF-8"), _c(text)), 256)


def import_hash(body: Column | str) -> Column:
    """SHA-256 of the body alone: what an import stores, so that an imported page is indexed once more."""
    return F.sha2(_c(body), 256)


def fetch_outcome(status: Column | str, content_type: Column | str) -> Column:
    """fresh, not_modified, rate_limited, other_status or not_html; error where there is no status."""
    status, kind = _c(status), F.coalesce(_c(content_type), F.lit(""))
    return (
        F.when(status.isNull(), "error")
        .when(status == 304, "not_modified")
        .when(status == 429, "rate_limited")
        .when(~status.between(200, 299), "other_status")
        .when(~F.contains(F.lower(kind), F.lit("html")), "not_html")
        .otherwise("fresh")
    )


def retry_after(value: Column | str) -> Column:
    """Seconds of a Retry-After header; null unless it is a whole number, not negative."""
    value = F.trim(_c(value))
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("long"))


def backoff_seconds(n: Column | str, most: int = 120) -> Column:
    """The wait after the n-th throttled answer in a row: 1, 2, 4, 8 ... at most 120."""
    return F.least(F.pow(F.lit(2.0), _c(n) - 1).cast("long"), F.lit(most).cast("long"))


def effective_delay(configured: Column | str, target: Column | str, robots: Column | str) -> Column:
    """A target's own delay stands in for the configured one if it is above 0; robots.txt may ask for more."""
    own = F.when(_c(target) > 0, _c(target)).otherwise(_c(configured))
    return F.greatest(own, F.coalesce(_c(robots), F.lit(0)))


def source_label(peer_url: Column | str, remote: Column | str) -> Column:
    return F.concat(F.lit("peer:"), _c(peer_url), F.lit("/"), _c(remote))


def padded_version(version: Column | str) -> Column:
    """`1` and `1.0` as three numbers."""
    version = _c(version)
    dots = F.length(version) - F.length(F.replace(version, F.lit("."), F.lit("")))
    return F.when(dots == 0, F.concat(version, F.lit(".0.0"))).when(dots == 1, F.concat(version, F.lit(".0"))).otherwise(version)


def compatibility(theirs: Column | str, ours: str = PROTOCOL_VERSION) -> Column:
    """compatible, minor_mismatch or incompatible; what is no version is incompatible."""
    number = r"(0|[1-9][0-9]*)"
    pattern = rf"^{number}\.{number}\.{number}(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
    padded, own = F.coalesce(padded_version(theirs), F.lit("")), ours.split(".") + ["0"]
    part = lambda k: F.regexp_extract(padded, pattern, k)
    return F.when(~padded.rlike(pattern) | (part(1) != own[0]), "incompatible").when(part(2) != own[1], "minor_mismatch").otherwise("compatible")


def client_ip(forwarded: Column | str, socket: Column | str) -> Column:
    """The first forwarded address, else the socket's, else `unknown`."""
    first = F.trim(F.split(_c(forwarded), ",")[0])
    return F.coalesce(F.when(first != "", first), _c(socket), F.lit("unknown"))


def relative_age(seconds: Column | str) -> Column:
    s = _c(seconds)
    whole = lambda unit: F.floor(s / unit).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(whole(60), F.lit("m ago"))).when(s < 86400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))


def clamp(x: Column | str, low: int, high: int) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def json_map(text: Column | str) -> Column:
    """A JSON object of numbers as a map; empty if it is malformed or null."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.from_json(_c(text), "map<string,double>", {"mode": "PERMISSIVE"}), empty)


def json_longs(text: Column | str) -> Column:
    """A JSON array of whole numbers; empty if it is malformed or null."""
    return F.coalesce(F.from_json(_c(text), "array<long>"), F.array().cast("array<long>"))
