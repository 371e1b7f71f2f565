"""URL expressions: built-in functions throughout, so they run inside generated code and can be pushed about freely."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that carry attribution only (fixed values).
TRACKING_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_referrer gclid dclid _ga "
    "fbclid msclkid li_fat_id yclid ttclid mc_cid mc_eid _hsenc _hsmi __hssc __hstc hsCtaTracking "
    "ref ref_src ref_url igshid oly_anon_id oly_enc_id wickedid guce_referrer"
).split()
#: Hosts that are no targets for a crawl, with all their subdomains (fixed values).
BLACKLISTED_HOSTS = (
    "bufferapp.com buffer.com facebook.com fb.com instagram.com linkedin.com mix.com odnoklassniki.ru ok.ru pinterest.com "
    "reddit.com t.co threads.net tiktok.com tumblr.com twitter.com vk.com whatsapp.com x.com xing.com "
    "fbcdn.net giphy.com googleusercontent.com gravatar.com imgur.com substackcdn.com twimg.com wp.com youtube.com youtu.be"
).split()

#: scheme, host, port, path, query of an absolute URL; userinfo and fragment are matched and dropped.
_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@\s\[\]<>^|%]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?(?=[/?#]|\s*$)([^?#]*?)(?:\?([^#]*?))?(?:#.*?)?\s*$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def is_url(url: Column | str) -> Column:
    """Whether the URL is absolute with a host; null for null."""
    return _col(url).rlike(_PARTS)


def scheme_of(url: Column | str) -> Column:
    return F.lower(_part(_col(url), 1))


def _ascii_host(host: Column) -> Column:
    """A host in lower case, its labels beyond ASCII in their `xn--` form (IDNA 2003); null if it has none."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1)))).otherwise(F.lower(host))


def _escaped(path: Column) -> Column:
    """What a path may not hold, and all beyond ASCII, as %XX of its UTF-8 bytes; escapes that are there stay."""
    odd = r"[^\x21-\x7E]|[\x22<>\x60{}^]"
    each = F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1")).otherwise(c))
    return F.when(path.rlike(odd), F.array_join(each, "")).otherwise(path)


def is_tracking_param(name: Column) -> Column:
    return F.lower(name).isin([p.lower() for p in TRACKING_PARAMS])


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments resolved."""
    def step(acc: Column, segment: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(segment == "..", up).when(segment == ".", acc).otherwise(F.concat(acc, F.array(segment)))

    segments = F.split(path, "/")
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    resolved = F.aggregate(closed, F.array().cast("array<string>"), step, lambda a: F.array_join(a, "/"))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)


def _query(raw: Column) -> Column:
    """Parameters without those that track, in order of their names (equal names stay in order), encoded anew."""
    pair = F.transform(F.filter(F.split(raw, "&"), lambda x: x != ""), lambda x, i: _pair(x, i))
    kept = F.filter(pair, lambda p: ~is_tracking_param(p["k"]))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _pair(x: Column, i: Column) -> Column:
    key, value = F.regexp_extract(x, "^([^=]*)", 1), F.regexp_extract(x, "^[^=]*=(.*)$", 1)
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.struct(decode(key).alias("k"), i.alias("i"), decode(value).alias("v"))


def normalize_url(url: Column | str) -> Column:
    """The canonical form of an absolute URL; null if it is none.

    Scheme and host in lower case, hosts beyond ASCII as `xn--`; no userinfo, fragment or default port; dot segments
    resolved, spaces and all beyond ASCII escaped, an empty path is `/`; tracking parameters dropped and the others sorted by name and encoded alike (`?a` becomes `?a=`).
    """
    url = _col(url)
    scheme, host, port = F.lower(_part(url, 1)), _ascii_host(_part(url, 2)), _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port.cast("int") == 80)) | ((scheme == "https") & (port.cast("int") == 443))
    path = _escaped(_without_dots(F.regexp_replace(_part(url, 4), r"\\", "/")))
    query = _query(_part(url, 5))
    whole = F.concat(
        scheme, F.lit("://"), host,
        F.when(default, "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", ""))),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(is_url(url), whole)


def without_www(url: Column) -> Column:
    """A normalized URL without a leading `www.` of the host."""
    return F.regexp_replace(url, r"^([a-z][a-z0-9+.-]*://)www\.", "$1")


def in_prefix(url: Column | str, prefix: Column | str) -> Column:
    """Whether the URL falls under the prefix, both normalized, `www.` or not; false if either is no URL."""
    return F.coalesce(F.startswith(without_www(normalize_url(url)), without_www(normalize_url(prefix))), F.lit(False))


def host_of(url: Column | str) -> Column:
    """The host in lower case without one leading `www.`; null if there is none."""
    url = _col(url)
    return F.when(is_url(url), F.regexp_replace(_ascii_host(_part(url, 2)), r"^www\.", ""))


def index_host(url: Column | str) -> Column:
    """The host as the index keeps it: in lower case, `www.` kept, no port; empty if there is none."""
    url = _col(url)
    return F.coalesce(F.when(is_url(url), _ascii_host(_part(url, 2))), F.lit(""))


def ranking_domain(url: Column | str) -> Column:
    """The key of domain boosts: between `://` and the next `/`, after the last `@`, in lower case; port and `www.` stay."""
    url = _col(url)
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"^.*?://(.*)$", 1)).otherwise(url)
    return F.lower(F.element_at(F.split(F.split(rest, "/")[0], "@"), -1))


def origin_of(url: Column | str) -> Column:
    """scheme://host, with the port unless it is the default one."""
    return F.regexp_extract(normalize_url(url), r"^([a-z][a-z0-9+.-]*://[^/]*)", 1)


def default_sitemap(url: Column | str) -> Column:
    return F.concat(origin_of(url), F.lit("/sitemap.xml"))


def promoted_prefix(host: Column | str) -> Column:
    """The crawl prefix that a host suggestion is promoted to by default."""
    return F.concat(F.lit("https://"), _col(host), F.lit("/"))


def is_blacklisted(url: Column | str) -> Column:
    """Whether the host or a parent domain of it is blacklisted; false without a host. The list is fixed and short."""
    host = index_host(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(suffixes, F.array(*[F.lit(h) for h in BLACKLISTED_HOSTS]))


def paths_equivalent(a: Column, b: Column) -> Column:
    """Paths that one trailing slash at most parts."""
    return F.regexp_replace(a, "/$", "") == F.regexp_replace(b, "/$", "")


def canonical_prefix(asked: Column | str, final: Column | str, status: Column | str) -> Column:
    """What a redirect makes of a prefix: the final URL, normalized, if it answered 2xx at an equivalent path; else null."""
    asked, final, status = _col(asked), _col(final), _col(status)
    good = status.between(200, 299) & (asked != final) & paths_equivalent(_part(asked, 4), _part(final, 4))
    return F.when(is_url(asked) & good, normalize_url(final))


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href against base; null if either is null or nothing sensible comes of it. In Arrow batches: no built-in does it."""
    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h.strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def split_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links (with `target_url`, `collection_id`) with `in_prefix`: whether some target of the collection holds them.

    The prefix test needs no nested loop: equal hosts are joined first, then the longer form is compared.
    """
    url = without_www(normalize_url("target_url"))
    keyed = links.withColumn("_url", url).withColumn("_host", host_of("target_url"))
    prefixes = targets.select("collection_id", host_of("url_prefix").alias("_host"), without_www(normalize_url("url_prefix")).alias("_prefix")).filter("_prefix is not null").distinct()
    by_host = prefixes.groupBy("collection_id", "_host").agg(F.collect_set("_prefix").alias("_prefixes"))
    found = F.coalesce(F.exists("_prefixes", lambda p: F.startswith(F.col("_url"), p)), F.lit(False))
    return keyed.join(by_host, ["collection_id", "_host"], "left").withColumn("in_prefix", found).drop("_url", "_host", "_prefixes")
