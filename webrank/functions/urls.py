"""The three URL normalizers, hashes and hosts, as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrank.config import TRAP_QUERY_KEYS, Settings

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5


def part(url: Column, which: int) -> Column:
    """A part of a URL; scheme in lower case; empty if there is none."""
    got = F.coalesce(F.regexp_extract(clean(url), SPLIT, which), F.lit(""))
    return F.lower(got) if which == SCHEME else got


def clean(url: Column) -> Column:
    """Without the leading and trailing control characters and blanks, and the tabs and line ends, that parsers drop."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def unparsable(url: Column) -> Column:
    """Square brackets of the network location that don't match."""
    netloc = part(url, NETLOC)
    return netloc.contains("[") != netloc.contains("]")


def without_port(netloc: Column, scheme: Column) -> Column:
    plain = F.when((scheme == "http") & netloc.endswith(":80"), F.regexp_replace(netloc, ":80$", ""))
    return plain.when((scheme == "https") & netloc.endswith(":443"), F.regexp_replace(netloc, ":443$", "")).otherwise(netloc)


def joined(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((netloc != "") | path.startswith("//"), F.concat(F.lit("//"), netloc)).otherwise(""),
        rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def normalize_index(url: Column) -> Column:
    """Canonical URL of the index: no fragment, no default port, no trailing slash but the root's; query untouched.

    Empty for a null, an empty or an unparsable URL.
    """
    scheme = part(url, SCHEME)
    netloc = without_port(F.lower(part(url, NETLOC)), scheme)
    path = F.regexp_replace(part(url, PATH), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.when(url.isNull() | (url == "") | unparsable(url), "").otherwise(joined(scheme, netloc, path, part(url, QUERY)))


def query_pairs(query: Column, keep_case: bool = False) -> Column:
    """Array of struct(key, value): decoded pairs that have a value; keys in lower case."""
    # url_decode turns + to blanks and fails on stray %; those are escaped first.
    decode = lambda x: F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    raw = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x.rlike("(?s)^[^=]*=."))
    key = lambda x: decode(F.regexp_extract(x, "(?s)^([^=]*)=", 1))
    return F.transform(raw, lambda x: F.struct((key(x) if keep_case else F.lower(key(x))).alias("key"), decode(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def encode(text: Column) -> Column:
    """Form encoding that leaves letters, digits and _ . - ~ alone."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\*", "%2A"), "%7E", "~")


def normalize_crawl(url: Column, settings: Settings = Settings()) -> Column:
    """Canonical URL of the crawler: as the index's, but query keys are lower-cased, trap keys and blank values
    dropped, pairs sorted and cut to the first max_params; a query of more than max_query characters goes."""
    scheme = part(url, SCHEME)
    netloc = without_port(F.lower(part(url, NETLOC)), scheme)
    raw = part(url, PATH)
    path = F.when((raw == "") | (raw == "/"), "/").otherwise(F.regexp_replace(raw, "/+$", ""))
    traps = F.array(*map(F.lit, TRAP_QUERY_KEYS))
    pairs = F.filter(query_pairs(part(url, QUERY)), lambda p: ~F.array_contains(traps, p["key"]))
    pairs = F.slice(F.array_sort(pairs), 1, settings.max_params)
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"]))), "&")
    query = F.when(F.length(query) > settings.max_query, "").otherwise(query)
    return F.when(url.isNull() | unparsable(url), F.lit(None).cast("string")).otherwise(joined(scheme, netloc, path, query))


def canonical_for_count(url: Column) -> Column:
    """The crawler's canonical URL, or the URL itself where that fails."""
    return F.coalesce(normalize_crawl(url), url)


def normalize_frontier(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def url_hash(url: Column) -> Column:
    """SHA-256 of a URL's parts but its scheme: http and https are one."""
    path, params = F.regexp_extract(part(url, PATH), r"(?s)^((?:.*/)?[^;/]*)(?:;([^/]*))?$", 1), F.regexp_extract(part(url, PATH), r"(?s)^(?:.*/)?[^;/]*;([^/]*)$", 1)
    return F.sha2(F.concat_ws("/", part(url, NETLOC), path, params, part(url, QUERY), part(url, FRAGMENT)), 256)


def hostname(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(part(url, NETLOC), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    return F.when(host != "", host)


def host_for_count(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(hostname(url), F.lit("")), r"^www\.", "")


def file_name(url: Column) -> Column:
    """The name of a page's file; sorted names are the scan order."""
    return F.concat(F.sha1(url), F.lit(".json"))


def valid_seed(url: Column) -> Column:
    return part(url, SCHEME).isin("http", "https") & (part(url, NETLOC) != "")


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, url: pd.Series) -> pd.Series:
    """Absolute URL of a reference; null where it can't be parsed."""

    def one(b, u):
        try:
            return urljoin(b or "", u or "")
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, url)], index=url.index, dtype=object)
