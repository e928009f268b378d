"""URL keys as Spark expressions.

``normalize_url`` covers http and https: scheme and host in lower case, no default
port, no fragment, one trailing slash of the path dropped, parameters sorted by
name (stable) and written as ``name=value`` with ``+`` for a space. Any other text
is its own key. Not covered: dot segments, percent-encoding of raw characters and
international host names, which stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HTTP = r"^[ \t\r\n]*((?i:https?))://([^/?#\\ ]+)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
#: A trailing slash is dropped, an absent path is one.
_LAST_SLASH = r"/$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _HTTP, n)


def authority(url: Column) -> Column:
    """Lower-cased authority without the scheme's default port."""
    host = F.lower(_part(url, 2))
    return F.when(F.lower(_part(url, 1)) == "http", F.regexp_replace(host, ":80$|:$", "")).otherwise(F.regexp_replace(host, ":443$|:$", ""))


def sorted_query(query: Column) -> Column:
    """Parameters sorted by name, ties in their order; empty if there are none."""
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x, i: F.struct(F.replace(F.substring_index(x, "=", 1), F.lit("%20"), F.lit("+")).alias("name"), i.alias("at"), F.replace(F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))), F.lit("%20"), F.lit("+")).alias("text")))
    return F.array_join(F.transform(F.array_sort(named), lambda x: x["text"]), "&")


def normalize_url(url: Column) -> Column:
    path = F.regexp_replace(_part(url, 3), _LAST_SLASH, "")
    query = sorted_query(_part(url, 4))
    text = F.concat(F.lower(_part(url, 1)), F.lit("://"), authority(url), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.regexp_like(url, F.lit(_HTTP)), text).otherwise(url)


def extract_domain(url: Column) -> Column:
    """Host name; the whole text if it is no URL; empty for URLs without a host, such as mailto."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[ \t\r\n]*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)), r"^[^@]*@|:\d*$", "")
    return F.when(host != "", host).when(F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")), F.lit("")).otherwise(url)
