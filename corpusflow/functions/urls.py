"""URL expressions (B10, parts of B11 / B12) as regular-expression columns.

``normalize_url`` follows ``urllib.parse`` semantics: fragment dropped,
scheme lowercased (``https`` when absent), host lowercased (port and user
info kept), empty path -> ``/``, ``;params`` of the last path segment dropped,
non-empty query kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# scheme (only when followed by ':'), '//' netloc, path, '?' query; the
# fragment (from the first '#') is never captured
_URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_parts(col) -> dict:
    """Scheme (lowercased), netloc, path (without ``;params``) and query —
    one flat regular expression per part, so the expression tree stays small."""
    u = F.regexp_replace(_c(col), r"[\t\r\n]|^[\x00-\x20]+|[\x00-\x20]+$", "")
    return {
        "scheme": F.lower(F.regexp_extract(u, _URL_RE, 1)),
        "netloc": F.regexp_extract(u, _URL_RE, 2),
        "path": F.regexp_replace(F.regexp_extract(u, _URL_RE, 3), r";[^/]*$", ""),
        "query": F.regexp_extract(u, _URL_RE, 4),
    }


def normalize_url(col) -> Column:
    """B10."""
    p = url_parts(col)
    scheme = F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"])
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    base = F.concat(scheme, F.lit("://"), F.lower(p["netloc"]), path)
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(
        F.when(p["query"] != "", F.concat(base, F.lit("?"), p["query"])).otherwise(base))


def url_host(col) -> Column:
    """Lower-cased netloc (port and user info included)."""
    return F.lower(url_parts(col)["netloc"])


def url_path(col) -> Column:
    return url_parts(col)["path"]


def host_suffixes(host) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: the rule hosts a URL host can match
    (equal, or a sub-domain of).  Lets the allow-rule test be an equi-join."""
    h = _c(host)
    labels = F.split(h, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n),
                       lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
