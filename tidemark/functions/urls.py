"""Column expressions over URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty_if_null

#: Query parameters that track a visit rather than name a page (fixed value).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "yclid", "ref")
_SCHEME = r"^(?i:https?)://(?:[^/?#@]*@)?"


def host(url: Column | str) -> Column:
    """Lower-case host without www and port; empty without one."""
    raw = F.lower(F.regexp_extract(empty_if_null(url), _SCHEME + r"([^/?#:]+)", 1))
    return F.regexp_replace(raw, r"^www\.", "")


def origin_domain(url: Column | str) -> Column:
    return F.substring(host(url), 1, 255)


def path(url: Column | str) -> Column:
    return F.regexp_extract(empty_if_null(url), _SCHEME + r"[^/?#]*([^?#]*)", 1)


def _params(url: Column | str, tracking: Sequence[str]) -> Column:
    query = F.regexp_extract(empty_if_null(url), r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*tracking))


def _port(url: Column | str) -> Column:
    port = F.regexp_extract(empty_if_null(url), _SCHEME + r"[^/?#:]+(:\d+)", 1)
    return F.when(port.isin(":80", ":443"), "").otherwise(port)


def canonical(url: Column | str, tracking: Sequence[str] = TRACKING) -> Column:
    """Storage form: https, host without www, default ports, fragment and tracking parameters
    dropped, other parameters in order, no slash at the end of the path. Null without a host."""
    params = F.array_join(_params(url, tracking), "&")
    bare = F.concat(F.lit("https://"), host(url), _port(url), F.rtrim(path(url), F.lit("/")))
    return F.when(host(url) != "", F.when(params != "", F.concat(bare, F.lit("?"), params)).otherwise(bare))


def identity(url: Column | str, tracking: Sequence[str] = TRACKING) -> Column:
    """Identity form: as canonical, without the scheme and with sorted parameters."""
    params = F.array_join(F.array_sort(_params(url, tracking)), "&")
    bare = F.concat(host(url), _port(url), F.rtrim(path(url), F.lit("/")))
    return F.when(host(url) != "", F.when(params != "", F.concat(bare, F.lit("?"), params)).otherwise(bare))


def url_hash(url: Column | str) -> Column:
    return F.sha2(canonical(url), 256)


def arxiv_id(url: Column | str) -> Column:
    """Identifier without version; null elsewhere."""
    return F.nullif(F.regexp_extract(empty_if_null(url), r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}|[a-z-]+/\d{7})", 1), F.lit(""))


def doi_of(url: Column | str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(empty_if_null(url), r"(?i)doi\.org/(10\.[^?#]+)", 1), F.lit("")))


def identity_key(url: Column | str) -> Column:
    """What names a work: arXiv identifier, else DOI, else URL."""
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv_id(url)), F.concat(F.lit("doi:"), doi_of(url)), F.concat(F.lit("url:"), identity(url)))


def in_domain(h: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    found = F.lit(False)
    for d in domains:
        found = found | (h == d) | h.endswith("." + d)
    return found


def date_of_path(url: Column | str) -> Column:
    """Date of a /YYYY/MM/DD/ or YYYY-MM-DD path, null if there is none or it isn't a day."""
    found = F.regexp_extract(path(url), r"((?:19|20)\d\d[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01]))(?!\d)", 1)
    return F.try_to_date(F.translate(F.nullif(found, F.lit("")), "/", "-"), "yyyy-MM-dd")
