"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Beginnings and names of query parameters that only track visitors.
TRACKING_PREFIXES = ("utm_", "cx_", "mc_", "yclid")
TRACKING_NAMES = ("fbclid", "gclid", "gclsrc", "msclkid", "igshid", "_ga", "twclid")


def host(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def clean(url: Column | str, canonical: Column | str | None = None) -> Column:
    """The page's canonical http(s) URL if it has the same host, else the URL without fragment and tracking parameters.

    Parameters keep their order and their bytes; such as have a blank value stay.
    """
    url = col(url)
    bare = F.regexp_replace(url, r"#.*$", "")
    head, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)

    def wanted(p: Column) -> Column:
        name = F.lower(F.substring_index(p, "=", 1))
        bad = name.isin(*TRACKING_NAMES)
        for x in TRACKING_PREFIXES:
            bad = bad | name.startswith(x)
        return (p != "") & ~bad

    kept = F.array_join(F.filter(F.split(query, "&"), wanted), "&")
    out = F.when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))
    if canonical is None:
        return out
    own = col(canonical)
    return F.when(own.rlike("^https?://") & (host(own) == host(url)), own).otherwise(out)


def file_name(title: Column | str, url: Column | str) -> Column:
    """A file name from the title (other characters than letters, digits, space, - and _ become _; 80 at most) or the host."""
    safe = F.substring(F.regexp_replace(F.trim(col(title)), r"[^\p{L}\p{N} _-]", "_"), 1, 80)
    return F.when(F.coalesce(safe, F.lit("")) != "", safe).otherwise(host(url))
