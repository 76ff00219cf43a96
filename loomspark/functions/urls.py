"""Hosts and sites of urls, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optional scheme or //, optional user, host, optional port; then path, query, fragment or nothing.
_WITH_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@\s]*@)?([^/?#:@\s\[\]]+)(?::\d*)?(?:[/?#\\].*)?$"
_BARE = r"^(?:[^/?#@\s:]+(?::[^/?#@\s]*)?@)?([^/?#:@\s\[\]]+[.。．｡][^/?#:@\s\[\]]+?)(?::\d+)?(?:[/?#\\].*)?$"
_SPACE = r"[\s ​﻿]+"


def host_of(url: Column) -> Column:
    """Host of a url in lower case and ASCII form, however the url is written; null if it names none.

    Spaces around, scheme or none, user, port and a final dot do not matter. Without a scheme a host
    needs a dot. A label that may not stand in a host (blank, other signs) gives null.
    """
    text = F.regexp_replace(F.regexp_replace(url, "^" + _SPACE, ""), _SPACE + "$", "")
    raw = F.coalesce(
        F.nullif(F.regexp_extract(text, "(?s)" + _WITH_SCHEME, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, "(?s)" + _BARE, 1), F.lit("")),
    )
    lowered = F.lower(raw)
    ascii_form = F.when(lowered.rlike(r"^[\x00-\x7f]*$"), lowered).otherwise(
        F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), lowered))
    )
    host = F.regexp_replace(ascii_form, r"\.+$", "")
    return F.when(host.rlike(r"^[a-z0-9_](?:[a-z0-9_\-]*)(?:\.[a-z0-9_][a-z0-9_\-]*)*$"), host)


def site_of(url: Column) -> Column:
    """Last two labels of the host (see host_of), or null."""
    return F.substring_index(host_of(url), ".", -2)
