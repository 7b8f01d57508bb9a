"""URL normalization as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that say where a reader came from, not what a page is.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "share_token", "chksm", "scene", "pos", "shareid", "src", "sid", "tt_from", "group_id")
#: Schemes whose URLs have an authority.
WITH_HOST = ("", "http", "https", "ftp", "sftp", "file", "ws", "wss")
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_EDGES = r"(?U)^[\s\x00-\x1f]+|[\s\x1c-\x1f]+$"


def _decoded(part: Column) -> Column:
    """Plus signs as spaces and percent escapes as UTF-8; a percent sign that starts no escape stays."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    """Letters, digits and ``_.-~`` stay, a space becomes a plus sign, all else is percent-encoded."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme (https if none) and authority; no tracking or blank parameters, fragment or slash at the end.

    A parameter is split at its first equals sign; names and values are decoded and encoded anew, so that spellings of
    one page agree. Null is the empty URL. An authority with an unmatched bracket is no URL: its text is only trimmed.
    """
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), _EDGES, "")
    u = F.translate(bare, "\t\r\n", "")
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    scheme, host, path, query = F.lower(part(1)), part(2), part(3), part(4)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"), (F.instr(p, "=") > 0).alias("both")))
    kept = F.filter(pairs, lambda p: p["both"] & (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    start = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"))
    authority = F.when((host == "") & ~scheme.isin(*WITH_HOST), "").otherwise(F.concat(F.lit("//"), F.lower(host), F.when((trimmed != "") & ~F.startswith(trimmed, F.lit("/")), "/").otherwise("")))
    whole = F.concat(start, authority, trimmed, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(host.rlike(r"^[^\[]*\]|\[[^\]]*$"), bare).otherwise(whole)
