"""URL functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom import vocab

# host rewrite rules applied after the fragment and the trailing slashes are gone (fixed values)
HOST_RULES = [(r"smithery\.ai/servers/", "smithery.ai/server/")]


def base_url_fragment(url: Column) -> Column:
    """Everything before the first '#'."""
    return F.substring_index(url, "#", 1)


def normalize_url(url: Column, rules=HOST_RULES) -> Column:
    out = F.regexp_replace(base_url_fragment(url), "/+$", "")
    for pattern, target in rules:
        out = F.regexp_replace(out, pattern, target)
    return out


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def base_url_path(url: Column) -> Column:
    """scheme://host/path; an url without a scheme stays as it is."""
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(url, "^[^?#]*", 0)).otherwise(url)


REPO_URL = r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$"


def repo_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, REPO_URL, 1), F.lit(""))


def repo_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, REPO_URL, 2), F.lit(""))


def repo_slug(url: Column) -> Column:
    """owner/repo, or null where the url is no repository."""
    return F.concat(repo_owner(url), F.lit("/"), repo_name(url))


def repo_slug_strict(url: Column, excluded=vocab.NON_REPO_PATHS) -> Column:
    """First two path parts of any host ending in github.com, except site sections in second place."""
    host_path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*github\.com[^/?#]*/+([^?#]*)", 1)
    parts = F.split(F.regexp_replace(host_path, "/+$", ""), "/")
    owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((owner != "") & (repo != "") & ~repo.isin(*excluded), F.concat(owner, F.lit("/"), repo))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute urls stay; '//host', '/path' and 'path' are resolved against ``base``."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z]+:)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, "^[^?#]*", 0), r"(?<=[^/:]/)[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(origin, F.lit("/"))), href))
    )
