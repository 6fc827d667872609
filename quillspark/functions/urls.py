"""Web addresses: canonical forms, file places and admission tests."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.arrow import arrow_udf

#: Suffixes that a stored file keeps, those that can be searched, and local names.
KEPT_SUFFIXES = [
    ".html", ".htm", ".txt", ".js", ".css", ".json", ".xml", ".md", ".rst", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico",
    ".woff", ".woff2", ".ttf", ".otf", ".eot", ".yaml", ".yml",
]
SEARCHED_SUFFIXES = [".html", ".htm", ".md", ".rst", ".txt", ".json", ".xml"]
LOCAL_SUFFIXES = [".localhost", ".local", ".internal", ".test", ".example", ".invalid", ".lan", ".home.arpa"]
MOST_PATH, MOST_NAME = 400, 100


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#;]*)", group)


def _full(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("http://"), t))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, path decoded, no query, fragment or last slash."""
    full = _full(url)
    scheme, host, path = F.lower(_part(full, 1)), F.lower(_part(full, 2)), _part(full, 3)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.regexp_replace(path, "/+$", "")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path))


def download_id(url: Column) -> Column:
    return F.md5(canonical(url))


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^.*@|:[0-9]*$", ""), "[.]+$", "")


def local_path(url: Column, base: str = "") -> Column:
    """host/<readable name, 100 characters at most>-<8 hex digits><suffix of the address, or .html>.

    Where that exceeds 400 characters, the base included, the name is ``url``; null if it still does.
    """
    c = canonical(url)
    suffix = F.lower(F.regexp_extract(_part(_full(url), 3), r"[^/.][^/]*(\.[^./]*)$", 1))
    suffix = F.when(suffix.isin(KEPT_SUFFIXES), suffix).otherwise(F.lit(".html"))
    name = F.substring(F.regexp_replace(F.regexp_replace(c, "^[a-z]+://", ""), r"[^A-Za-z0-9_-]+", "_"), 1, MOST_NAME)
    path = lambda n: F.concat(host_of(c), F.lit("/"), n, F.lit("-"), F.substring(F.sha2(c, 256), 1, 8), suffix)
    room = MOST_PATH - len(base and base.rstrip("/") + "/")
    fits = lambda n: F.length(path(n)) <= room
    return F.when(fits(name), path(name)).when(fits(F.lit("url")), path(F.lit("url")))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-]+", "_")


def has_suffix(path: Column, suffixes=tuple(SEARCHED_SUFFIXES)) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(list(suffixes))


def inside(path: Column, base: str) -> Column:
    """The path, with . and .. resolved as far as they go, lies under the base."""
    base = base.rstrip("/") + "/"
    return path.startswith(base) & ~path.rlike(r"(^|/)\.\.(/|$)")


def followable(href: Column) -> Column:
    return ~F.trim(F.lower(href)).rlike("^(#|javascript:|mailto:|tel:)") & (F.trim(href) != "")


@arrow_udf("string")
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    """The absolute form of a link; null where it has none."""

    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


@arrow_udf("boolean")
def _private_address(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            ip = ipaddress.ip_address((h or "").strip("[]"))
        except ValueError:
            return True
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return pd.Series([one(h) for h in host])


def unsafe(url: Column, allowed=()) -> Column:
    """No host, a local name or a private literal address; names aren't resolved here.

    A host that resolvers may read as an address in another form is refused: numbers that aren't
    four plain decimals (one integer, octal, hexadecimal), digits or dots beyond ASCII, blanks,
    backslashes and escapes.
    """
    host, netloc = host_of(url), _part(url, 2)
    # Before the user is cut off: a client may read a backslash as a slash, or end the host at another @.
    torn = netloc.rlike(r"[\s\\]|@.*@")
    local = (host == "") | (host == "localhost") | host.rlike("(" + "|".join(s.replace(".", r"\.") for s in LOCAL_SUFFIXES) + ")$")
    odd = host.rlike(r"[\s\\%。．｡]|[\p{Nd}&&[^0-9]]")
    plain = host.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    number = host.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$")
    literal = plain | host.rlike(r"[:\[\]]")
    test = F.when(literal, _private_address(host)).otherwise(number | odd)
    return F.when(host.isin(list(allowed)) & ~torn, F.lit(False)).otherwise(F.coalesce(torn | local | test, F.lit(True)))


def admission(url: Column, start_host: str, robots_ok: Column, path_ok: Column) -> Column:
    """The status of a link before it is fetched; the first test that fails decides."""
    return (
        F.when(unsafe(url), F.lit("failed_ssrf"))
        .when(host_of(url) != start_host, F.lit("skipped_domain"))
        .when(~robots_ok, F.lit("failed_robotstxt"))
        .when(~path_ok, F.lit("failed_internal"))
        .otherwise(F.lit("admitted"))
    )


def source_type(text: Column) -> Column:
    git = text.rlike(r"^(git@|git://)|\.git/?$|^https?://(www\.)?(github|gitlab|bitbucket)\.(com|org)/[^/]+/[^/]+")
    return F.when(git, F.lit("git")).when(text.rlike("^https?://"), F.lit("web")).otherwise(F.lit("local"))


def needs_browser(html: Column) -> Column:
    """A script framework's name in the page, or hardly anything from <body> on."""
    low = F.lower(html)
    at = F.locate("<body", low)
    return low.rlike("react|vue|angular|svelte") | (F.when(at > 0, F.length(html) - at + 1).otherwise(F.length(html)) < 1500)


@arrow_udf("boolean")
def _robots_allow(url: pd.Series, robots: pd.Series, agent: pd.Series) -> pd.Series:
    parsed: dict = {}

    def one(u, text, a):
        if not text:
            return True
        if text not in parsed:
            parsed[text] = RobotFileParser()
            parsed[text].parse(text.splitlines())
        return parsed[text].can_fetch(a, u)

    return pd.Series([one(*x) for x in zip(url, robots, agent, strict=True)])


def robots_allow(url: Column, robots_text: Column, agent: str = "*") -> Column:
    """Whether a robots file allows the address; a missing, empty or failed one allows it."""
    return _robots_allow(url, robots_text, F.lit(agent))


def origin(url: Column) -> Column:
    """Scheme and host, the key of the robots table."""
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)))
