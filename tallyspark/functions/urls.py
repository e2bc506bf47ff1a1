"""URLs of problems: identity keys, safety, import routes, profile handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each platform's host, profile path and importable paths.
HOSTS = {"leetcode": "leetcode.com", "codeforces": "codeforces.com", "codechef": "www.codechef.com", "geeksforgeeks": "www.geeksforgeeks.org", "code360": "www.naukri.com", "tuf": "takeuforward.org", "atcoder": "atcoder.jp"}
PROFILES = {"leetcode": "u", "codeforces": "profile", "codechef": "users", "geeksforgeeks": "profile", "code360": "code360/profile", "tuf": "profile", "atcoder": "users"}
ROUTES = {
    "leetcode": r"^/problems/[a-zA-Z0-9-]+(?:/.*)?$",
    "codeforces": r"^/(?:problemset/problem/\d+/[a-zA-Z0-9]+|(?:contest|gym)/\d+/problem/[a-zA-Z0-9]+)/?$",
    "codechef": r"^/problems/[a-zA-Z0-9_]+/?$",
    "geeksforgeeks": r"^/problems/[^/]+(?:/\d+)?/?$",
    "code360": r"^/code360/problems/[^/]+/?$",
    "tuf": r"^/(?:practice/dsa|plus/dsa/problems)/[^/]+/?$",
    "atcoder": r"^/contests/[a-zA-Z0-9_-]+/tasks/[a-zA-Z0-9_-]+/?$",
}


def part(url: Column, what: str) -> Column:
    """A part of a URL; null where it has none or cannot be parsed."""
    return F.try_parse_url(url, F.lit(what))


def path_of(url: Column) -> Column:
    """The path; / where there is none; null for what is no URL."""
    return F.when(part(url, "HOST").isNotNull(), F.when(F.coalesce(part(url, "PATH"), F.lit("")) == "", "/").otherwise(part(url, "PATH")))


def last(text: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(text, sep), -1)


def problem_key(platform: Column, url: Column) -> Column:
    """The tracker's identity of a problem page: one key for all pages of one problem."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    slug = F.nullif(F.regexp_extract(path, "/problems/([^/]*)", 1), F.lit(""))
    task = F.nullif(F.regexp_extract(path, "^/contests/[a-zA-Z0-9_-]+/tasks/([a-zA-Z0-9_-]+)$", 1), F.lit(""))
    shape = r"(?i)/(?:problemset/problem|contest|gym)/(\d+)/(?:problem/)?([a-z0-9]+)"
    number, index = F.nullif(F.regexp_extract(path, shape, 1), F.lit("")), F.upper(F.regexp_extract(path, shape, 2))
    rest = (
        F.when(path.isNull(), url)
        .when(platform.isin("leetcode", "geeksforgeeks"), F.coalesce(slug, path))
        .when(platform == "codechef", last(path))
        .when((platform == "atcoder") & task.isNotNull(), task)
        .when((platform == "codeforces") & number.isNotNull(), F.concat_ws(":", number, index))
        .otherwise(path)
    )
    return F.concat(platform, F.lit(":"), rest)


def _host(platform: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair]), platform)


def _port(url: Column) -> Column:
    return F.coalesce(part(url, "AUTHORITY"), F.lit("")).rlike(r":\d+$")


def safe_problem_url(url: Column, platform: Column) -> Column:
    """The URL if it is https on the platform's own host, else null; atcoder is also held to its task paths, without credentials or port."""
    good = (part(url, "PROTOCOL") == "https") & (part(url, "HOST") == _host(platform))
    task = part(url, "USERINFO").isNull() & ~_port(url) & path_of(url).rlike(ROUTES["atcoder"])
    return F.when(F.coalesce(good & ((platform != "atcoder") | task), F.lit(False)), url)


def import_platform(url: Column) -> Column:
    """The platform whose route a problem URL follows, else null; profiles and editorials have none."""
    host, path = F.regexp_replace(part(url, "HOST"), r"^www\.", ""), path_of(url)
    plain = (part(url, "PROTOCOL") == "https") & part(url, "USERINFO").isNull() & ~_port(url)
    out = None
    for name, route in ROUTES.items():
        hit = plain & (host == HOSTS[name].removeprefix("www.")) & path.rlike(route)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def import_url(url: Column) -> Column:
    """The canonical form of an importable URL: the platform's host, no query or fragment, leetcode cut to its problem."""
    platform, path = import_platform(url), path_of(url)
    short = F.concat(F.lit("/problems/"), F.get(F.split(path, "/"), F.lit(2)), F.lit("/"))
    return F.when(platform.isNotNull(), F.concat(F.lit("https://"), _host(platform), F.when(platform == "leetcode", short).otherwise(path)))


def import_title(url: Column, title: Column) -> Column:
    """The given title, else the slug; at most 300 characters."""
    platform, parts = import_platform(url), F.filter(F.split(path_of(import_url(url)), "/"), lambda p: p != "")
    slug = F.when(platform == "geeksforgeeks", F.get(parts, F.lit(1))).otherwise(F.element_at(parts, -1))
    return F.substring(F.trim(F.coalesce(F.nullif(title, F.lit("")), F.try_url_decode(slug))), 1, 300)


def clean_handle(platform: str, value: Column) -> Column:
    """A handle from a profile link or a typed name; null where neither is valid."""
    text = F.trim(value)
    if platform == "code360":
        text = F.when(text.rlike(r"(?i)^(?:www\.)?(?:naukri\.com|codingninjas\.com)/"), F.concat(F.lit("https://"), text)).otherwise(text)
        host = F.regexp_replace(part(text, "HOST"), r"^www\.", "")
        stem = F.regexp_replace(path_of(text), "^/+|/+$", "")
        fits = part(text, "USERINFO").isNull() & ~_port(text) & (((host == "naukri.com") & stem.rlike("^code360/profile/[^/]+$")) | ((host == "codingninjas.com") & stem.rlike("^(studio|codestudio)/profile/[^/]+$")))
    else:
        fits = (part(text, "HOST") == HOSTS[platform]) & F.regexp_replace(path_of(text), "^/+|/+$", "").rlike(f"^{PROFILES[platform]}/[^/]+$")
    linked = F.try_url_decode(last(F.regexp_replace(path_of(text), "/+$", "")))
    name = F.regexp_replace(F.when(text.rlike("(?i)^https?:"), F.when(F.coalesce(fits, F.lit(False)), linked)).otherwise(text), "^@", "")
    return F.when(name.rlike("^[a-zA-Z0-9_]{1,32}$" if platform == "atcoder" else "^[a-zA-Z0-9_.-]{1,100}$"), name)
