"""URL columns: parts, resolution, normalisation and admission rules.

All of it is built-in expressions. A URL is cut into its five parts by one
pattern (the generic form in RFC 3986, appendix B).
"""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigweave.functions.text import let, trim_space

GENERIC = "(?s)\\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?(#.*)?\\z"

# Paths with these endings are files, not pages.
STATIC_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".zip", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".mov",
    ".doc", ".docx", ".xls", ".xlsx",
)
# Host names and suffixes that never leave the local network.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".home.arpa")

MAX_TARGET_CHARS = 2_048

PATH_SAFE = "[A-Za-z0-9._~$&+,/:;=@-]"
PATH_AS_WRITTEN = "\\A[A-Za-z0-9._~!$&'()*+,;=:@\\[\\]%/-]*\\z"
BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, GENERIC, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Host without user, password, port or brackets."""
    bare = F.regexp_replace(authority(url), "\\A.*@", "")
    return F.when(
        bare.startswith("["), F.regexp_extract(bare, "\\A\\[([^\\]]*)\\]", 1)
    ).otherwise(F.regexp_replace(bare, ":[0-9]*\\z", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _clean_path(raw: Column) -> Column:
    """Remove ``.`` and ``..`` steps; only paths that have them pay for it."""
    folded = F.aggregate(
        F.filter(F.split(raw, "/", -1), lambda _, i: i > 0),
        F.array().cast("array<string>"),
        lambda kept, step: F.when(step == ".", kept)
        .when(step == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.array_append(kept, step)),
    )
    closed = F.when(raw.rlike("/\\.{1,2}\\z"), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(raw.rlike("(\\A|/)\\.{1,2}(/|\\z)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(raw)


def encode_path(raw: Column) -> Column:
    """Percent-encode a path unless every character may stand as written."""
    plain = F.when(
        raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    ).otherwise(raw)
    encoded = F.array_join(
        F.transform(
            F.split(plain, ""),
            lambda c: F.when(c.rlike(PATH_SAFE), c).when(c == " ", F.lit("%20")).when(c == "*", F.lit("%2A")).otherwise(F.url_encode(c)),
        ),
        "",
    )
    return F.when(raw.rlike(PATH_AS_WRITTEN), raw).otherwise(encoded)


def _split(url: Column) -> Column:
    """The five parts of a URL as one struct."""
    return F.struct(
        F.lower(_part(url, 1)).alias("scheme"), _part(url, 2).alias("authority"), _part(url, 3).alias("path"),
        _part(url, 4).alias("query"), _part(url, 5).alias("fragment"), url.alias("text"),
    )


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` on the page ``base``; NULL when not a URL."""
    return let(F.struct(_split(base).alias("b"), _split(link).alias("l")), lambda x: _resolve(x["b"], x["l"]))


def _resolve(b: Column, own: Column) -> Column:
    base_path = F.when(b["path"] == "", "/").otherwise(b["path"])
    joined = (
        F.when(own["path"] == "", base_path)
        .when(own["path"].startswith("/"), own["path"])
        .otherwise(F.concat(F.regexp_replace(base_path, "[^/]*\\z", ""), own["path"]))
    )
    query_kept = F.when((own["path"] == "") & (own["query"] == ""), b["query"]).otherwise(own["query"])
    has_host = own["text"].rlike("\\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    parts = F.struct(
        F.when(own["scheme"] != "", own["scheme"]).otherwise(b["scheme"]).alias("scheme"),
        F.when(has_host, own["authority"]).otherwise(b["authority"]).alias("authority"),
        _clean_path(F.when(has_host, own["path"]).otherwise(joined)).alias("path"),
        F.when(has_host, own["query"]).otherwise(query_kept).alias("query"),
    )
    web = let(parts, lambda p: F.concat(p["scheme"], F.lit("://"), p["authority"], encode_path(p["path"]), p["query"], own["fragment"]))
    opaque = (own["scheme"] != "") & ~has_host
    broken = own["text"].rlike("[\\x00-\\x1f\\x7f]") | own["path"].rlike(BAD_ESCAPE) | own["text"].startswith(":")
    return F.when(broken, F.lit(None)).when(opaque, F.concat(own["scheme"], F.lit(":"), own["path"], own["query"], own["fragment"])).otherwise(web)


def normalize(url: Column) -> Column:
    """Without fragment and without one trailing slash of a non-root path."""
    bare = F.regexp_replace(url, "#.*\\z", "")
    return F.regexp_replace(bare, "\\A([^?]*?://[^/?]*/[^?]*?)/(\\?.*)?\\z", "$1$2")


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def has_credentials(url: Column) -> Column:
    """User name or password; an empty ``@`` part does not count."""
    return authority(url).rlike("\\A[^@]*[^:@][^@]*@")


def site(hostname: Column) -> Column:
    """Last two labels of a host name."""
    labels = F.split(hostname, "\\.", -1)
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(hostname)


def same_site(hostname: Column, base: Column) -> Column:
    return (hostname == base) | F.endswith(hostname, F.concat(F.lit("."), base))


def is_static(url_path: Column) -> Column:
    lowered = F.lower(url_path)
    found = F.lit(False)
    for ending in STATIC_EXTENSIONS:
        found = found | lowered.endswith(ending)
    return found


# Address blocks that are not public.
CLOSED_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
]


def is_blocked_ipv4(hostname: Column) -> Column:
    """Dotted address in a loopback, private, reserved or multicast block."""
    octets = F.transform(F.split(hostname, "\\."), lambda o: o.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o)
    dotted = hostname.rlike("\\A\\d{1,3}(\\.\\d{1,3}){3}\\z") & (F.array_max(octets) <= 255)
    blocks = [ipaddress.ip_network(n) for n in CLOSED_NETWORKS]
    closed = reduce(or_, [number.between(int(n[0]), int(n[-1])) for n in blocks])
    return F.coalesce(F.when(dotted, closed), F.lit(False))


#: The same for the longer addresses.
CLOSED_PREFIXES = ["::/128", "::1/128", "::ffff:0:0/96", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8"]


def _hex_groups(groups: Column) -> Column:
    return F.array_join(F.transform(F.array_remove(F.split(groups, ":"), ""), lambda g: F.lpad(g, 4, "0")), "")


def _digits(address: Column, dotted: Column) -> Column:
    """An address written in full, as 32 hexadecimal digits; other texts if it is malformed."""
    octets = F.transform(F.split(dotted, "\\."), lambda o: F.lower(F.lpad(F.hex(o.try_cast("long")), 2, "0")))
    last = F.when(dotted != "", F.array_join(octets, "")).otherwise("")
    groups = F.regexp_replace(address, "\\d+\\.\\d+\\.\\d+\\.\\d+\\z", "")
    left = _hex_groups(F.substring_index(groups, "::", 1))
    right = F.concat(F.when(groups.contains("::"), _hex_groups(F.substring_index(groups, "::", -1))).otherwise(""), last)
    gap = F.when(groups.contains("::"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 32 - F.length(left) - F.length(right)))).otherwise("")
    return F.concat(left, gap, right)


def is_blocked_ipv6(hostname: Column) -> Column:
    """Address in a loopback, private, reserved or multicast block, or no address at all. An
    address that ends in a dotted one is as public as that."""
    dotted = F.regexp_extract(hostname, "(\\d+\\.\\d+\\.\\d+\\.\\d+)\\z", 1)
    blocks = [ipaddress.ip_network(n) for n in CLOSED_PREFIXES]
    told = let(_digits(hostname, dotted), lambda d: ~d.rlike("\\A[0-9a-f]{32}\\z") | reduce(or_, [d.between(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in blocks]))
    return hostname.contains(":") & (told | ((dotted != "") & is_blocked_ipv4(dotted)))


def is_public(url: Column) -> Column:
    """http(s), no credentials, and a host outside local and reserved ranges."""
    facts = F.struct(
        scheme(url).alias("scheme"), has_credentials(url).alias("credentials"),
        F.regexp_replace(F.lower(host(url)), "\\.+\\z", "").alias("host"))
    return let(facts, lambda u: (
        u["scheme"].isin("http", "https") & ~u["credentials"] & (u["host"] != "") & ~_is_local(u["host"])
        & ~is_blocked_ipv4(u["host"]) & ~is_blocked_ipv6(u["host"])))


def _is_local(name: Column) -> Column:
    local = name.isin(*LOCAL_HOSTS)
    for suffix in LOCAL_SUFFIXES:
        local = local | name.endswith(suffix)
    return local


def target(url: Column) -> Column:
    """A batch target as it is queued: trimmed, no fragment, host in lower case,
    an empty path as ``/``; NULL when it is not an admissible address."""
    text = F.regexp_replace(trim_space(url), "#.*\\z", "")
    return let(_split(text), lambda u: let(
        F.concat(u["scheme"], F.lit("://"), F.lower(u["authority"]),
                 F.when(u["path"] == "", "/").otherwise(encode_path(_clean_path(u["path"]))), u["query"]),
        lambda href: F.when(
            u["scheme"].isin("http", "https") & ~u["text"].rlike("\\A[^:]*:/*[^/?#]*[\\s<>^|%]")
            & (host(u["text"]) != "") & ~has_credentials(u["text"]) & (F.length(href) <= MAX_TARGET_CHARS), href)))
