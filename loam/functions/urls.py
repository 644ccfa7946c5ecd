"""URL and host functions as columns; exact normalisation as an Arrow UDF."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

URL = r"^(?i:(https?))://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once: the value is bound as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def alternation(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 3)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 4)


def site_key(host: Column) -> Column:
    """What subdomains have in common: the last two labels, or three under a two-level suffix."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host).when(last(2).isin(V.TWO_LEVEL_SUFFIXES), last(3)).otherwise(last(2))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under(host: Column, domain: str) -> Column:
    """The host is the domain or below it."""
    return (host == domain) | host.endswith("." + domain)


def is_tracking(site: Column, name: Column) -> Column:
    """Whether a (lower-case) query parameter only tracks on a site."""
    return _any([name.isin(V.TRACKING_PARAMS), *(site.startswith(s) & name.isin(p) for s, p in V.SITE_TRACKING_PARAMS.items())])


def query_pairs(query: Column) -> Column:
    """array<struct<name, value>> as written, without empty pairs."""
    whole = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(whole, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")))


def normalize(url: Column) -> Column:
    """Canonical form of a URL whose query needs no decoding; NULL for other schemes, credentials and no host.

    Lower-case scheme and host, no default port, no fragment, no tracking
    parameters, the others in order of name and value.
    """
    host, port = host_of(url), F.regexp_extract(authority(url), r":(\d+)$", 1)
    default = F.when(scheme(url) == "http", "80").otherwise("443")
    site = site_key(host)
    kept = F.array_sort(F.filter(query_pairs(query_of(url)), lambda p: ~is_tracking(site, F.lower(p["name"]))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    built = F.concat(scheme(url), F.lit("://"), host, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((host != "") & ~F.contains(authority(url), F.lit("@")), built)


def ipv4_number(host: str) -> int | None:
    """The address that a host spells in one to four decimal, octal or hexadecimal numbers, the last of which fills what is left."""
    parts = host.removesuffix(".").split(".")
    if not 1 <= len(parts) <= 4:
        return None
    numbers = []
    for p in parts:
        base = 16 if p[:2].lower() == "0x" else 8 if len(p) > 1 and p[0] == "0" else 10
        digits = p[2:] if base == 16 else p
        try:
            numbers.append(int(digits or "0", base) if p and digits.isascii() and digits.isalnum() or (base == 16 and not digits) else int("x"))
        except ValueError:
            return None
    *high, last = numbers
    if any(n > 255 for n in high) or last >= 256 ** (4 - len(high)):
        return None
    return sum(n << 8 * (3 - i) for i, n in enumerate(high)) + last


def spelled_host(host: str) -> str | None:
    """A host in its canonical spelling: lower-case, international labels in ASCII, addresses of either version in their usual form."""
    import ipaddress as ip

    if host.startswith("["):
        if "%" in host or not host.endswith("]"):
            return None
        try:
            return f"[{ip.IPv6Address(host.strip('[]')).compressed}]"
        except ValueError:
            return None
    host = unquote(host).lower()
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", host):
        return None
    number = ipv4_number(host)
    if number is not None:
        return str(ip.IPv4Address(number))
    last = host.removesuffix(".").rpartition(".")[2]
    return None if last.isdigit() or re.fullmatch("0x[0-9a-f]*", last) else host


def normalize_text(url: str | None) -> str | None:
    """Canonical form of any URL, with decoded and re-encoded query, resolved dot segments and canonical host."""
    found = re.match(r"(?is)\s*(https?):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?", (url or "").translate(_DROPPED))
    if not found:
        return None
    scheme, netloc, path, query = found[1].lower(), found[2], found[3].replace("\\", "/"), (found[4] or "").strip()
    if "@" in netloc:
        return None
    name, colon, port = netloc.strip().rpartition(":") if not netloc.strip().endswith("]") else (netloc.strip(), "", "")
    name, port = (name, port) if colon else (port or name, "")
    host = spelled_host(name)
    if host is None or (port and not (port.isascii() and port.isdigit() and int(port) < 65536)):
        return None
    labels = host.split(".")
    site = host if len(labels) <= 2 else ".".join(labels[-3:] if ".".join(labels[-2:]) in V.TWO_LEVEL_SUFFIXES else labels[-2:])
    drop = set(V.TRACKING_PARAMS).union(*(p for s, p in V.SITE_TRACKING_PARAMS.items() if site.startswith(s)))
    pairs = sorted((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in drop)
    path = urlsplit(urljoin("http://h/", quote(path.strip() if not query and found[4] is None else path or "/", safe="/%:@!$&'()*+,;=~-._[]|") or "/")).path or "/"
    where = host if not port or int(port) == {"http": 80, "https": 443}[scheme] else f"{host}:{int(port)}"
    form = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    return f"{scheme}://{where}{path}" + ("?" + "&".join(f"{form(k)}={form(v)}" for k, v in pairs) if pairs else "")


#: Tabs and line ends are no part of a URL.
_DROPPED = dict.fromkeys(map(ord, "\t\n\r"))
#: URLs that built-in functions bring into canonical form as well: plain ASCII hosts that are no addresses, plain paths without dot segments, plain queries.
PLAIN = r"^(?i:https?)://(?:[A-Za-z0-9-]+\.)*[A-Za-z][A-Za-z0-9-]*(?::[1-9]\d{0,3})?(?:/(?!\.{1,2}(?:[/?#]|$))[A-Za-z0-9_~!$&'()*+,;=:@-][A-Za-z0-9._~!$&'()*+,;=:@-]*)*/?(?:\?(?:[A-Za-z0-9_.-]+=[A-Za-z0-9_.*-]*(?:&[A-Za-z0-9_.-]+=[A-Za-z0-9_.*-]*)*)?)?(?:#.*)?$"


def canonical(url: Column) -> Column:
    """Canonical form of any URL: built-in functions for plain ones, Python for the others.

    It is worked out once where it is selected: the optimizer does not copy it
    into the conditions that come after.
    """
    plain = url.rlike(PLAIN)
    return F.when(plain, normalize(url)).otherwise(_exact_once(F.when(~plain, url)))


@F.pandas_udf(T.StringType())
def normalize_exact(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_text)


@F.pandas_udf(T.StringType())
def _exact_once(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_text)


_exact_once = _exact_once.asNondeterministic()  # only so that the optimizer leaves it in its place


@F.pandas_udf(T.LongType())
def url_key(urls: pd.Series) -> pd.Series:
    """XXH3-64 of a canonical URL, as a signed integer."""
    import xxhash

    return urls.map(lambda u: None if u is None else (h := xxhash.xxh3_64_intdigest(u)) - ((h >> 63) << 64))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _leaf(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def looks_generated(segment: Column) -> Column:
    """Long hexadecimal or mixed names, as machines make them."""
    s = F.lower(segment)
    return s.rlike("^[0-9a-f]{20,}$") | (s.rlike("^[0-9a-z]{24,}$") & s.rlike("[0-9]"))


def parts(url: Column) -> Column:
    """struct<host, path, query, low> of a URL: low is the path in lower case."""
    path = path_of(url)
    return F.struct(host_of(url).alias("host"), path.alias("path"), query_of(url).alias("query"), F.lower(path).alias("low"))


def skip_url(url: Column) -> Column:
    """URLs that are not followed."""
    families = alternation(V.WIKI_FAMILIES)

    def of(u: Column) -> Column:
        host, path, low = u["host"], u["path"], u["low"]
        edition = F.regexp_extract(host, r"^([^.]*)(?:\..*)?\.(?:" + families + ")$", 1)

        def of_lists(x: Column) -> Column:
            tests = [
                (host == "web.archive.org") & path.rlike("^/(web|save)/"),
                host.rlike(r"\.(?:" + families + ")$") & ~edition.isin(V.WIKI_EDITIONS),
                F.contains(path, F.lit("/w/index.php")),
                _leaf(path).rlike("^(?:" + alternation(V.WIKI_NAMESPACES) + ")"),
                low.rlike("(?:" + alternation(V.SKIPPED_EXTENSIONS) + ")$"),
                low.rlike(alternation(V.SKIPPED_FRAGMENTS + V.TRAP_FRAGMENTS)),
                low.endswith("/login"),
                F.size(x["parts"]) > 10,
                F.octet_length(path) > 220,
                F.size(F.filter(x["parts"], looks_generated)) >= 2,
                F.exists(x["names"], lambda n: n.isin(V.SESSION_PARAMS + V.COPY_PARAMS)),
                F.size(x["names"]) > 10,
            ]
            return _any(tests)

        names = F.transform(query_pairs(u["query"]), lambda p: F.lower(p["name"]))
        return let(F.struct(segments(path).alias("parts"), names.alias("names")), of_lists)

    return let(parts(url), of)


def is_sitemap_url(url: Column) -> Column:
    """Paths that robots files name as inventories; they are fetched though their ending is one that is skipped."""
    low = F.lower(path_of(url))
    return F.contains(low, F.lit("sitemap")) & low.rlike(r"\.xml(\.gz)?$")


def skip_index_url(url: Column) -> Column:
    """URLs that are followed and not indexed."""
    path, query = path_of(url), query_of(url)
    parts = F.transform(segments(path), F.lower)
    n = F.size(parts)
    first, last, before = F.get(parts, F.lit(0)), F.get(parts, n - 1), F.get(parts, n - 2)
    year = lambda s: s.rlike("^(19[0-9][0-9]|20[0-9][0-9]|2100)$")
    short = lambda s: s.rlike("^[0-9]{1,2}$")
    tests = [
        (host_of(url) == "web.archive.org") & path.startswith("/web/"),
        _leaf(path).rlike("^(?:" + alternation(V.HUB_NAMESPACES) + ")"),
        F.array_contains(parts, "amp"),
        F.exists(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda s: s.isin(V.LISTING_SEGMENTS)),
        first.isin(V.AUTH_SEGMENTS) | last.isin(V.AUTH_SEGMENTS),
        (n >= 2) & first.isin(V.PROFILE_SEGMENTS),
        year(last) | (short(last) & (n >= 2) & (year(before) | short(before))),
        F.contains(query, F.lit("replytocom")) | query.startswith("s=") | F.contains(query, F.lit("&s=")) | F.contains(query, F.lit("share=")),
    ]
    return _any([F.coalesce(t, F.lit(False)) for t in tests])


def bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^(www\.)+", "")


def is_media_host(host: Column) -> Column:
    h = bare(host)
    return _any([h.isin(V.MEDIA_HOSTS), *(h.endswith(e) for e in V.MEDIA_ENDINGS)])


def is_wiki_host(host: Column) -> Column:
    h = bare(host)
    return _any([h.isin(V.WIKI_HOSTS), *(h.endswith(e) for e in V.WIKI_ENDINGS)])


def is_forum_path(path: Column) -> Column:
    return F.lower(path).rlike(alternation(V.FORUM_FRAGMENTS))


def host_quality(host: Column) -> Column:
    """Weight of a host: its first tier's, else 1."""
    s = suffixes(bare(host))
    out = F
    for weight, domains in V.HOST_TIERS:
        out = out.when(F.arrays_overlap(s, F.array(*[F.lit(d) for d in domains])), F.lit(weight))
    return out.otherwise(F.lit(1.0)).cast("double")


def public_ipv4(ip: Column) -> Column:
    """Whether a dotted IPv4 address is public; NULL if it is none."""
    o = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b, c = (F.get(o, F.lit(i)) for i in range(3))
    good = (F.size(o) == 4) & ~F.exists(o, lambda x: x.isNull() | (x < 0) | (x > 255))
    private = _any([
        a.isin(0, 10, 127), a.between(224, 239), (a == 172) & b.between(16, 31), (a == 192) & (b == 168), (a == 169) & (b == 254), ip == "255.255.255.255",
        (a == 192) & (b == 0) & (c == 2), (a == 198) & (b == 51) & (c == 100), (a == 203) & (b == 0) & (c == 113), (a == 100) & b.between(64, 127), (a == 198) & b.isin(18, 19),
    ])
    return F.when(good, ~private)


@F.pandas_udf(T.BooleanType())
def public_ip(ips: pd.Series) -> pd.Series:
    """Whether an address of either version is public; NULL if it is none."""
    import ipaddress as ip

    nets4 = [ip.ip_network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 255.255.255.255/32".split()]
    nets6 = [ip.ip_network(n) for n in "::1/128 ::/128 ff00::/8 fc00::/7 fe80::/10".split()]

    def test(text: str | None) -> bool | None:
        try:
            a = ip.ip_address(text)
        except ValueError:
            return None
        return not any(a in n for n in (nets4 if a.version == 4 else nets6))

    return ips.map(test)


@F.pandas_udf(T.StringType())
def spelled(hosts: pd.Series) -> pd.Series:
    """Canonical spelling of hosts; an address of version 6 loses its brackets."""
    return hosts.map(lambda h: None if h is None else (spelled_host(h) or "").strip("[]"))


def url_is_public(url: Column) -> Column:
    """http(s) URLs whose host is not localhost nor a private literal address, however it is spelled; names are taken as public."""
    host = host_of(url)
    name = host.rlike(r"^(?:[a-z0-9_-]+\.)*[a-z][a-z0-9_-]*$") & ~host.rlike(r"(?:^|\.)0x[0-9a-f]*$")
    odd = spelled(F.when(~name, host))
    literal = F.coalesce(public_ip(F.when(~name, odd)), F.lit(True))
    local = lambda h: (h == "localhost") | h.endswith(".localhost")
    return F.when(scheme(url) == "", False).when(name, ~local(host)).otherwise(F.coalesce((odd != "") & ~local(odd) & literal, F.lit(False)))
