"""Pages, feeds and sitemaps: what they say and what they link to."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

_KINDS = {"title": T.StringType(), "description": T.StringType(), "text": T.StringType(), "links": T.ArrayType(T.StringType()), "noindex": T.BooleanType(), "nofollow": T.BooleanType(), "canonical": T.StringType()}
PAGE = T.StructType([T.StructField(k, t) for k, t in _KINDS.items()])
TEXT_BYTES = 64 * 1024
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_ROOM = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"div", "td", "th", "li", "section", "article", "body"}}


class _Page(HTMLParser):
    """One pass over a page; open elements are a stack, each with whether its text is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, dropped, in an infobox
        self.text: list[str] = []
        self.infobox: list[str] = []
        self.hrefs: list[str] = []
        self.meta: dict[str, str] = {}
        self.canonical: str | None = None
        self.first: dict[str, list[str]] = {}
        self.scripts: list[str] = []
        self.sink: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        classes = a.get("class", "").split()
        if tag == "a" and "href" in a:
            self.hrefs.append(a["href"])
        elif tag == "meta":
            name = f"name:{a['name']}" if a.get("name") in ("robots", "description") else f"property:{a['property']}" if a.get("property") in ("og:title", "og:description") else ""
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "")
        elif tag == "link" and a.get("rel") == "canonical" and self.canonical is None:
            self.canonical = a.get("href", "")
        if tag in _VOID:
            return
        for other in [*self._implied(tag)]:
            self._close(other)
        above = self.open[-1] if self.open else ("", False, False)
        dropped = (
            tag in V.DROPPED_TAGS or a.get("id") in V.DROPPED_IDS or a.get("role") in V.DROPPED_ROLES or not set(V.DROPPED_CLASSES).isdisjoint(classes) or any(tag == t and c in classes for t, c in V.DROPPED_TAG_CLASSES)
        )
        box = tag == "table" and "infobox" in classes
        self.open.append((tag, above[1] or dropped, above[2] or box))
        if tag in ("title", "h1") and tag not in self.first:
            self.first[tag] = []
            self.sink.append((tag, self.first[tag]))
        if tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append("")

    def _implied(self, tag: str) -> Iterator[str]:
        """The open element that a new one closes, if there is one within reach."""
        for name, _, _ in reversed(self.open):
            if name in _CLOSES.get(tag, ()):
                yield name
                return
            if name in _ROOM.get(tag, ()):
                return

    def _close(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                name = self.open.pop()[0]
                if self.sink and self.sink[-1][0] == name:
                    self.sink.pop()
                if name == tag:
                    return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        tag, dropped, box = self.open[-1] if self.open else ("", False, False)
        for _, into in self.sink:
            into.append(data)
        if tag == "script" and self.scripts:
            self.scripts[-1] += data
        if (line := data.strip()) and not dropped:
            self.text.append(line)
        if line and box:
            self.infobox.append(line)


def _linked_data(value: object) -> tuple[str, str] | None:
    """Title and description of the first described work in JSON-LD."""
    if isinstance(value, list):
        return next((found for v in value if (found := _linked_data(v))), None)
    if not isinstance(value, dict):
        return None
    if "@graph" in value:
        return _linked_data(value["@graph"])

    def known(kind: object) -> bool:
        return any(map(known, kind)) if isinstance(kind, list) else isinstance(kind, str) and kind.endswith(tuple(V.JSON_LD_KINDS))

    if not known(value.get("@type")):
        return None
    said = lambda x: x.strip() if isinstance(x, str) else ""
    found = said(value.get("headline", value.get("name"))), said(value.get("description"))
    return found if any(found) else None


def head(text: str, size: int) -> str:
    """The first bytes of a text, whole characters."""
    return text.encode("utf-8", "surrogatepass")[:size].decode("utf-8", "ignore")


def _join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def extract_page(html: str | None, base: str | None) -> dict:
    """What PAGE lists.  Title and description: the page's own, then Open Graph, a heading, JSON-LD."""
    page = _Page()
    page.feed(html or "")
    page.close()
    linked: tuple[str, str] = ("", "")
    for raw in page.scripts:
        try:
            found = _linked_data(json.loads(raw.strip()))
        except ValueError:
            continue
        if found:
            linked = found
            break
    first = lambda *options: next((x.strip() for x in options if x.strip()), "")
    robots = page.meta.get("name:robots", "").lower()
    text = "".join(f"{x} " for x in page.text)
    for lead in V.TEXT_LEADS:
        text = text.removeprefix(lead)
    if page.infobox:
        text += " ".join(page.infobox) + " "
    nofollow = "nofollow" in robots
    return {
        "title": first("".join(page.first.get("title", [])), page.meta.get("property:og:title", ""), "".join(page.first.get("h1", [])), linked[0]),
        "description": first(page.meta.get("name:description", ""), page.meta.get("property:og:description", ""), linked[1]),
        "text": head(text, TEXT_BYTES),
        "links": [] if nofollow else [u for h in page.hrefs if (u := _join(base or "", h))],
        "noindex": "noindex" in robots or "none" in robots,
        "nofollow": nofollow,
        "canonical": (_join(base or "", page.canonical) or "") if page.canonical else "",
    }


@F.pandas_udf(PAGE)
def extract(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_page(h, u) for h, u in zip(html, url, strict=True)], columns=PAGE.names)


def hrefs(html: Column) -> Column:
    """Values of href in double quotes, without a parser."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'))


def is_sitemap(body: Column) -> Column:
    return F.substring(body, 1, 4096).rlike("<urlset|<sitemapindex")


def _web(links: Column) -> Column:
    return F.filter(F.transform(links, lambda u: F.trim(u)), lambda u: u.startswith("http"))


def sitemap_urls(body: Column) -> Column:
    """URLs of <loc> elements of a sitemap, as written."""
    found = _web(F.regexp_extract_all(body, F.lit("(?s)<loc>(.*?)</loc>")))
    return F.when(F.substring(body, 1, 4096).rlike("<urlset|<sitemapindex|<loc>"), found).otherwise(F.array().cast("array<string>"))


def feed_links(body: Column) -> Column:
    """Links of an RSS or Atom feed: element texts, then href values behind the last of those."""
    texts = F.regexp_extract_all(body, F.lit("(?s)<link>(.*?)</link>"))
    rest = F.regexp_replace(body, "(?s)^.*</link>", "")
    tags = F.regexp_extract_all(rest, F.lit("(?s)<link(?:(?!<link).)*?href=(\"[^\"]*\"|'[^']*'|[^\"'> ][^> \"']*)"))
    values = F.transform(tags, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    return F.when(F.substring(body, 1, 8192).rlike("<rss|<feed|<rdf:RDF"), F.concat(_web(texts), _web(values))).otherwise(F.array().cast("array<string>"))


def challenge_kind(body: Column, status: Column) -> Column:
    """none, pow (proof of work, by its marks anywhere) or edge (marks, with status 403 or 503)."""
    has = lambda marks: F.greatest(*[F.contains(body, F.lit(m)) for m in marks])
    return F.when(has(V.PROOF_OF_WORK_MARKS), "pow").when(status.isin(403, 503) & has(V.EDGE_MARKS), "edge").otherwise("none")
