"""URL, text and page functions case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loam.functions import extract, text, urls
from loam.sources import files


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("HTTPS://Example.COM:443/a?utm_source=x&b=2&a=1#frag", "https://example.com/a?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com:8080/x?a", "http://example.com:8080/x?a="),
        ("https://www.youtube.com/watch?v=1&si=2", "https://www.youtube.com/watch?v=1"),
        ("https://other.test/?si=2", "https://other.test/?si=2"),
        ("https://user@example.com/", None),
        ("ftp://example.com/", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize(spark, url, wanted):
    assert urls.normalize_text(url) == wanted
    assert one(spark, url, urls.normalize_exact("x")) == wanted


def test_built_in_and_exact_normalisation_agree_where_both_apply(spark):
    import random
    import re

    rng = random.Random(1)
    bits = ["a", "B7", ".", "..", "x.y", "~", "%41", "ä", " ", "a;b", "-", "_", "", "utm_source", "UTM_Source", "si"]
    some = lambda n, sep, of: sep.join(rng.choice(of) for _ in range(rng.randint(0, n)))
    made = set()
    for _ in range(3000):
        host = rng.choice(["x.test", "X.Test", "www.youtube.com", "a-b.co.uk", "1.2.3.4", "127.1", "[::1]", "xn--a.test", "a_b.test", "0x7f.1", "x.test:80", "x.test:443", "x.test:8080", "x.test:080", "u@x.test"])
        query = "&".join(rng.choice(bits) + rng.choice(["=", "", "=="]) + rng.choice(bits) for _ in range(rng.randint(0, 4)))
        made.add(rng.choice(["http", "https", "HTTP"]) + "://" + host + rng.choice(["", "/"]) + some(4, "/", bits) + rng.choice(["", "/", "?", "?" + query, "#f"]))
    rows = spark.createDataFrame([(u,) for u in sorted(made)], "x string")
    got = {r.x: (r.c, r.n) for r in rows.select("x", urls.canonical(F.col("x")).alias("c"), F.when(F.col("x").rlike(urls.PLAIN), urls.normalize(F.col("x"))).alias("n")).collect()}
    assert sum(n is not None for _, n in got.values()) > 300
    for u, (found, plain) in got.items():
        assert found == urls.normalize_text(u), u
        assert plain is None or plain == found, u
    assert not re.match(urls.PLAIN, "http://x.test/../a") and re.match(urls.PLAIN, "http://x.test/a?b=1")


def test_leads_end_with_a_character(spark):
    for text_, wanted in (("é" * 100, "é" * 80), ("a" + "é" * 100, "a" + "é" * 100), ("x" * 160, "x" * 160), ("x" * 161, "x" * 160), ("é" * 79 + "xx" + "y" * 9, "é" * 79 + "xx"), ("", ""), ("語" * 60, "語" * 60)):
        assert one(spark, text_, files.lead(F.col("x"))) == wanted


def test_normalize_resolves_dots_and_decodes():
    assert urls.normalize_text("http://a.test/x/../y?q=a%20b&q=%C3%A9") == "http://a.test/y?q=a+b&q=%C3%A9"


@pytest.mark.parametrize(("host", "site"), [("a.b.example.com", "example.com"), ("example.com", "example.com"), ("www.bbc.co.uk", "bbc.co.uk"), ("localhost", "localhost"), ("co.uk", "co.uk"), ("127.0.0.1", "0.1")])
def test_site_key(spark, host, site):
    assert one(spark, host, urls.site_key(F.col("x"))) == site


@pytest.mark.parametrize(
    ("url", "skipped", "hub"),
    [
        ("https://en.wikipedia.org/wiki/Rust", False, False),
        ("https://fr.wikipedia.org/wiki/Rust", True, False),
        ("https://x.test/doc.pdf", True, False),
        ("https://x.test/tag/rust", False, True),
        ("https://x.test/blog/tag", False, False),
        ("https://x.test/2024/05", False, True),
        ("https://x.test/2024/05/title", False, False),
        ("https://x.test/login", True, True),
        ("https://x.test/deep/labyrinth/4", True, False),
        ("https://x.test/users/ann", False, True),
        ("https://x.test/", False, False),
    ],
)
def test_url_rules(spark, url, skipped, hub):
    assert one(spark, url, urls.skip_url(F.col("x")), urls.skip_index_url(F.col("x"))) == (skipped, hub)


def test_public_addresses(spark):
    for ip, public in (("8.8.8.8", True), ("10.0.0.1", False), ("::1", False), ("2606:4700::1", True), ("fe80::1", False), ("nonsense", None), ("100.64.1.1", False)):
        assert one(spark, ip, urls.public_ip("x")) is public
    for url, public in (("http://localhost/a", False), ("https://192.168.0.1/", False), ("https://example.com/", True), ("file:///etc", False), ("http://[::1]/", False), ("http://[2606:4700::1]:80/x", True), ("http://127.1/", False), ("http://2130706433/", False), ("http://1.1.1.1/", True), (None, False)):
        assert one(spark, url, urls.url_is_public(F.col("x"))) is public


def test_titles_and_clips(spark):
    x = F.col("x")
    assert one(spark, "Just a moment...", text.junk_title(x)) and not one(spark, "How to log in safely", text.junk_title(x))
    assert one(spark, "a b c d e f g h i", text.display_title(F.lit(""), x)) == "a b c d e f g h"
    assert one(spark, " ", text.display_title(F.lit("Log in"), x)) == "untitled"
    assert one(spark, "aéé", text.clip_text(x, 4)) == "aé"
    assert one(spark, "aéé", text.clip_text(x, 0)) == "aéé"
    assert one(spark, "x" * 300, F.length(text.clipped(x))) == 243
    assert one(spark, "a<b>&'\"", text.escape_xml(x)) == "a&lt;b&gt;&amp;&apos;&quot;"
    assert one(spark, "0", text.rss_date(x.cast("long"))) == "Thu, 01 Jan 1970 00:00:00 +0000"
    assert one(spark, " 7 ", text.retry_after_ms(x)) == 7000 and one(spark, "Wed, 21 Oct", text.retry_after_ms(x)) is None


def test_babble(spark):
    prose = "when the rain had gone we went to the shore and saw that a boat was in the bay with nobody on it " * 5
    babble = " ".join(f"qq{i}" for i in range(80))
    assert not one(spark, prose, text.is_babble(F.col("x"))) and one(spark, babble, text.is_babble(F.col("x"))) and not one(spark, "qq zz", text.is_babble(F.col("x")))
    assert one(spark, "short", text.is_link_maze(F.col("x"), F.lit(48))) and not one(spark, "y" * 2000, text.is_link_maze(F.col("x"), F.lit(99)))


def test_simhash(spark):
    base = " ".join(f"word{i}" for i in range(200))
    a, b, c = (one(spark, t, text.simhash64(F.col("x"))) for t in (base, base.replace("word7 ", "other "), " ".join(f"thing{i}" for i in range(200))))
    assert (a ^ b & ((1 << 64) - 1)).bit_count() < ((a ^ c) & ((1 << 64) - 1)).bit_count()
    assert one(spark, "  ", text.simhash64(F.col("x"))) == 0


PAGE = """<html><head><title>Hello</title><meta name="description" content="desc"></head><body><nav>menu</nav><p>Visible text<p>more</p>
<script>bad()</script><a href="/a">link</a><a href="rel2">link2</a><div class="x cookie-banner">cookies</div></body></html>"""


def test_extract_basics():
    e = extract.extract_page(PAGE, "https://x.test/dir/")
    assert (e["title"], e["description"]) == ("Hello", "desc")
    assert e["text"] == "Hello Visible text more link link2 "
    assert e["links"] == ["https://x.test/a", "https://x.test/dir/rel2"] and not e["noindex"]


def test_extract_fallbacks_and_robots():
    og = extract.extract_page('<meta property="og:title" content="OG"><meta property="og:description" content="D"><h1>H</h1>', "https://x.test/")
    assert (og["title"], og["description"]) == ("OG", "D")
    assert extract.extract_page("<h1>Head <b>line</b></h1>", "")["title"] == "Head line"
    ld = extract.extract_page('<link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["X","NewsArticle"],"headline":" LD ","description":"DD"}]}</script>', "https://x.test/a")
    assert (ld["title"], ld["description"], ld["canonical"]) == ("LD", "DD", "https://x.test/c")
    no = extract.extract_page('<meta name="robots" content="NOINDEX,nofollow"><a href="/x">l</a>', "https://x.test/")
    assert no["noindex"] and no["nofollow"] and no["links"] == []
    none = extract.extract_page('<meta name="robots" content="none"><a href="/x">l</a>', "https://x.test/")
    assert none["noindex"] and not none["nofollow"] and len(none["links"]) == 1


def test_extract_moves_infobox_behind_the_text():
    e = extract.extract_page('<table class="infobox"><tr><th>Height<td>12 m</table><p>A tower by the river.</p>', "https://x.test/")
    assert e["text"] == "A tower by the river. Height 12 m "
    assert extract.extract_page(None, None)["text"] == "" and extract.extract_page("<p>a<b", "")["text"].startswith("a")


def test_sitemaps_feeds_and_challenges(spark):
    x = F.col("x")
    assert one(spark, "<urlset><loc>http://a/1</loc></urlset>", extract.sitemap_urls(x), extract.is_sitemap(x)) == (["http://a/1"], True)
    assert one(spark, "<loc>http://a/1</loc>", extract.sitemap_urls(x), extract.is_sitemap(x)) == (["http://a/1"], False)
    assert one(spark, "മ" * 4000 + "<rss></rss>", extract.feed_links(x)) == []
    assert one(spark, "... window.__anubis_challenge__ = {}", extract.challenge_kind(x, F.lit(200))) == "pow"
    assert one(spark, "Just a moment", extract.challenge_kind(x, F.lit(503))) == "edge" and one(spark, "Just a moment", extract.challenge_kind(x, F.lit(200))) == "none"


def test_robots():
    rules = "User-agent: *\nDisallow: /\nUser-agent: loam\nDisallow: /private*.html$\nAllow: /private/ok"
    assert not files.robots_allows(rules, "other", "/a")
    assert files.robots_allows(rules, "loam/1", "/a") and not files.robots_allows(rules, "loam/1", "/private/x.html") and files.robots_allows(rules, "loam/1", "/private/x.htm")
    assert files.robots_allows("", "loam", "/a") and files.robots_allows(None, "loam", "/a")


def test_robots_verdict_and_sitemaps(spark):
    statuses = spark.createDataFrame([(200,), (404,), (500,), (None,), (403,), (301,)], "s int")
    assert [r[0] for r in statuses.select(files.robots_verdict(F.col("s"))).collect()] == ["parse", "allow", "deny", "deny", "allow", "allow"]
    assert one(spark, "Sitemap: https://a/s.xml \nx\nsitemap:https://b", files.robots_sitemaps(F.col("x"))) == ["https://a/s.xml", "https://b"]


def test_feed_entries(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://a.test/1"/><updated>2024-01-02T00:00:00Z</updated><summary>S</summary></entry></feed>'
    rss = "<rss><channel><item><link>https://a.test/2</link><pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate></item><item><link>http://10.0.0.1/x</link></item></channel></rss>"
    got = {r.url: (r.title, r.body, r.fetched_at, r.kind) for r in files.read_feeds(spark.createDataFrame([(atom,), (rss,), ("<bad",), (None,)], "body string"), 5).collect()}
    assert got == {"https://a.test/1": ("T", "S", 1704153600, "rss"), "https://a.test/2": ("https://a.test/2", "", 1704153600, "rss")}


def test_text_sources(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\n\nhttps://b.test\n")
    assert [r.url for r in files.read_seeds(spark, f"file://{tmp_path}/seeds.txt", ["https://a.test"]).collect()] == ["https://a.test", "https://b.test"]
    assert [r.url for r in files.read_seeds(spark, default=["https://d.test"]).collect()] == ["https://d.test"]
    (tmp_path / "block.txt").write_text("*.Bad.Test\n# x\nworse.test\n")
    found = {r.domain for r in files.read_blocklist(spark, [f"file://{tmp_path}/block.txt"]).collect()}
    assert {"bad.test", "worse.test", "facebook.com"} <= found
    (tmp_path / "in.jsonl").write_text('\t {"url":"https://a.test/1","text":"body","domain":"a.test"}\t\r\nnoise\n{"url":"mailto:x"}\n')
    row = files.read_jsonl(spark, f"file://{tmp_path}/in.jsonl", 9).collect()
    assert [(r.url, r.host, r.body, r.fetched_at) for r in row] == [("https://a.test/1", "a.test", "body", 9)]
