"""More registered queries: each sends whole tables, or hard rows, through an operator that its SQL says in other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import extract, text, urls
from loam.functions import fixed_values as V
from loam.operators import crawl, index, maintain, queryspec, search, store
from loam.operators.tables import new_path
from loam.sources import files
from loam.streaming import crawl_stream

from . import corpora as c
from .catalog import BOOSTS, CORPUS_TERMS, FRONTIER, HUB, PARTED, RERANK, SENSE, SKIP, TITLE_KEY, TRACKING, PAIRS, _candidates, _frontier, _streamed, has, quality_sql, query  # isort: skip


def _documents(spark, sf) -> DataFrame:
    return c.table(spark, sf, "documents")


def _events(spark, sf) -> DataFrame:
    return c.table(spark, sf, "events")


def _picked(values: list, by) -> object:  # noqa: ANN001
    """One of the values for each number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _picked_sql(values: list[str], by: str) -> str:
    return f"({c.listed(values)})[{by} % {len(values)} + 1]"


# URLs

#: (URL, canonical form), checked by hand against the URL standard.
EXACT = [
    ("http://[::1]/x", "http://[::1]/x"), ("http://[0:0::1]:80/", "http://[::1]/"), ("http://127.1/", "http://127.0.0.1/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://2130706433/a", "http://127.0.0.1/a"),
    ("http://x.test/?q=*~", "http://x.test/?q=*%7E"), ("http://MÜNCHEN.test/ä?ä=ö", "http://xn--mnchen-3ya.test/%C3%A4?%C3%A4=%C3%B6"), ("http://x.test/a/../b/./c#f", "http://x.test/b/c"),
    ("http://x.test?b=2&a=1&UTM_source=q", "http://x.test/?a=1&b=2"), ("https://x.test:443/%7Ea b", "https://x.test/%7Ea%20b"), ("HTTP://X.test:8080/?a&b=", "http://x.test:8080/?a=&b="), (" http://x.test/p ", "http://x.test/p"),
    ("http://x.test/?q=a+b%20c", "http://x.test/?q=a+b+c"), ("http://256.1.1.1/", None), ("http://x.test:99999/", None), ("http://u@x.test/", None), ("ftp://x.test/", None), ("x.test/a", None), ("", None),
]


def _sql_rows(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else c.quoted([v])
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_sql_rows(EXACT)}) v(url, canonical)")
def url_exact(spark, sf):
    return spark.createDataFrame(EXACT, "url string, canonical string").select("url", urls.canonical(F.col("url")).alias("canonical"))


CANONICAL = """CASE WHEN host <> '' AND NOT contains(authority, '@') THEN scheme || '://' || host || CASE WHEN port = '' OR port = (CASE WHEN scheme = 'http' THEN '80' ELSE '443' END) THEN '' ELSE ':' || port END
 || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda p: p.name || '=' || p.value), '&') END END"""
QUERIED = f"Q AS (SELECT *, regexp_extract(authority, ':([0-9]+)$', 1) AS port, list_sort(list_filter({PAIRS}, lambda p: NOT {TRACKING})) AS kept FROM PS)"


@query(f"WITH {c.SITES}, {QUERIED} SELECT page_id, {CANONICAL} AS canonical FROM Q")
def url_canonical(spark, sf):
    return c.page_urls(spark, sf).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


PUBLIC = [
    ("http://[::1]/", False), ("http://[fe80::1]/", False), ("http://[2606:4700::1]/", True), ("http://127.1/", False), ("http://2130706433/", False), ("http://0x7f000001/", False), ("http://0300.0250.1.1/", False), ("http://134744072/", True),
    ("http://localhost/", False), ("http://a.localhost/", False), ("http://LOCALHOST:80/", False), ("https://example.com/", True), ("https://8.8.8.8/", True), ("https://10.1.2.3/", False), ("http://256.1.1.1/", False), ("file:///x", False), ("", False),
]


@query(f"WITH {c.SITES} SELECT url, scheme <> '' AND host <> '' AND host <> 'localhost' AND NOT ends_with(host, '.localhost') AND host <> '10.1.2.3' AS public FROM PS UNION ALL SELECT * FROM (VALUES {_sql_rows(PUBLIC)}) v(url, public)")
def public_urls(spark, sf):
    rows = c.page_urls(spark, sf).select("url").unionByName(spark.createDataFrame([(u,) for u, _ in PUBLIC], "url string"))
    return rows.select("url", urls.url_is_public(F.col("url")).alias("public"))


@query("""WITH I AS (SELECT event_id, [event_id % 256, event_id * 7 % 256, event_id * 31 % 256, event_id * 101 % 256] AS o FROM events), N AS (SELECT event_id, o, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS n FROM I)
SELECT event_id, NOT (o[1] IN (0, 10, 127) OR o[1] BETWEEN 224 AND 239 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2851995648 AND 2852061183 OR n = 4294967295
 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 3323068416 AND 3323199487) AS public FROM N""")
def public_ip(spark, sf):
    i = F.col("event_id")
    ip = F.concat_ws(".", *[(i * k % 256).cast("string") for k in (1, 7, 31, 101)])
    return _events(spark, sf).select("event_id", urls.public_ipv4(ip).alias("public"))


@query(f"WITH {c.PARTS}, X AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/Sitemap_' || page_id || '.xml' WHEN 1 THEN '/a/sitemap.xml.gz' WHEN 2 THEN '/sitemap/x.html' ELSE path END AS p FROM PP WHERE page_id >= 0) SELECT page_id, contains(lower(p), 'sitemap') AND (ends_with(lower(p), '.xml') OR ends_with(lower(p), '.xml.gz')) AS bypass FROM X")
def sitemap_bypass(spark, sf):
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/Sitemap_"), i, F.lit(".xml"))).when(i % 4 == 1, "/a/sitemap.xml.gz").when(i % 4 == 2, "/sitemap/x.html").otherwise(urls.path_of(F.col("url")))
    return c.table(spark, sf, "pages").select("page_id", urls.is_sitemap_url(F.concat(F.lit("https://x.test"), path)).alias("bypass"))


# pages and links

LINKED = rf"""LK AS (SELECT page_id AS page, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))) AS pos FROM pages),
LU AS (SELECT page, pos, CASE WHEN starts_with(href, '/') THEN origin || replace(href, '&amp;', '&') ELSE replace(href, '&amp;', '&') END AS link FROM LK),
PU AS (SELECT page * 100000 + pos AS page_id, array_to_string(list_transform(string_split(link, ''), lambda ch: CASE WHEN unicode(ch) > 127 THEN url_encode(ch) ELSE ch END), '') AS url FROM LU), {c.URL_PARTS}, PS AS (SELECT *, {c.site_sql("host")} AS site FROM PP), {QUERIED},
AC AS (SELECT page_id // 100000 AS page, page_id % 100000 AS pos, {CANONICAL} AS link, host, site FROM Q WHERE NOT ({SKIP}) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest({c.listed(V.BLOCKED_HOSTS)}) AS d) WHERE host = d OR ends_with(host, '.' || d)))"""


def _page_links(spark, sf) -> DataFrame:
    return c.spread(spark, sf, "pages").select("page_id", extract.extract("html", "url")["links"].alias("links"))


@query(f"WITH {LINKED} SELECT page AS page_id, pos, link AS url FROM AC WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) <= 80")
def outlinks_accepted(spark, sf):
    out = crawl.outlinks(_page_links(spark, sf), most=80, blocklist=files.read_blocklist(spark))
    return out.select("page_id", F.col("at").cast("long").alias("pos"), "url")


@query(f"WITH {LINKED} SELECT page AS page_id, pos, link AS url FROM AC WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) <= 3")
def outlink_cap(spark, sf):
    out = crawl.outlinks(_page_links(spark, sf), most=3, blocklist=files.read_blocklist(spark))
    return out.select("page_id", F.col("at").cast("long").alias("pos"), "url")


@query(f"WITH {LINKED}, X AS (SELECT link, site, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM AC WHERE link IS NOT NULL) SELECT DISTINCT link AS url, site, 1 AS depth, CAST(0.9 AS DOUBLE) AS score FROM X WHERE n <= 80 AND link NOT IN (SELECT link FROM X WHERE starts_with(link, 'https'))")
def frontier_expand(spark, sf):
    links = _page_links(spark, sf).select("page_id", "links", F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit(c.NOW).cast("long").alias("fetched_at"))
    seen = crawl.outlinks(_page_links(spark, sf), most=80, blocklist=files.read_blocklist(spark)).where("startswith(url, 'https')").select(F.xxhash64("url").alias("url_key"))
    empty = spark.createDataFrame([], "url_key long")
    return crawl.expand(links, empty, seen, files.read_blocklist(spark)).select("url", "site", "depth", "score")


@query("SELECT page_id, unnest(['https://x.test/' || page_id, 'https://y.test/' || page_id || '?a=1&amp;b=2']) AS link FROM pages")
def sitemap_locs(spark, sf):
    i = F.col("page_id")
    body = F.concat(F.lit("<urlset><url><loc> https://x.test/"), i, F.lit(" </loc></url><url><loc>ftp://x</loc></url>\n<url><loc>https://y.test/"), i, F.lit("?a=1&amp;b=2</loc></url></urlset>"))
    return c.table(spark, sf, "pages").select("page_id", F.explode(extract.sitemap_urls(body)).alias("link"))


@query("SELECT page_id, unnest(['https://a.test/' || page_id, 'https://b.test/' || page_id, 'https://c.test/' || page_id, 'https://d.test/' || page_id]) AS link FROM pages WHERE page_id % 3 > 0")
def feed_links(spark, sf):
    i = F.col("page_id")
    items = F.concat(F.lit("<item><link>https://a.test/"), i, F.lit("</link></item><item><link> https://b.test/"), i, F.lit(" </link></item></channel><link href='https://c.test/"), i, F.lit("'/><link href=https://d.test/"), i, F.lit("></x>"))
    lead = F.when(i % 3 == 0, "<html>").when(i % 3 == 1, "<rss><channel>").otherwise("<feed>")
    return c.table(spark, sf, "pages").select("page_id", F.explode(extract.feed_links(F.concat(lead, items))).alias("link"))


@query(f"SELECT doc_id, {_picked_sql(c.TITLES, 'doc_id')} || CASE WHEN doc_id % 7 = 0 THEN ' ' || source ELSE '' END AS title, {has('lower(trim(title))', V.JUNK_PHRASES)} OR lower(trim(title)) IN ({c.quoted(V.AUTH_TITLES)}) AS junk FROM documents")
def junk_title(spark, sf):
    i = F.col("doc_id")
    title = F.concat(_picked(c.TITLES, i), F.when(i % 7 == 0, F.concat(F.lit(" "), "source")).otherwise(""))
    return _documents(spark, sf).select("doc_id", title.alias("title")).select("doc_id", "title", text.junk_title(F.col("title")).alias("junk"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Name ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE 'Own ' || doc_id END AS title, CASE WHEN doc_id % 3 = 2 THEN 'Own words' ELSE 'Said of ' || source END AS description FROM documents")
def json_ld(spark, sf):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, F.concat(F.lit('{"@graph":[{"@type":"Thing","name":"no"},{"@type":["X","Article"],"name":"Name '), i)).otherwise(F.concat(F.lit('[{"@type":"NewsArticle","headline":" Head '), i))
    script = F.concat(F.lit('<script type="application/ld+json">'), kind, F.lit(' ","description":"Said of '), "source", F.lit('"}]'), F.when(i % 3 == 0, "}").otherwise(""), F.lit("</script>"))
    own = F.when(i % 3 == 2, F.concat(F.lit("<title>Own "), i, F.lit('</title><meta name="description" content="Own words">'))).otherwise("")
    page = _documents(spark, sf).select("doc_id", F.concat(F.lit("<html><head>"), own, script, F.lit("</head><body>x</body></html>")).alias("html"), F.lit("https://x.test/").alias("url"))
    return page.select("doc_id", extract.extract("html", "url").alias("e")).select("doc_id", "e.title", "e.description")


@query(rf"""WITH B AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}]+') AS w, doc_id * 7 % 97 AS n_links, CASE doc_id % 5 WHEN 0 THEN '{V.MEDIA_HOSTS[0]}' WHEN 1 THEN 'en.wikipedia.org' ELSE 'x.test' END AS host, CASE WHEN doc_id % 11 = 0 THEN '/viewtopic/1' ELSE '/p' END AS path FROM documents),
M AS (SELECT *, len(w) AS n, len(list_filter(w, lambda t: t IN ({c.quoted(V.FUNCTION_WORDS)}))) AS common, len(list_distinct(w)) AS kinds, n_links - n_links // 3 AS own FROM B)
SELECT doc_id, host = 'x.test' AND path = '/p' AND ((10 * own >= 7 * n_links AND n_links >= 48 AND strlen(text) < 2000) OR (n >= 60 AND (common / n < 0.12 OR kinds / n > 0.92))) AS trap FROM M""")
def tarpit_gate(spark, sf):
    i = F.col("doc_id")
    n = (i * 7 % 97).cast("int")
    host = F.when(i % 5 == 0, V.MEDIA_HOSTS[0]).when(i % 5 == 1, "en.wikipedia.org").otherwise("x.test")
    links = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k % 3 == 0, F.concat(F.lit("https://away.test/"), k)).otherwise(F.concat(F.lit("https://www."), host, F.lit("/"), k)))
    links = F.when(n == 0, F.array().cast("array<string>")).otherwise(links)
    path = F.when(i % 11 == 0, "/viewtopic/1").otherwise("/p")
    return _documents(spark, sf).select("doc_id", crawl.tarpit(F.col("text"), links, host, path).alias("trap"))


ROBOTS = "User-agent: *\nDisallow: /\nUser-agent: loam\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\nSitemap: https://a.test/s.xml"


@query(f"WITH {c.PARTS} SELECT page_id, CASE WHEN ends_with(path, '.html') THEN false WHEN starts_with(path, '/de/1') THEN true WHEN starts_with(path, '/de/') THEN false ELSE true END AS allowed FROM PP WHERE page_id >= 0")
def robots_allow(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", files.robots_allowed("loam/1.0")(F.lit(ROBOTS), urls.path_of(F.col("url"))).alias("allowed"))


@query("SELECT page_id, unnest(['https://a.test/' || page_id || '.xml', 'https://b.test/' || page_id]) AS sitemap FROM pages")
def robots_sitemaps(spark, sf):
    body = F.concat(F.lit("User-agent: *\nSitemap:  https://a.test/"), "page_id", F.lit(".xml \nsitemap:https://b.test/"), "page_id", F.lit("\nSITEMAP: https://c.test/\nx sitemap: https://d.test"))
    return c.table(spark, sf, "pages").select("page_id", F.explode(files.robots_sitemaps(body)).alias("sitemap"))


@query("SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'parse' WHEN s IS NULL OR s >= 500 THEN 'deny' ELSE 'allow' END AS verdict FROM (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE 100 * (event_id % 6 + 1) + event_id % 4 END AS s FROM events)")
def robots_status(spark, sf):
    i = F.col("event_id")
    return _events(spark, sf).select("event_id", files.robots_verdict(F.when(i % 6 != 5, 100 * (i % 6 + 1) + i % 4)).alias("verdict"))


# fetching

KINDS = ["", "text/html; charset=utf-8", "TEXT/PLAIN", "application/rss+xml", "image/png", "application/json"]


@query(f"SELECT event_id, k AS kind, trim(k) = '' OR regexp_matches(lower(k), 'html|text/plain|xml') AS ok FROM (SELECT event_id, {_picked_sql(KINDS, 'event_id')} AS k FROM events)")
def content_type_gate(spark, sf):
    return _events(spark, sf).select("event_id", _picked(KINDS, F.col("event_id")).alias("kind")).select("event_id", "kind", text.content_type_ok(F.col("kind")).alias("ok"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 1000 END AS wait_ms FROM events")
def retry_after(spark, sf):
    i = F.col("event_id")
    header = F.when(i % 3 == 0, F.concat(F.lit(" "), i, F.lit(" "))).when(i % 3 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise("-5")
    return _events(spark, sf).select("event_id", text.retry_after_ms(header).alias("wait_ms"))


@query("SELECT event_id, CAST(least(greatest(2000, r, l * 2) * CASE WHEN f > 0 THEN CAST(pow(2, least(f, 6)) AS BIGINT) ELSE 1 END, 30000) AS BIGINT) AS wait_ms FROM (SELECT event_id, event_id * 13 % 40000 AS l, event_id * 17 % 9000 AS r, event_id % 10 AS f FROM events)")
def polite_wait(spark, sf):
    i = F.col("event_id")
    return _events(spark, sf).select("event_id", crawl.polite_wait_ms(i * 13 % 40_000, i * 17 % 9000, i % 10).alias("wait_ms"))


ROUTED = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 500 END AS status, CASE event_id % 8 WHEN 6 THEN 'timeout' WHEN 7 THEN 'other' END AS error, event_id // 8 % 4 AS attempts, event_id // 32 % 6 AS failures, CASE WHEN event_id % 5 > 0 THEN event_id % 5 * 40 END AS after_s FROM events"


def _routed(spark, sf) -> DataFrame:
    i = F.col("event_id")
    status = _picked([200, 304, 403, 429, 503, 500, None, None], i)
    error = _picked([None, None, None, None, None, None, "timeout", "other"], i)
    return _events(spark, sf).select("event_id", status.alias("status"), error.alias("error"), F.floor(i / 8).alias("k"), F.when(i % 5 > 0, i % 5 * 40).alias("after_s")).select("event_id", "status", "error", (F.col("k") % 4).alias("attempts"), F.floor(F.col("k") / 4).alias("f"), "after_s").select("*", (F.col("f") % 6).alias("failures"))


@query(f"SELECT event_id, coalesce(status IN (200, 304), false) AS ok, (status = 500 OR status IS NULL) AND attempts < 2 AS retry, CASE WHEN status = 429 THEN greatest(coalesce(after_s, 60), 1) ELSE 0 END AS penalty_s, CAST(CASE WHEN error = 'timeout' AND failures > 3 THEN 3600 ELSE 0 END AS BIGINT) AS ban_s FROM ({ROUTED})")
def status_routing(spark, sf):
    r = crawl.status_route(F.col("status"), F.lit(True), F.col("attempts"), F.col("failures"), F.col("after_s"), F.col("error"))
    return _routed(spark, sf).select("event_id", r.alias("r")).select("event_id", "r.ok", "r.retry", F.col("r.penalty_s").cast("long").alias("penalty_s"), F.col("r.ban_s").cast("long").alias("ban_s"))


@query("""WITH O AS (SELECT DISTINCT 'u' || user_id AS site, user_id * 100 AS next_ms, user_id % 7 AS failed FROM events WHERE user_id % 3 > 0), R AS (SELECT 'u' || user_id AS site, bool_and(event_id % 4 > 0) AS ok, max(event_id % 900) AS lat FROM events WHERE user_id % 4 > 0 GROUP BY user_id),
X AS (SELECT site, ok, lat, next_ms, failed, CASE WHEN ok THEN 0 ELSE coalesce(failed, 0) + 1 END AS f, CASE WHEN lat > 850 THEN 77 ELSE 0 END AS penalty FROM O FULL JOIN R USING (site))
SELECT site, CASE WHEN ok IS NULL THEN next_ms WHEN penalty > 0 THEN 1000000 + 77000 ELSE 1000000 + least(greatest(2000, lat * 2) * CASE WHEN f > 0 THEN CAST(pow(2, least(f, 6)) AS BIGINT) ELSE 1 END, 30000) END AS next_allowed_ms, CASE WHEN ok IS NULL THEN 9 WHEN f > 3 THEN 1000 + 3600 ELSE CASE WHEN next_ms IS NULL THEN 0 ELSE 9 END END AS banned_until,
 ok IS NULL AS in_flight, CASE WHEN ok IS NULL THEN failed ELSE f END AS failures FROM X""")
def host_state_done(spark, sf):
    e = _events(spark, sf)
    site = F.concat(F.lit("u"), "user_id").alias("site")
    old = e.where("user_id % 3 > 0").select(site, (F.col("user_id") * 100).alias("next_allowed_ms"), F.lit(9).cast("long").alias("banned_until"), F.lit(True).alias("in_flight"), (F.col("user_id") % 7).cast("int").alias("failures")).distinct()
    r = e.where("user_id % 4 > 0").groupBy(site).agg(F.bool_and(F.col("event_id") % 4 > 0).alias("ok"), F.max(F.col("event_id") % 900).alias("latency_ms"))
    failed = F.when(F.col("ok"), 0).otherwise(F.coalesce("failures", F.lit(0)) + 1)
    r = r.join(old.select("site", "failures"), "site", "left").withColumn("ban_s", F.when(failed > 3, 3600).otherwise(0)).drop("failures")
    r = r.withColumns({"robots_ms": F.lit(0).cast("long"), "penalty_s": F.when(F.col("latency_ms") > 850, 77).otherwise(0)})
    out = crawl.done(old, r, 1_000_000)
    return out.select("site", "next_allowed_ms", "banned_until", "in_flight", F.col("failures").cast("long").alias("failures"))


@query("SELECT 'd' || doc_id AS url FROM documents WHERE doc_id % 4 < 2 AND doc_id % 5 > 0 AND (doc_id % 4 = 0 OR doc_id % 3 = 0)")
def etag_unchanged(spark, sf):
    i = F.col("doc_id")
    url = F.concat(F.lit("d"), i).alias("url")
    docs = _documents(spark, sf).where("doc_id % 4 < 3").select(url, F.when(i % 4 == 0, "e").otherwise("").alias("etag"), F.when((i % 4 == 1) & (i % 3 == 0), "m").otherwise("").alias("last_modified"))
    web = _documents(spark, sf).where("doc_id % 5 > 0").select(url, F.lit("e").alias("etag"), F.lit("m").alias("last_modified"))
    return crawl.unchanged(_documents(spark, sf).select(url), docs, web)


# the frontier

QUEUE = "Q0 AS (SELECT event_id AS url_key, 'u' || user_id AS site, CAST(event_id % 4 AS INT) AS depth, event_id * 7919 % 100000 AS enqueued_at, event_id % 50 = 0 AS priority FROM events)"


def _queue(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, sf).select(
        i.alias("url_key"), F.concat(F.lit("https://u"), "user_id", F.lit(".test/"), i).alias("url"), F.concat(F.lit("u"), "user_id").alias("site"), (i % 4).cast("int").alias("depth"), F.lit(1.0).alias("score"), F.lit(0).alias("attempts"),
        (i * 7919 % 100_000).alias("enqueued_at"), (i % 50 == 0).alias("priority"),
    )


@query(f"""WITH {QUEUE}, F1 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, depth, enqueued_at, url_key) AS n FROM Q0), H AS (SELECT DISTINCT 'u' || user_id AS site, user_id * 37 % 20000 AS due, CASE WHEN user_id % 11 = 0 THEN 99 ELSE 0 END AS ban, user_id % 13 = 0 AS busy FROM events WHERE user_id % 5 > 0),
L AS (SELECT url_key, F1.site, priority, enqueued_at, depth, coalesce(due, 0) AS due FROM F1 LEFT JOIN H USING (site) WHERE n = 1 AND coalesce(due, 0) <= 10000 AND coalesce(ban, 0) * 1000 <= 10000 AND NOT coalesce(busy, false))
SELECT url_key, site FROM L ORDER BY priority DESC, CASE WHEN priority THEN enqueued_at END, due, depth, site LIMIT 40""")
def frontier_lease(spark, sf):
    u = F.col("user_id")
    state = _events(spark, sf).where("user_id % 5 > 0").select(F.concat(F.lit("u"), u).alias("site"), (u * 37 % 20_000).alias("next_allowed_ms"), F.when(u % 11 == 0, 99).otherwise(0).alias("banned_until"), (u % 13 == 0).alias("in_flight")).distinct()
    return crawl.lease(_queue(spark, sf), state, 10_000, 40).select("url_key", "site")


@query(f"WITH {c.SITES} SELECT page_id, url FROM PS WHERE host <> '' AND NOT contains(authority, '@') AND abs(page_id) % 6 <= 3 AND NOT ({SKIP}) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest({c.listed(V.BLOCKED_HOSTS)}) AS d) WHERE host = d OR ends_with(host, '.' || d)) AND site NOT IN (SELECT site FROM PS GROUP BY site HAVING count(*) >= 8)")
def lease_gates(spark, sf):
    site = urls.site_key(urls.host_of(F.col("url")))
    rows = c.page_urls(spark, sf).select("page_id", F.col("url").alias("given"), "url", site.alias("site"), (F.abs("page_id") % 6).alias("depth"))
    out = crawl.fetchable(rows, files.read_blocklist(spark), rows.select("site"), config=crawl.CrawlConfig(pages_per_site=8))
    return out.select("page_id", F.col("given").alias("url"))


@query(f"WITH {FRONTIER} SELECT url_key, site FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY enqueued_at, url_key) AS n FROM FR) WHERE n <= 20")
def site_budget(spark, sf):
    return crawl.first_of_site(_frontier(spark, sf), 20, ("enqueued_at", "url_key")).select("url_key", "site")


@query("SELECT doc_id % 100 AS url_key, min(doc_id) AS first FROM documents WHERE doc_id % 100 NOT IN (SELECT doc_id % 7 FROM documents) AND doc_id % 100 NOT BETWEEN 20 AND 29 GROUP BY doc_id % 100")
def seen_dedupe(spark, sf):
    d = _documents(spark, sf)
    new = d.select((F.col("doc_id") % 100).alias("url_key"), F.col("doc_id").alias("first"), F.lit(0).alias("depth"), F.col("doc_id").alias("enqueued_at"))
    seen = d.select((F.col("doc_id") % 7).alias("url_key")).distinct()
    return crawl.push(new.where("url_key between 20 and 29").distinct(), seen, new).select("url_key", "first")


@query("SELECT doc_id % 100 AS url_key, min(doc_id) AS first FROM documents WHERE doc_id % 100 NOT BETWEEN 20 AND 29 GROUP BY doc_id % 100")
def recrawl_push(spark, sf):
    d = _documents(spark, sf)
    new = d.select((F.col("doc_id") % 100).alias("url_key"), F.col("doc_id").alias("first"), F.lit(0).alias("depth"), F.col("doc_id").alias("enqueued_at"))
    return crawl.push_recrawl(new.where("url_key between 20 and 29"), new).select("url_key", "first")


# search


@query("WITH " + c.bm25_sql(["tion", "that"], 2, BOOSTS) + f", {RERANK}, C AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank) AS n FROM T) SELECT doc_id, host FROM C WHERE n <= 3")
def per_site_cap(spark, sf):
    found, _ = _candidates(spark, sf)
    return search.cap_sites(found).select("doc_id", "host")


PAGE = (
    "WITH " + c.bm25_sql(["tion", "that"], 2, BOOSTS) + f""", {RERANK}, C AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank) AS n FROM S), K AS (SELECT *, {TITLE_KEY} AS key FROM C WHERE n <= 3), D1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS m FROM K),
P AS (SELECT * EXCLUDE (n, key, m) FROM D1 WHERE key = '' OR m = 1 ORDER BY rank LIMIT 80), G AS (SELECT *, row_number() OVER (PARTITION BY {SENSE} ORDER BY score DESC, rank) AS k, count(*) OVER () AS n FROM P),
A AS (SELECT *, sum(CAST(k <= 3 AS INT)) OVER (ORDER BY score DESC, rank ROWS UNBOUNDED PRECEDING) AS upto FROM G), B AS (SELECT *, row_number() OVER (ORDER BY (n > 6 AND k <= 3 AND upto <= 10) DESC, score DESC, rank) AS place FROM A)
SELECT doc_id, url, round(score, 6) AS score, CAST(place AS INT) AS place FROM B WHERE place <= 20"""
)


def _page(spark, sf, limit: int, offset: int) -> DataFrame:
    found = search.search(c.loaded_index(spark, sf), "tion that", limit, offset, None, c.NOW)
    return found.select("doc_id", "url", F.round("score", 6).alias("score"), "place")


@query(PAGE)
def search_page(spark, sf):
    return _page(spark, sf, 20, 0)


@query(PAGE.replace("place <= 20", "place > 10 AND place <= 20"))
def page_offset(spark, sf):
    return _page(spark, sf, 10, 10)


@query(f"SELECT url AS link FROM ({PAGE})")
def search_rss(spark, sf):
    page = search.rss_page(search.search(c.loaded_index(spark, sf), "tion that", 20, 0, None, c.NOW), "tion <&> that")
    return page.select(F.explode(extract.feed_links(F.col("rss"))).alias("link"))


SHAPED = "CASE WHEN doc_id % 5 = 0 THEN 'Best Top 10 - Reviews | ' || string_split(host, '.')[1] ELSE title END"
_BAIT = " + ".join(f"CAST(contains(lt, '{w}') AS INT)" for w in V.BAIT_WORDS)


@query(f"""WITH {c.CORPUS}, X AS (SELECT doc_id, url, host, kind, authority, lower({SHAPED}) AS lt, CAST(doc_id % 7 AS DOUBLE) AS bm25, greatest({c.NOW} - fetched_at, 0) / 86400.0 AS days FROM D),
Y AS (SELECT doc_id, CASE WHEN bm25 > 0 THEN bm25 ELSE 1 END * (1 + least(authority, 10) * 0.15) * {quality_sql('host')} AS base, 1 / (1 + days / CASE WHEN kind = 'rss' THEN 60 ELSE 365 END * CASE WHEN kind = 'rss' THEN 0.4 ELSE 0.2 END) AS old, 1 / (1 + days / CASE WHEN kind = 'rss' THEN 7 ELSE 30 END * CASE WHEN kind = 'rss' THEN 0.4 ELSE 0.2 END) AS fresh,
 CAST(contains(lt, 'src3') AS INT) AS t1, CAST(contains(lower(url), 'src3') AS INT) AS u1, host = 'src3.test' AS named, (CAST(contains(lt, 'top') AS INT) + CAST(contains(lt, 'news') AS INT)) / 2.0 AS t2, (CAST(contains(lower(url), 'top') AS INT) + CAST(contains(lower(url), 'news') AS INT)) / 2.0 AS u2,
 CASE WHEN (length(lt) - length(replace(lt, ' - ', ''))) / 3 + (length(lt) - length(replace(lt, ' | ', ''))) / 3 + (length(lt) - length(replace(lt, ': ', ''))) / 2 + length(lt) - length(replace(lt, '·', '')) >= 2 AND ({_BAIT}) >= 2 THEN 0.7 ELSE 1 END AS bait, lt FROM X),
Z AS (SELECT doc_id, base * old * (1 + t1 * 0.4) * (1 + u1 * 0.2) * CASE WHEN named THEN 6 ELSE 1 END * bait AS plain, named, base * fresh * (1 + t2 * 0.4 + CASE WHEN contains(lt, 'top news') THEN 0.35 ELSE 0 END) * (1 + u2 * 0.2) * bait AS newsy FROM Y)
SELECT doc_id, round(CASE WHEN named THEN greatest(plain, 300) ELSE plain END, 6) AS score, round(newsy, 6) AS newsy FROM Z""")
def rerank_boosts(spark, sf):
    """Names, the floor under them, baiting titles and fresh news, over all documents."""
    d = c.corpus(spark, sf).withColumns({"title": F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Best Top 10 - Reviews | "), F.regexp_extract("host", "^[^.]*", 0))).otherwise(F.col("title")), "bm25": (F.col("doc_id") % 7).cast("double"), "rank": F.col("doc_id")})
    one, two = (search.rerank(d, queryspec.parse(q), c.NOW).select("doc_id", F.round("score", 6).alias(name)) for q, name in (("src3", "score"), ("top news", "newsy")))
    return one.join(two, "doc_id")


@query(f"""WITH {c.CORPUS}, L AS (SELECT doc_id, title, body, lower(body) AS low FROM D), W AS (SELECT *, instr(low, 'the') - 1 AS first FROM L), X AS (SELECT *, substr(low, greatest(0, first - 100) + 1, 103) AS seg FROM W)
SELECT doc_id, CASE WHEN contains(lower(body[1:240]), 'the') THEN body[1:240] WHEN first >= 0 THEN substr(body, greatest(0, first - 100) + 1, length(seg) - instr(reverse(seg), 'eht') + 1 + 120) ELSE title END AS snippet FROM X""")
def snippet(spark, sf):
    return c.corpus(spark, sf).select("doc_id", search.snippet(["the"]).alias("snippet"))


@query(f"WITH {CORPUS_TERMS} SELECT 'postings' AS name, CAST(sum(len(list_distinct(t))) AS BIGINT) AS n FROM TT UNION ALL SELECT 'lengths', count(*) FROM TT UNION ALL SELECT 'docs', count(*) FROM D UNION ALL SELECT 'term_stats', count(*) FROM (SELECT DISTINCT field, unnest(t) FROM TT)")
def index_tables(spark, sf):
    """Built, saved as a version, and loaded."""
    path = new_path(spark, "index")
    index.build(c.corpus(spark, sf)).save(path)
    found = index.Index.load(spark, path)
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in (("postings", found.postings), ("lengths", found.lengths), ("docs", found.docs), ("term_stats", found.term_stats))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"WITH {c.CORPUS.replace('D AS (', 'D0 AS (')}, D AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'renewed title ' || string_split(host, '.')[1] ELSE title END AS title, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE body END AS body FROM D0 WHERE doc_id % 10 > 0 OR doc_id % 9 = 0), TT AS (SELECT 'title' AS field, {c.tokens_sql('title')} AS t FROM D UNION ALL SELECT 'body', {c.tokens_sql('body')} FROM D), E AS (SELECT field, unnest(list_distinct(t)) AS term FROM TT) SELECT field, term, count(*) AS df FROM E GROUP BY field, term")
def index_upsert(spark, sf):
    """A tenth of the documents deleted by URL, then a ninth replaced."""
    idx = c.loaded_index(spark, sf)
    new = idx.docs.where("doc_id % 9 = 0").withColumns({"title": F.concat(F.lit("renewed title "), F.regexp_extract("host", "^[^.]*", 0)), "body": F.lit("x")})
    return idx.delete(idx.docs.where("doc_id % 10 = 0").select("url")).upsert(new).term_stats.where("field <> 'description'").select("field", "term", "df")


@query(f"WITH {c.CORPUS} SELECT url FROM D WHERE doc_id % 3 = 0")
def index_has(spark, sf):
    idx = c.loaded_index(spark, sf)
    held = index.Index(idx.docs.where("doc_id % 3 = 0"), idx.postings, idx.lengths, idx.term_stats, idx.field_stats)
    return held.has(idx.docs.select("url"))


# sources, the store and maintenance


@query(f"""WITH {c.CORPUS}, X AS (SELECT *, list_filter(range(40, 161), lambda k: strlen(body[1:k]) = 160) AS cut FROM D) SELECT url, host, title, fetched_at, CASE WHEN strlen(body) > 160 AND len(cut) > 0 THEN body[1:cut[1]] ELSE body END AS description FROM X""")
def import_jsonl(spark, sf):
    """Exported, written with white space about the lines and other lines between, and read."""
    path = new_path(spark, "import")
    lines = maintain.to_jsonl(c.corpus(spark, sf)).select(F.explode(F.array(F.concat(F.lit("\t "), "value", F.lit(" \t")), F.lit(","), F.lit(""))).alias("value"))
    lines.write.text(path)
    return files.read_jsonl(spark, path, c.NOW).select("url", "host", "title", "fetched_at", "description")


@query("SELECT 'https://s.test/' || doc_id AS url FROM documents WHERE doc_id % 3 > 0")
def seeds_file(spark, sf):
    path, i = new_path(spark, "seeds"), F.col("doc_id")
    line = F.when(i % 3 == 0, F.concat(F.lit(" # "), i)).otherwise(F.concat(F.lit("  https://s.test/"), i, F.lit("\t")))
    _documents(spark, sf).select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return files.read_seeds(spark, path)


@query(f"SELECT DISTINCT 'd' || doc_id % 50 || '.test' AS domain FROM documents UNION SELECT unnest({c.listed(V.BLOCKED_HOSTS)})")
def blocklist_file(spark, sf):
    path, i = new_path(spark, "blocklist"), F.col("doc_id")
    line = F.concat(F.when(i % 2 == 0, "*.D").otherwise("d"), i % 50, F.lit(".Test "))
    _documents(spark, sf).select(F.explode(F.array(line, F.lit("# none"))).alias("value")).write.text(path)
    return files.read_blocklist(spark, [path])


@query("SELECT 'https://f.test/' || doc_id AS url, 'f.test' AS host, CASE WHEN doc_id % 3 = 0 THEN 'https://f.test/' || doc_id ELSE source || ' & co' END AS title, 'says ' || doc_id AS description, 'rss' AS kind, CASE WHEN doc_id % 4 = 0 THEN 1735689600 ELSE 1704153600 + doc_id % 60 END AS fetched_at FROM documents WHERE doc_id % 5 > 0")
def rss_source(spark, sf):
    i = F.col("doc_id")
    link = F.concat(F.when(i % 5 == 0, "http://192.168.0.1/").otherwise("https://f.test/"), i)
    title = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("<title>"), "source", F.lit(" &amp; co</title>")))
    at = F.lpad((i % 60).cast("string"), 2, "0")
    date = F.when(i % 4 == 0, "").when(i % 2 == 0, F.concat(F.lit("<updated>2024-01-02T00:00:"), at, F.lit("Z</updated>"))).otherwise(F.concat(F.lit("<updated>Tue, 02 Jan 2024 00:00:"), at, F.lit(" GMT</updated>")))
    body = F.concat(F.lit("<rss><channel><item>"), title, F.lit("<link>"), link, F.lit("</link><description>says "), i, F.lit("</description>"), date, F.lit("</item></channel></rss>"))
    return files.read_feeds(_documents(spark, sf).select(body.alias("body")), c.NOW).select("url", "host", "title", "description", "kind", "fetched_at")


@query(f"WITH {PARTED} SELECT page_id, NOT ({HUB}) AND page_id % 9 <> 0 AND scheme <> '' AS kept FROM S")
def scrub(spark, sf):
    d = c.page_urls(spark, sf).withColumn("title", F.when(F.col("page_id") % 9 == 0, "Access denied").otherwise("Fine"))
    kept, dropped = maintain.scrub(d)
    return kept.select("page_id", F.lit(True).alias("kept")).unionByName(dropped.select("page_id", F.lit(False).alias("kept")))


@query("SELECT doc_id % 5 - 2 AS simhash FROM documents WHERE doc_id % 5 <> 2")
def simhash_scan(spark, sf):
    return store.simhashes(_documents(spark, sf).select((F.col("doc_id") % 5 - 2).alias("simhash")))


@query("SELECT doc_id AS url_key, CASE WHEN doc_id % 3 = 0 THEN doc_id * 2 END AS seen_at FROM documents")
def seen_lookup(spark, sf):
    d = _documents(spark, sf).select(F.col("doc_id").alias("url_key"))
    seen = d.where("url_key % 3 = 0")
    return store.seen_at(d, seen.withColumn("seen_at", F.col("url_key") * 2).unionByName(seen.withColumn("seen_at", F.col("url_key"))))


@query("SELECT DISTINCT 'https://' || source || '.test/feed' AS url FROM documents")
def feed_list(spark, sf):
    d = _documents(spark, sf).select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".test/feed")).alias("url"))
    return store.list_feeds(store.add_feeds(d.where("doc_id % 2 = 0").select("url").distinct(), d))


@query(f"WITH {c.CORPUS} SELECT doc_id FROM D WHERE doc_id % 6 > 0")
def doc_delete(spark, sf):
    d = c.corpus(spark, sf)
    return maintain.delete(d, d.where("doc_id % 6 = 0")).select("doc_id")


@query("SELECT max_docs, max_bytes, (max_docs > 0 AND n >= max_docs) OR (max_bytes > 0 AND b >= max_bytes) AS full FROM (SELECT count(*) AS n, sum(strlen(text)) AS b FROM documents), (VALUES (0, 0), (1, 0), (1000000000, 0), (0, 1), (0, 1000000000000), (1000000000, 1)) v(max_docs, max_bytes)")
def size_gate(spark, sf):
    limits = [(0, 0), (1, 0), (10**9, 0), (0, 1), (0, 10**12), (10**9, 1)]
    d = c.corpus(spark, sf)
    return spark.createDataFrame([(a, b, store.over_limit(d, a, b)) for a, b in limits], "max_docs long, max_bytes long, full boolean")


@query(f"WITH {c.CORPUS} SELECT url, host, title, fetched_at, body, 'q' AS label FROM D")
def export_json_array(spark, sf):
    """Through the sink: written line by line, read back, and parsed."""
    path = new_path(spark, "array")
    maintain.to_json_array(c.corpus(spark, sf), "q").write.text(path)
    lines = spark.read.text(path).where("value not in ('[', ']', ',')")
    parsed = F.from_json("value", "url string, domain string, title string, added bigint, updated bigint, text string, label string").alias("d")
    return lines.select(parsed).select("d.url", F.col("d.domain").alias("host"), "d.title", F.least("d.added", "d.updated").alias("fetched_at"), F.col("d.text").alias("body"), "d.label")


@query("SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS queries, round(avg(value), 6) AS queries_avg_ms, round((SELECT count(*) FROM documents) / 90.0 * 60, 6) AS docs_per_min FROM events")
def query_averages(spark, sf):
    out = maintain.stats(c.corpus(spark, sf), None, _events(spark, sf).select(F.col("value").alias("took_ms")), 90.0)
    return out.select("docs", "queries", F.round("queries_avg_ms", 6).alias("queries_avg_ms"), F.round("docs_per_min", 6).alias("docs_per_min"))


@query(f"WITH {c.CORPUS} SELECT url, doc_id FROM D WHERE doc_id % 2 = 0")
def compacted(spark, sf):
    """Saved, cut down, saved as the next version, and compacted in place."""
    path = new_path(spark, "docs")
    first = maintain.save_docs(c.corpus(spark, sf).select("url", "doc_id"), path)
    maintain.save_docs(first.where("doc_id % 2 = 0"), path)
    maintain.compact(spark, path, 2)
    return maintain.load_docs(spark, path)


@query("""WITH E AS (SELECT event_id AS seq, 'u' || user_id AS site, event_id % 3 = 0 AS ok, event_id % 500 AS lat FROM events), R AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY site ORDER BY seq) AS g FROM E), X AS (SELECT seq, site, lat, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY site, g ORDER BY seq) AS f FROM R)
SELECT site, seq, CAST(f AS INT) AS failures, CAST(seq * 1000 + least(greatest(2000, lat * 2) * CAST(pow(2, least(f, 6)) AS BIGINT), 30000) AS BIGINT) AS next_allowed_ms FROM X""")
def stream_politeness(spark, sf):
    schema = _events(spark, sf).schema
    e = crawl_stream.read_tables(spark, sf, "events", schema).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("site"), F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("at_ms"), (F.col("event_id") % 3 == 0).alias("ok"), (F.col("event_id") % 500).alias("latency_ms"), F.lit(0).alias("robots_ms")
    )
    return _streamed(crawl_stream.politeness(e), "append")


@query()
def crawl_passes(spark, sf):
    """Documents of two passes over the pages table, seeded with every third page."""
    pages = c.spread(spark, sf, "pages")
    web = pages.select("url", F.lit(200).alias("status"), "html", F.lit("text/html").alias("content_type"), F.lit(100).alias("latency_ms"), F.lit(None).cast("int").alias("retry_after"), F.lit(None).cast("string").alias("error"), F.md5("html").alias("etag"), F.lit("").alias("last_modified"))
    web = web.withColumn("url", urls.canonical(F.col("url"))).dropDuplicates(["url"])
    config = crawl.CrawlConfig(jitter_ms=0, min_delay_ms=0)
    state = crawl.new_state(spark, pages.where("page_id % 3 = 0").select("url"), c.NOW, config)
    for n in range(2):
        state = crawl.crawl_pass(state, web, files.read_blocklist(spark), (c.NOW + 100 * n) * 1000, config=config)
    return state.docs.select("url", "site", "title", "fetched_at")
