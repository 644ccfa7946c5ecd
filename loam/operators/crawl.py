"""The crawl as plans over tables: pages to documents, links to the next frontier, politeness as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import extract, text, urls

from . import maintain, store
from .dedup import greedy_kept
from .tables import saved


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 3
    max_outlinks: int = 80
    pages_per_site: int = 500
    min_chars: int = 200
    min_chars_media: int = 24
    text_bytes: int = 16384
    min_delay_ms: int = 2000
    max_delay_ms: int = 30_000
    delay_factor: float = 2.0
    jitter_ms: int = 250
    max_retries: int = 2
    recrawl_secs: int = 86_400
    max_crawl_delay_ms: int = 30_000
    max_pending: int = 100_000
    near_bits: int = 3


def load_config(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "LOAM_") -> CrawlConfig:
    """Settings of a TOML file's table ``crawl``, then of variables such as LOAM_MAX_DEPTH; numbers that do not parse are left out."""
    import os
    import tomllib
    from pathlib import Path

    given = tomllib.loads(Path(path).read_text()).get("crawl", {}) if path else {}
    env = dict(os.environ) if env is None else env
    found = {}
    for name, default in vars(CrawlConfig()).items():
        if name in given:
            found[name] = type(default)(given[name])
        try:
            found[name] = type(default)(env[prefix + name.upper()])
        except (KeyError, ValueError):
            continue
    return CrawlConfig(**found)


def not_blocked(rows: DataFrame, blocklist: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is not a blocked domain or below one; ``blocklist`` is (domain)."""
    return rows.join(blocked_hosts(rows, blocklist, host), host, "left_anti")


def blocked_hosts(rows: DataFrame, blocklist: DataFrame, host: str = "host") -> DataFrame:
    """Distinct hosts of rows that are blocked."""
    each = rows.select(host).distinct().select(host, F.explode(urls.suffixes(F.col(host))).alias("domain"))
    return each.join(blocklist, "domain", "left_semi").select(host).distinct()


def outlinks(pages: DataFrame, links: str = "links", most: int = 80, blocklist: DataFrame | None = None) -> DataFrame:
    """(page_id, at, url): each page's first accepted links, in order, canonical."""
    each = pages.select("page_id", F.posexplode(links).alias("at", "raw")).select("page_id", "at", urls.canonical(F.col("raw")).alias("url"))
    each = each.where(F.col("url").isNotNull() & ~urls.skip_url(F.col("url")))
    if blocklist is not None:
        each = not_blocked(each.withColumn("host", urls.host_of(F.col("url"))), blocklist).drop("host")
    return first_links(each, most)


def first_links(each: DataFrame, most: int = 80) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return each.withColumn("n", n).where(F.col("n") <= max(most, 1)).drop("n")


def host_authority(links: DataFrame, url: str = "url") -> DataFrame:
    """(host, inlinks, authority): links to each host, over all pages."""
    hosts = links.select(urls.host_of(F.col(url)).alias("host")).where("host <> ''")
    return hosts.groupBy("host").agg(F.count("*").alias("inlinks")).withColumn("authority", F.log1p("inlinks"))


def running_authority(docs: DataFrame, links: DataFrame, block: int = 100_000) -> DataFrame:
    """(seq, host, inlinks): links to a page's host from pages up to and with it; docs (seq, host), links (seq, host).

    Sums run within blocks of ``block`` numbers and over the blocks' totals, so
    that a host with very many links is not one task's work.
    """
    marks = links.groupBy("host", "seq").agg(F.count("*").alias("n")).select("host", "seq", "n", F.lit(False).alias("page"))
    rows = marks.unionByName(docs.select("host", "seq", F.lit(0).cast("long").alias("n"), F.lit(True).alias("page")))
    rows = rows.withColumn("block", F.floor(F.col("seq") / block))
    within = F.sum("n").over(Window.partitionBy("host", "block").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum("total").over(Window.partitionBy("host").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = marks.groupBy("host", F.floor(F.col("seq") / block).alias("block")).agg(F.sum("n").alias("total"))
    blocks = rows.select("host", "block").distinct().join(totals, ["host", "block"], "left").select("host", "block", F.coalesce("total", F.lit(0)).alias("total"))
    earlier = blocks.withColumn("earlier", F.coalesce(before, F.lit(0))).drop("total")
    return rows.withColumn("within", within).where("page").join(earlier, ["host", "block"]).select("seq", "host", (F.col("within") + F.col("earlier")).alias("inlinks"))


def tarpit(html_text: Column, links: Column, host: Column, path: Column) -> Column:
    """Mazes of links within one site, and babble, except on media, wiki and forum pages."""
    site = urls.site_key(host)
    own = F.size(F.filter(links, lambda u: urls.site_key(urls.host_of(u)) == site))
    maze = (own * 10 >= F.size(links) * 7) & text.is_link_maze(html_text, F.size(links))
    return ~urls.is_media_host(host) & ~urls.is_wiki_host(host) & ~urls.is_forum_path(path) & (maze | text.is_babble(html_text))


def judged(pages: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Fetched pages (page_id, url, html) with what they say, their ``fate`` and the links to ``follow``.

    Fates: noindex (followed no further), hub (followed, not indexed), thin
    (neither), tarpit (only its links to other sites are followed), page.
    """
    x = pages.select("page_id", F.col("url").alias("requested"), urls.canonical(F.col("url")).alias("url"), extract.extract("html", "url").alias("e"))
    x = x.select("page_id", "requested", "url", "e.*").where("url is not null")
    x = saved(x.withColumn("host", urls.host_of(F.col("url"))).withColumn("site", urls.site_key(F.col("host"))))
    least = F.when(urls.is_media_host(F.col("host")), config.min_chars_media).otherwise(config.min_chars)
    trap = tarpit(F.col("text"), F.col("links"), F.col("host"), urls.path_of(F.col("url")))
    fate = F.when(F.col("noindex"), "noindex").when(urls.skip_index_url(F.col("url")), "hub").when(~text.is_indexable(F.col("title"), F.col("text"), least), "thin").when(trap, "tarpit").otherwise("page")
    none = F.array().cast("array<string>")
    away = F.filter("links", lambda u: urls.site_key(urls.host_of(u)) != F.col("site"))
    x = x.withColumn("fate", fate)
    return x.withColumn("follow", F.when(F.col("fate").isin("hub", "page"), F.col("links")).when(F.col("fate") == "tarpit", away).otherwise(none))


def documents(pages: DataFrame, config: CrawlConfig = CrawlConfig(), known: DataFrame | None = None) -> DataFrame:
    """Documents of fetched pages (page_id, url, html) in order of page_id, through all gates."""
    return documents_of(judged(pages, config), config, known)


def documents_of(x: DataFrame, config: CrawlConfig = CrawlConfig(), known: DataFrame | None = None) -> DataFrame:
    """Documents of judged pages.

    Columns: page_id, url, host, site, title, body, description, kind, simhash,
    links, n_outlinks, canonical, authority, inlinks.  ``known`` has the documents
    so far (simhash, and url if they have one); they come first.  A page whose
    canonical URL is of its own host is that URL's document, unless there is one
    already; a page of that very URL replaces it.
    """
    x = saved(x.where("fate = 'page'").withColumn("simhash", text.simhash64(text.normalized(F.col("text")))))
    edges = x.select(F.col("page_id").alias("seq"), F.explode("links").alias("raw")).select("seq", urls.canonical(F.col("raw")).alias("to")).where("to is not null").select("seq", urls.host_of(F.col("to")).alias("host"))
    weight = running_authority(x.select(F.col("page_id").alias("seq"), "host"), edges).select(F.col("seq").alias("page_id"), "inlinks")
    hashes = x.select(F.col("page_id").alias("id"), "simhash")
    if known is not None:
        before = known.where("simhash <> 0").select((-1 - F.monotonically_increasing_id()).alias("id"), "simhash")
        hashes = saved(hashes.unionByName(before))
    stay = greedy_kept(hashes, config.near_bits).select(F.col("id").alias("page_id"))
    x = x.join(stay, "page_id", "left_semi").join(weight, "page_id")
    named = urls.canonical(F.col("canonical"))
    x = x.withColumn("named", F.when(F.col("canonical") != "", named))
    x = x.withColumn("final", F.when(urls.host_of(F.col("named")) == F.col("host"), F.col("named")).otherwise(F.col("url"))).drop("named")
    x = first_of_site(x, config.pages_per_site)
    if known is not None and "url" in known.columns:
        held = known.select(F.col("url").alias("final")).distinct()
        x = x.where("final = url").unionByName(x.where("final <> url").join(held, "final", "left_anti").select(*x.columns))
    own = F.col("url") == F.col("final")
    order = F.row_number().over(Window.partitionBy("final").orderBy(F.desc(own), F.when(own, -F.col("page_id")).otherwise(F.col("page_id"))))
    x = x.withColumn("__f", order).where("__f = 1")
    return x.select(
        "page_id", F.col("final").alias("url"), "host", "site", text.display_title(F.col("title"), F.col("text")).alias("title"), text.clip_text(F.col("text"), config.text_bytes).alias("body"), "description", F.lit("page").alias("kind"),
        "simhash", "links", F.size("links").cast("bigint").alias("n_outlinks"), "canonical", F.log1p("inlinks").alias("authority"), "inlinks",
    )


def first_of_site(rows: DataFrame, most: int, order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The first ``most`` rows of each site; each task drops what cannot be among them before rows are dealt out."""
    n = F.row_number().over(Window.partitionBy("site").orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def polite_wait_ms(latency: Column, robots_delay: Column, failures: Column, config: CrawlConfig = CrawlConfig(jitter_ms=0)) -> Column:
    """Time until a site may be asked again, in ms."""
    adaptive = F.floor(latency * max(config.delay_factor, 0.0))
    base = F.greatest(F.lit(config.min_delay_ms), robots_delay, adaptive).cast("bigint")
    backed = F.when(failures > 0, base * F.pow(F.lit(2), F.least(failures, F.lit(6))).cast("bigint")).otherwise(base)
    held = F.least(backed, F.lit(max(config.max_delay_ms, config.min_delay_ms)).cast("bigint"))
    return held + F.floor(F.rand() * (config.jitter_ms + 1)).cast("bigint") if config.jitter_ms else held


def status_route(status: Column, html: Column, attempts: Column, failures: Column, retry_after: Column, error: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """struct<ok, retry, penalty_s, ban_s> of a fetch: status (null on failure), whether it is HTML, and the kind of error (timeout, drip, other)."""
    again = attempts < config.max_retries
    slow = error.isin("timeout", "drip")
    route = lambda ok, retry, penalty, ban: F.struct(F.lit(ok).alias("ok"), retry.alias("retry"), penalty.alias("penalty_s"), ban.alias("ban_s"))
    no, none = F.lit(False), F.lit(0).cast("bigint")
    return (
        F.when(status == 304, route(True, no, none, none))
        .when(status.isin(403, 503), route(False, no, none, none))
        .when(status == 429, route(False, no, F.greatest(F.coalesce(retry_after, F.lit(60)), F.lit(1)).cast("bigint"), none))
        .when(status.between(200, 299) & ~html, route(True, no, none, none))
        .when(status.between(200, 299), route(True, no, none, none))
        .when(slow, route(False, again, none, F.when(failures > 3, F.lit(3600)).otherwise(F.lit(0)).cast("bigint")))
        .otherwise(route(False, again, none, none))
    )


def failures_in_a_row(fetches: DataFrame) -> DataFrame:
    """``fetches`` (site, seq, ok) with failures: how many have failed since the site's last success."""
    w = Window.partitionBy("site").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("ok").cast("int")).over(w)
    x = fetches.withColumn("__run", run)
    inside = Window.partitionBy("site", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(inside)).drop("__run")


def frontier_order(frontier: DataFrame) -> DataFrame:
    """``frontier`` with place: order within a site, priority lane first, then depth, then arrival."""
    w = Window.partitionBy("site").orderBy(F.desc("priority"), "depth", "enqueued_at", "url_key")
    return frontier.withColumn("place", F.row_number().over(w))


def lease(frontier: DataFrame, host_state: DataFrame, now_ms: int, most: int = 256) -> DataFrame:
    """The first row of each site that may be asked now and has none in flight, soonest deadline first."""
    state = host_state.select("site", "next_allowed_ms", "banned_until", "in_flight")
    x = frontier_order(frontier).where("place = 1").join(state, "site", "left")
    free = (F.coalesce("next_allowed_ms", F.lit(0)) <= now_ms) & (F.coalesce("banned_until", F.lit(0)) * 1000 <= now_ms) & ~F.coalesce("in_flight", F.lit(False))
    lane = [F.desc("priority"), F.when(F.col("priority"), F.col("enqueued_at"))]
    return x.where(free).orderBy(*lane, F.coalesce("next_allowed_ms", F.lit(0)), "depth", "site").limit(most).select(*frontier.columns)


def fetchable(rows: DataFrame, blocklist: DataFrame, docs: DataFrame | None = None, robots: DataFrame | None = None, agent: str = "loam", config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Leased rows that may be fetched, with canonical URL and delay_ms; the others leave the frontier for good.

    Depth, URL rules (sitemaps are let through), blocklist, robots (site,
    status, body) and the site's budget of stored ``docs`` (site) decide.
    """
    from loam.sources import files

    x = rows.where(F.col("depth") <= config.max_depth).withColumn("url", urls.canonical(F.col("url"))).where("url is not null")
    x = x.where(urls.is_sitemap_url(F.col("url")) | ~urls.skip_url(F.col("url"))).withColumn("host", urls.host_of(F.col("url")))
    x = not_blocked(x, blocklist).drop("host")
    if docs is not None:
        full = docs.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= config.pages_per_site).select("site")
        x = x.join(full, "site", "left_anti")
    if robots is None:
        return x.withColumn("delay_ms", F.lit(0).cast("bigint"))
    x = x.join(robots.select("site", F.col("status").alias("__status"), F.col("body").alias("__rules")), "site", "left")
    path = F.concat(urls.path_of(F.col("url")), F.when(urls.query_of(F.col("url")) == "", "").otherwise(F.concat(F.lit("?"), urls.query_of(F.col("url")))))
    verdict = F.when(F.col("__rules").isNull() & F.col("__status").isNull(), "allow").otherwise(files.robots_verdict(F.col("__status")))
    parsed = F.when(verdict == "parse", F.coalesce("__rules", F.lit(""))).otherwise("")
    x = x.withColumn("__verdict", verdict).withColumn("__rules", parsed).where("__verdict <> 'deny'").where(files.robots_allowed(agent)(F.col("__rules"), path))
    x = x.withColumn("delay_ms", files.crawl_delay_ms(F.col("__rules"), agent)).drop("__status", "__rules", "__verdict")
    return x.where(F.col("delay_ms") <= config.max_crawl_delay_ms) if config.max_crawl_delay_ms else x


def unchanged(rows: DataFrame, docs: DataFrame, web: DataFrame) -> DataFrame:
    """Rows (url) whose stored document has the etag, or the time of change, that the web has for it: a conditional fetch answers 304."""
    old = docs.select("url", F.col("etag").alias("__etag"), F.col("last_modified").alias("__modified"))
    new = web.select("url", "etag", "last_modified")
    same = ((F.col("__etag") != "") & (F.col("__etag") == F.col("etag"))) | ((F.col("__modified") != "") & (F.col("__modified") == F.col("last_modified")))
    return rows.join(old.join(new, "url").where(same).select("url"), "url", "left_semi")


def done(host_state: DataFrame, results: DataFrame, now_ms: int, config: CrawlConfig = CrawlConfig(jitter_ms=0)) -> DataFrame:
    """Host state (site, next_allowed_ms, banned_until, in_flight, failures) after fetches, one a site: (site, ok, robots_ms, latency_ms, penalty_s, ban_s)."""
    old = host_state.select("site", F.col("next_allowed_ms").alias("was"), F.col("banned_until").alias("until"), F.col("in_flight").alias("busy"), F.col("failures").alias("failed"))
    x = old.join(results, "site", "full")
    fetched = F.col("ok").isNotNull()
    failures = F.when(F.col("ok"), 0).otherwise(F.coalesce("failed", F.lit(0)) + 1)
    wait = polite_wait_ms(F.col("latency_ms"), F.col("robots_ms"), failures, config)
    later = F.when(F.col("penalty_s") > 0, F.lit(now_ms) + F.col("penalty_s") * 1000).otherwise(F.lit(now_ms) + wait)
    ban = F.when(F.col("ban_s") > 0, F.floor(F.lit(now_ms) / 1000) + F.col("ban_s")).otherwise(F.coalesce("until", F.lit(0)))
    return x.select(
        "site", F.when(fetched, later).otherwise(F.col("was")).cast("bigint").alias("next_allowed_ms"), F.when(fetched, ban).otherwise(F.col("until")).cast("bigint").alias("banned_until"),
        (~fetched & F.coalesce("busy", F.lit(False))).alias("in_flight"), F.when(fetched, failures).otherwise(F.col("failed")).cast("int").alias("failures"),
    )


def push_recrawl(frontier: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to fetch again, seen or not, that are not queued; the caller marks them seen."""
    first = F.row_number().over(Window.partitionBy("url_key").orderBy("depth", "enqueued_at"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n").join(frontier.select("url_key"), "url_key", "left_anti")


def push(frontier: DataFrame, seen: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that are neither seen nor queued, one for each url_key, the shallowest."""
    first = F.row_number().over(Window.partitionBy("url_key").orderBy("depth", "enqueued_at"))
    x = new.withColumn("__n", first).where("__n = 1").drop("__n")
    return x.join(seen.select("url_key"), "url_key", "left_anti").join(frontier.select("url_key"), "url_key", "left_anti")


def stale(rows: DataFrame, seen: DataFrame, now: int, recrawl_secs: int) -> DataFrame:
    """Rows (url_key) never seen, or seen ``recrawl_secs`` ago and more; none with 0."""
    if not recrawl_secs:
        return rows.limit(0)
    x = rows.join(seen.groupBy("url_key").agg(F.max("seen_at").alias("seen_at")), "url_key", "left")
    return x.where(F.col("seen_at").isNull() | (F.lit(now) - F.col("seen_at") >= recrawl_secs)).drop("seen_at")


def requeue(docs: DataFrame, seen: DataFrame, now: int, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Stale documents to fetch again, a quarter of the queue at most, in order of URL."""
    cap = max(config.max_pending, 1000) // 4
    x = docs.withColumn("url_key", F.xxhash64("url")).where(~urls.skip_url(F.col("url")))
    return stale(x, seen, now, config.recrawl_secs).orderBy("url").limit(cap).withColumn("score", F.lit(0.5))


def expand(pages: DataFrame, frontier: DataFrame, seen: DataFrame, blocklist: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """The next frontier rows of pages (page_id, links, depth, score, fetched_at)."""
    found = outlinks(pages, most=config.max_outlinks, blocklist=blocklist).join(pages.select("page_id", "depth", "score", "fetched_at"), "page_id")
    rows = found.where(F.col("depth") + 1 <= config.max_depth).select(
        F.xxhash64("url").alias("url_key"), "url", urls.site_key(urls.host_of(F.col("url"))).alias("site"), (F.col("depth") + 1).alias("depth"), (F.col("score") * 0.9).alias("score"),
        F.lit(0).alias("attempts"), F.col("fetched_at").alias("enqueued_at"), F.lit(False).alias("priority"),
    )
    return push(frontier, seen, rows)


def seed(seeds: DataFrame, seen: DataFrame, now: int, config: CrawlConfig = CrawlConfig(), priority: bool = False) -> DataFrame:
    """Frontier rows of seed URLs (url): unseen ones, and seen ones that are stale; with ``priority`` all."""
    x = seeds.select(urls.canonical(F.col("url")).alias("url")).where(F.col("url").isNotNull() & ~urls.skip_url(F.col("url"))).distinct()
    x = x.withColumn("url_key", F.xxhash64("url"))
    if not priority:
        fresh = x.join(seen.select("url_key"), "url_key", "left_anti")
        x = fresh.unionByName(stale(x, seen, now, config.recrawl_secs)).distinct() if config.recrawl_secs else fresh
    return x.select("url_key", "url", urls.site_key(urls.host_of(F.col("url"))).alias("site"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit(0).alias("attempts"), F.lit(now).cast("bigint").alias("enqueued_at"), F.lit(priority).alias("priority"))


@dataclass
class CrawlState:
    """All tables of a crawl between two passes."""

    docs: DataFrame
    frontier: DataFrame
    seen: DataFrame
    host_state: DataFrame


DOCS = "page_id bigint, url string, host string, site string, title string, body string, description string, kind string, simhash bigint, links array<string>, n_outlinks bigint, authority double, fetched_at bigint, etag string, last_modified string"
FRONTIER = "url_key bigint, url string, site string, depth int, score double, attempts int, enqueued_at bigint, priority boolean"
HOST_STATE = "site string, next_allowed_ms bigint, banned_until bigint, in_flight boolean, failures int"


def new_state(spark: SparkSession, seeds: DataFrame, now: int, config: CrawlConfig = CrawlConfig()) -> CrawlState:
    """A crawl that has its seeds (url) queued and nothing fetched."""
    empty = lambda schema: spark.createDataFrame([], schema)
    seen = empty("url_key bigint, seen_at bigint")
    rows = saved(seed(seeds, seen, now, config).select(*[c.split()[0] for c in FRONTIER.split(", ")]))
    return CrawlState(empty(DOCS), rows, rows.select("url_key", F.lit(now).cast("bigint").alias("seen_at")), empty(HOST_STATE))


def crawl_pass(state: CrawlState, web: DataFrame, blocklist: DataFrame, now_ms: int, robots: DataFrame | None = None, config: CrawlConfig = CrawlConfig(jitter_ms=0), most: int = 256, max_docs: int = 0, max_bytes: int = 0) -> CrawlState:
    """The state after one lease has been fetched from ``web`` and worked off.

    ``web`` has what a fetch would give: (url, status, html, content_type,
    latency_ms, retry_after, error, etag, last_modified); a URL that it lacks
    fails.  A full store leases nothing.
    """
    if store.over_limit(state.docs, max_docs, max_bytes):
        return state
    now = now_ms // 1000
    leased = saved(lease(state.frontier, state.host_state, now_ms, most))
    asked = saved(fetchable(leased, blocklist, state.docs, robots, config=config))
    same = unchanged(asked.select("url"), state.docs, web).withColumn("__same", F.lit(True))
    got = asked.join(web, "url", "left").join(same, "url", "left").join(state.host_state.select("site", F.col("failures").alias("__failed")), "site", "left")
    failed = F.coalesce("__failed", F.lit(0))
    status = F.when(F.col("__same"), 304).otherwise(F.col("status"))
    error = F.coalesce("error", F.when(F.col("status").isNull(), "other"))
    html = text.content_type_ok(F.coalesce("content_type", F.lit("")))
    route = status_route(status, html, F.col("attempts"), failed, F.col("retry_after"), error, config)
    got = saved(got.withColumn("status", status).withColumn("html", F.when((status == 200) & html, F.col("html"))).withColumn("page_id", F.row_number().over(Window.orderBy("enqueued_at", "url_key"))).withColumn("r", route).withColumn("__failed", failed))
    listed = F.when(extract.is_sitemap(F.col("html")), extract.sitemap_urls(F.col("html"))).otherwise(extract.feed_links(F.col("html")))
    lists = got.where("html is not null").withColumn("follow", listed).where(extract.is_sitemap(F.col("html")) | (F.size("follow") > 0))
    x = saved(judged(got.where("html is not null").join(lists.select("page_id"), "page_id", "left_anti").select("page_id", "url", "html"), config))
    ids = ["page_id", "depth", "attempts", "score", "etag", "last_modified"]
    new = documents_of(x, config, state.docs).join(got.select(*ids), "page_id").withColumn("fetched_at", F.lit(now).cast("bigint"))
    columns = [c.split()[0] for c in DOCS.split(", ")]
    docs = saved(maintain.upsert(state.docs, new.withColumns({c: F.coalesce(c, F.lit("")) for c in ("etag", "last_modified")}).select(*columns)))

    # A page's links are worth less than those of lists and hubs; those of pages that made no document are not followed.
    kept = new.select("page_id").withColumn("__kept", F.lit(True))
    follow = x.join(kept, "page_id", "left").where("fate <> 'page' or __kept").select("page_id", "follow", F.when(F.col("fate") == "page", 0.9).otherwise(1.0).alias("worth"))
    follow = follow.unionByName(lists.select("page_id", "follow", F.lit(1.0).alias("worth"))).join(got.select("page_id", "depth", "score"), "page_id")
    links = follow.select("page_id", F.col("follow").alias("links"), "depth", (F.col("score") * F.col("worth") / 0.9).alias("score"), F.lit(now).cast("bigint").alias("fetched_at"))
    again = got.where("r.retry").select("url_key", "url", "site", "depth", "score", (F.col("attempts") + 1).alias("attempts"), "enqueued_at", "priority")
    rest = store.remove(state.frontier, leased)
    fresh = saved(expand(links, rest, state.seen, blocklist, config).unionByName(_advertised(asked, state, robots, rest, now)).dropDuplicates(["url_key"]))
    names = [c.split()[0] for c in FRONTIER.split(", ")]
    frontier = saved(rest.select(*names).unionByName(again.select(*names)).unionByName(fresh.select(*names)))
    seen = saved(store.mark_seen(state.seen, fresh, now))

    trapped = x.where("fate = 'tarpit'").select("page_id").withColumn("__trap", F.lit(True))
    ends = got.join(trapped, "page_id", "left").select(
        "site", (F.col("r.ok") & F.col("__trap").isNull()).alias("ok"), F.col("delay_ms").alias("robots_ms"), F.coalesce("latency_ms", F.lit(0)).cast("bigint").alias("latency_ms"), F.col("r.penalty_s").alias("penalty_s"),
        F.when(F.col("__trap") & (F.col("__failed") > 2), 3600).otherwise(F.col("r.ban_s")).alias("ban_s"),
    )
    gone = leased.join(asked.select("url_key"), "url_key", "left_anti").select("site", F.lit(True).alias("ok"), *[F.lit(0).cast("bigint").alias(c) for c in ("robots_ms", "latency_ms", "penalty_s", "ban_s")])
    return CrawlState(docs, frontier, seen, saved(done(state.host_state, ends.unionByName(gone), now_ms, config)))


def _advertised(asked: DataFrame, state: CrawlState, robots: DataFrame | None, rest: DataFrame, now: int) -> DataFrame:
    """Frontier rows of the sitemaps that robots files of sites asked for the first time name."""
    from loam.sources import files

    first = asked.join(state.host_state.select("site"), "site", "left_anti")
    bodies = robots.where("status between 200 and 299").select("site", "body") if robots is not None else asked.sparkSession.createDataFrame([], "site string, body string")
    found = first.join(bodies, "site").select(F.explode(files.robots_sitemaps(F.col("body"))).alias("raw"), "depth", "score").select(urls.canonical(F.col("raw")).alias("url"), "depth", "score").where("url is not null")
    rows = found.select(F.xxhash64("url").alias("url_key"), "url", urls.site_key(urls.host_of(F.col("url"))).alias("site"), (F.col("depth") + 1).alias("depth"), "score", F.lit(0).alias("attempts"), F.lit(now).cast("bigint").alias("enqueued_at"), F.lit(False).alias("priority"))
    return push(rest, state.seen, rows)
