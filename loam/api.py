"""The service's calls as plain functions: search, index, seed, feeds, statistics.  No sockets."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import urls
from loam.operators import crawl, maintain, search
from loam.operators.index import Index, build
from loam.operators.tables import saved
from loam.sources.files import read_feeds


class BadRequest(ValueError):
    """What HTTP would answer with status 400."""


@dataclass
class Service:
    """A document table, its index, a frontier and feeds."""

    spark: SparkSession
    docs: DataFrame
    now: int
    config: crawl.CrawlConfig = field(default_factory=crawl.CrawlConfig)
    token: str | None = None
    body_limit: int = 1 << 20
    seeds: DataFrame | None = None
    feeds: list[str] = field(default_factory=list)
    _index: Index | None = None
    _began: float = field(default_factory=time.monotonic)
    _queries: int = 0
    _queries_ms: int = 0

    def authorized(self, header: str | None) -> bool:
        """Bearer or bare token; anything if none is set."""
        return not self.token or (header or "").removeprefix("Bearer ").strip() == self.token

    def accepts(self, body: bytes) -> bool:
        """Whether a request's body is within the limit."""
        return len(body) <= self.body_limit

    def index(self) -> Index:
        if self._index is None:
            self._index = build(self.docs)
        return self._index

    def search(self, q: str, limit: int = 20, offset: int = 0, kind: str | None = None) -> dict:
        """A page of hits, and a suggestion if there are fewer than three."""
        if not q.strip() or len(q.encode()) > 512:
            raise BadRequest("q must have 1 to 512 bytes")
        hits = self._hits(q, limit, offset, kind)
        return {"query": q, "hits": hits, "did_you_mean": search.suggest(self.index(), q) if len(hits) < 3 else None}

    def search_v1(self, q: str, limit: int = 20, offset: int = 0, kind: str | None = None) -> dict:
        """As ``search``, for queries of any length, in the other shape: ts in place of fetched_at, and the time it took."""
        if not q.strip():
            raise BadRequest("missing q")
        began = time.monotonic()
        hits = [{k: h[f] for k, f in (("url", "url"), ("host", "host"), ("title", "title"), ("snippet", "snippet"), ("kind", "kind"), ("score", "score"), ("ts", "fetched_at"))} for h in self._hits(q, limit, offset, kind)]
        found = search.suggest(self.index(), q) if len(hits) < 3 else None
        return {"hits": hits, "did_you_mean": found, "took_ms": int((time.monotonic() - began) * 1000)}

    def _hits(self, q: str, limit: int, offset: int, kind: str | None) -> list[dict]:
        began = time.monotonic()
        hits = [r.asDict() for r in search.search(self.index(), q, limit, offset, kind, self.now).drop("doc_id").collect()]  # limit is 100 at most
        self._queries, self._queries_ms = self._queries + 1, self._queries_ms + int((time.monotonic() - began) * 1000)
        return hits

    def search_rss(self, q: str, limit: int = 20) -> str:
        return search.rss_page(search.search(self.index(), q, limit, 0, None, self.now), q).first()["rss"]

    def index_doc(self, url: str, title: str = "", body: str = "", kind: str = "page") -> None:
        """Add or replace one document of a public URL."""
        row = self.spark.createDataFrame([(url, title or url, body, kind or "page")], "url string, title string, body string, kind string")
        new = row.where(urls.url_is_public(F.col("url"))).select(
            F.xxhash64("url").alias("doc_id"), "url", urls.host_of(F.col("url")).alias("host"), "title", "body", F.col("body").alias("description"), "kind", F.lit(self.now).cast("bigint").alias("fetched_at"), F.lit(0.0).alias("authority")
        )
        if new.isEmpty():
            raise BadRequest("url is not public")
        self._add(new)

    def _add(self, new: DataFrame) -> None:
        """Upsert documents; of the index only their own postings change."""
        new = saved(new.select(*self.docs.columns))
        if self._index is not None:
            self._index = self._index.upsert(new)
        self.docs = maintain.upsert(self.docs, new)

    def seed(self, listed: list[str], seen: DataFrame, priority: bool = False) -> int:
        if not 1 <= len(listed) <= 5000:
            raise BadRequest("1 to 5000 urls")
        rows = crawl.seed(self.spark.createDataFrame([(u,) for u in listed], "url string"), seen, self.now, self.config, priority)
        self.seeds = rows if self.seeds is None else crawl.push(self.seeds, seen.limit(0), rows).unionByName(self.seeds)
        return rows.count()

    def add_feed(self, url: str, fetched: DataFrame) -> int:
        """Register a feed and index its entries; ``fetched`` has its body."""
        new = saved(read_feeds(fetched, self.now).withColumn("doc_id", F.xxhash64("url")).select(*self.docs.columns).dropDuplicates(["url"]))
        self.feeds = sorted({*self.feeds, url})
        self._add(new)
        return new.count()

    def refresh_feeds(self, fetched: DataFrame) -> int:
        """Index the entries of all registered feeds; ``fetched`` has (url, body), and a feed that it lacks is left for the next time."""
        known = fetched.where(F.col("url").isin(self.feeds)) if self.feeds else fetched.limit(0)
        bodies = {r["url"]: known.where(F.col("url") == r["url"]) for r in known.select("url").distinct().collect()}  # one row a feed
        return sum(self.add_feed(u, bodies[u]) for u in self.feeds if u in bodies)

    def stats(self) -> dict:
        return maintain.stats(self.docs).first().asDict()

    def metrics(self) -> str:
        counted = maintain.stats(self.docs).first()
        queued = self.seeds.count() if self.seeds is not None else 0
        return maintain.metrics({"docs": counted["docs"], "index_docs": self.index().docs.count(), "index_bytes": counted["bytes"] or 0, "queue_pending": queued, "queries_total": self._queries, "queries_ms_total": self._queries_ms, "uptime_secs": int(time.monotonic() - self._began)})

    def health(self) -> str:
        return "ok"
