"""Reads and writes of the store's tables, each a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_meta(docs: DataFrame) -> DataFrame:
    return docs.select("url", "fetched_at")


def simhashes(docs: DataFrame) -> DataFrame:
    """Hashes of documents that have one."""
    return docs.where("simhash <> 0").select("simhash")


def get_doc(docs: DataFrame, url: str) -> DataFrame:
    """The document of a URL; the condition reaches the files' statistics."""
    return docs.where(F.col("url") == url)


def seen_at(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (url_key) with seen_at, null if never."""
    return rows.join(seen.groupBy("url_key").agg(F.max("seen_at").alias("seen_at")), "url_key", "left")


def mark_seen(seen: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """``seen`` with the keys of ``rows`` as of now."""
    both = seen.select("url_key", "seen_at").unionByName(rows.select("url_key", F.lit(now).cast("bigint").alias("seen_at")))
    return both.groupBy("url_key").agg(F.max("seen_at").alias("seen_at"))


def pop_frontier(frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n rows of the lowest keys, and the rest."""
    taken = frontier.orderBy("url_key").limit(n)
    return taken, remove(frontier, taken)


def remove(frontier: DataFrame, gone: DataFrame) -> DataFrame:
    return frontier.join(gone.select("url_key"), "url_key", "left_anti")


def ban_hosts(state: DataFrame, bans: DataFrame) -> DataFrame:
    """Host state (site, banned_until) with new bans in place of old ones."""
    kept = state.select("site", "banned_until").join(bans.select("site"), "site", "left_anti")
    return kept.unionByName(bans.select("site", "banned_until"))


def not_banned(rows: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """Rows (site) whose site is not banned now."""
    return rows.join(state.where(F.col("banned_until") > now).select("site"), "site", "left_anti")


def add_feeds(feeds: DataFrame, new: DataFrame) -> DataFrame:
    return feeds.select("url").unionByName(new.select("url")).distinct()


def list_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.select("url").orderBy("url")


def retry(rows: DataFrame, max_retries: int = 2) -> DataFrame:
    """Rows (attempts) that may be tried again, with one attempt more."""
    return rows.where(F.col("attempts") < max_retries).withColumn("attempts", F.col("attempts") + 1)


def over_limit(docs: DataFrame, max_docs: int, max_bytes: int) -> bool:
    """Whether the store is full; one row of counts."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    return bool((max_docs and n >= max_docs) or (max_bytes and size >= max_bytes))
