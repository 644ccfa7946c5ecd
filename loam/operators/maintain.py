"""Maintenance of stored documents: upsert, prune, scrub, reindex, export, compact, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text, urls

from .tables import Versions


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Documents with new ones in place of those with their URL."""
    both = docs.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("__new"), F.desc("fetched_at")))
    return both.withColumn("__n", latest).where("__n = 1").drop("__n", "__new")


def delete(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("url"), "url", "left_anti")


def oldest(docs: DataFrame, n: int) -> DataFrame:
    """(url) of the n oldest documents by (fetched_at, url), without sorting them all.

    Counts by day and then by second, at most 86400 numbers, find the second
    that the cut is in; only its documents are put in order.
    """

    def cut(rows: DataFrame, by: Column, left: int) -> tuple[int | None, int]:
        """The group that the cut falls in, and how many of it are left to take."""
        for r in rows.groupBy(by.alias("k")).agg(F.count("*").alias("n")).orderBy("k").toLocalIterator():
            if r["n"] >= left:
                return r["k"], left
            left -= r["n"]
        return None, 0

    at = F.col("fetched_at")
    day, left = cut(docs, F.floor(at / 86_400), n)
    if day is None:
        return docs.select("url")
    inside = docs.where((at >= day * 86_400) & (at < (day + 1) * 86_400))
    second, left = cut(inside, at, left)
    return docs.where(at < second).select("url").unionByName(inside.where(at == second).select("url").orderBy("url").limit(left))


def prune(docs: DataFrame, now: int, days: int | None = None, keep: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): what is older than ``days``, and the oldest beyond ``keep``, go; then the oldest until the bodies fit.

    Bytes are brought under the cap in up to four rounds, each keeping the
    share that would fit if all documents were alike, and one at least.
    """
    dropped = docs.select("url").limit(0)
    if days is not None:
        dropped = docs.where(F.col("fetched_at") < now - days * 86_400).select("url")
    if keep is not None and (extra := docs.count() - keep) > 0:
        dropped = dropped.unionByName(oldest(docs, extra)).distinct()
    kept = delete(docs, dropped)
    for _ in range(4 if max_bytes is not None else 0):
        n, size = kept.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
        if not size or size <= max_bytes or n <= 1:
            break
        target = max(1, int(max_bytes / size * n))
        extra = oldest(kept, n - target)
        dropped, kept = dropped.unionByName(extra), delete(kept, extra)
    return kept, dropped


def scrub(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): hub URLs, junk titles and URLs that cannot be parsed go."""
    u = F.col("url")
    bad = urls.skip_index_url(u) | text.junk_title(F.col("title")) | (urls.scheme(u) == "")
    return docs.where(~bad), docs.where(bad)


def missing_from_index(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Stored documents that the index lacks, as it will have them: no authority, no description."""
    return docs.join(indexed.select("url"), "url", "left_anti").withColumns({"authority": F.lit(0.0), "description": F.lit("")})


def to_jsonl(docs: DataFrame) -> DataFrame:
    """One JSON object a line (value), in order of URL."""
    return docs.orderBy("url").select(F.to_json(F.struct("url", "title", "host", "fetched_at", F.col("body").alias("text"))).alias("value"))


def to_json_array(docs: DataFrame, label: str = "") -> DataFrame:
    """Lines of one JSON array: brackets, a document a line, commas on lines of their own."""
    d = docs.select("url", F.to_json(F.struct("url", F.col("host").alias("domain"), "title", F.col("body").alias("text"), F.col("fetched_at").alias("added"), F.col("fetched_at").alias("updated"), F.lit(0).alias("type"), F.lit(label).alias("label"))).alias("value"))
    first = d.agg(F.min("url")).first()[0]
    body = d.select("url", F.explode(F.when(F.col("url") == F.lit(first), F.array("value")).otherwise(F.array(F.lit(","), F.col("value")))).alias("value"), F.lit(1).alias("part"))
    body = body.withColumn("comma", (F.col("value") != ",").cast("int"))
    edge = lambda v, part: docs.sparkSession.createDataFrame([("", v, part, 0)], "url string, value string, part int, comma int")
    return edge("[", 0).unionByName(body).unionByName(edge("]", 2)).orderBy("part", "url", "comma").select("value")


def save_docs(docs: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write a table's next version in few, sorted files, and make it the current one; gives it as readers see it."""
    spark, versions = docs.sparkSession, Versions(docs.sparkSession, path)
    to = versions.new()
    x = docs.repartitionByRange(partitions, "url") if partitions else docs.repartitionByRange("url")
    x.sortWithinPartitions("url").write.option("compression", "zstd").parquet(to)
    versions.publish(to)
    return spark.read.parquet(to)


def load_docs(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    return spark.read.parquet(Versions(spark, path).current())


def compact(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Write a table anew in few, sorted files; readers see the old files until all new ones are there."""
    return save_docs(load_docs(spark, path), path, partitions)


def stats(docs: DataFrame, frontier: DataFrame | None = None, queries: DataFrame | None = None, uptime_s: float = 0.0) -> DataFrame:
    """One row of counters: documents, bytes, sites, queued, queries, mean query time, documents a minute."""
    out = docs.agg(F.count("*").alias("docs"), F.sum(F.octet_length("body")).alias("bytes"), F.count_distinct(urls.site_key(F.col("host"))).alias("sites"), F.sum((F.col("kind") == "rss").cast("int")).alias("rss"))
    more = [frontier.agg(F.count("*").alias("queued"), F.count_distinct("site").alias("sites_queued"))] if frontier is not None else []
    more += [queries.agg(F.count("*").alias("queries"), F.avg("took_ms").alias("queries_avg_ms"))] if queries is not None else []
    for counts in more:
        out = out.withColumns({k: F.lit(v) for k, v in counts.first().asDict().items()})
    return out.withColumn("docs_per_min", F.col("docs") / uptime_s * 60 if uptime_s else F.lit(0.0))


#: Counters that are reported, in order.
METRICS = ["docs", "index_docs", "index_bytes", "queue_pending", "queue_disk", "workers_in_flight", "io_errors", "io_degraded", "queries_total", "queries_ms_total", "uptime_secs"]


def metrics(counters: dict[str, int], prefix: str = "loam") -> str:
    """All counters as Prometheus lines; those not given are 0."""
    return "".join(f"{prefix}_{name} {int(counters.get(name, 0))}\n" for name in METRICS)
