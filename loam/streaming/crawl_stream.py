"""The stateful parts of the crawl as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.functions import urls
from loam.operators.crawl import CrawlConfig
from loam.operators.tables import discard, new_path


def read_tables(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:  # noqa: ANN001
    """A table's files, and those that join them later, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").option("recursiveFileLookup", "true").parquet(folder)


def first_seen(stream: DataFrame, key: str = "url_key", within: str | None = None, at: str | None = None) -> DataFrame:
    """The first row of each key.  With ``within`` state is dropped that long behind the newest ``at``, and a key may come again."""
    if within and at:
        return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def counts(stream: DataFrame, at: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Rows by window of event time and ``by``, for rows up to ``late`` behind the newest."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def politeness(fetches: DataFrame, config: CrawlConfig = CrawlConfig(jitter_ms=0), forget_after_s: int | None = None) -> DataFrame:
    """For each fetch (site, seq, at_ms, ok, latency_ms, robots_ms) the site's failures in a row and when it may be asked again.

    State is two numbers a site.  With ``forget_after_s`` it is dropped that
    long after the site was last asked; such a stream has no end of its own.
    """
    low, high, factor = config.min_delay_ms, max(config.max_delay_ms, config.min_delay_ms), max(config.delay_factor, 0.0)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        ok = rows["ok"].to_numpy(bool)
        place = np.arange(len(ok))
        last = np.maximum.accumulate(np.where(ok, place, -1))  # the last success up to each fetch
        run = np.where(last >= 0, place - last, place + 1 + failures)
        base = np.maximum(np.maximum(low, rows["robots_ms"].to_numpy(np.int64)), (rows["latency_ms"].to_numpy(np.float64) * factor).astype(np.int64))
        allowed = rows["at_ms"].to_numpy(np.int64) + np.minimum(base << np.minimum(run, 6), high)
        state.update((int(run[-1]), int(allowed[-1])))
        if forget_after_s:
            state.setTimeoutDuration(forget_after_s * 1000)
        yield pd.DataFrame({"site": key[0], "seq": rows["seq"].to_numpy(np.int64), "failures": run.astype(np.int32), "next_allowed_ms": allowed})

    return fetches.groupBy("site").applyInPandasWithState(step, "site string, seq long, failures int, next_allowed_ms long", "failures int, allowed long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after_s else GroupStateTimeout.NoTimeout)


def upsert_into(path: str, key: str = "url", order: str = "fetched_at") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep the newest row of each key in a table of versions; a batch that is run again changes nothing.

    The version before the last stays for its readers; older ones are deleted.
    """
    from pyspark.sql import Window

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        exists = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:09d}/_SUCCESS").getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:09d}/_SUCCESS"))
        if exists(number):
            return
        both = batch.unionByName(spark.read.parquet(f"{path}/v{number - 1:09d}")) if number and exists(number - 1) else batch
        newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        both.withColumn("__n", newest).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{path}/v{number:09d}")
        if number > 1:
            discard(spark, f"{path}/v{number - 2:09d}")

    return merge


def frontier_keys(pages: DataFrame) -> DataFrame:
    """(url_key, url, site) of a stream of pages."""
    url = urls.normalize(F.col("url"))
    return pages.select(url.alias("url")).where("url is not null").select(F.xxhash64("url").alias("url_key"), "url", urls.site_key(urls.host_of(F.col("url"))).alias("site"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)  # a complete result takes the place of the one before

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
