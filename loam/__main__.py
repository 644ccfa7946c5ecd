"""Commands over a folder with a store and its index: python -m loam --data FOLDER COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import extract, urls
from loam.operators import crawl, maintain, search
from loam.operators.index import Index, build
from loam.operators.tables import Versions
from loam.sources import files, sinks

#: Columns of a stored document that commands need; others are kept as they are.
INDEXED = ("doc_id", "url", "host", "title", "body", "description", "kind", "fetched_at", "authority")


def _docs(spark: SparkSession, data: str) -> DataFrame:
    if Versions(spark, f"{data}/docs").current() is None:
        return spark.createDataFrame([], files.DOCS)
    return maintain.load_docs(spark, f"{data}/docs")


def _indexed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.xxhash64("url"), "description": F.coalesce("description", F.lit(""))}).select(*INDEXED)


def _as_crawled(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Stored documents with the columns of a crawl's."""
    given = {"site": urls.site_key(F.col("host")), "n_outlinks": F.size("links").cast("bigint")}
    return docs.select([F.col(f.name) if f.name in docs.columns else given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


def _save(spark: SparkSession, data: str, docs: DataFrame) -> int:
    """Store documents and index them; both are whole versions."""
    stored = maintain.save_docs(docs, f"{data}/docs")
    build(_indexed(stored)).save(f"{data}/index")
    return stored.count()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loam", description=__doc__)
    p.add_argument("--data", required=True, help="folder of the store and the index")
    p.add_argument("--config", help="TOML file with a table [crawl]")
    c = p.add_subparsers(dest="command", required=True)
    run = c.add_parser("crawl", help="crawl fetched pages, a Parquet table as crawl.crawl_pass has it")
    run.add_argument("--web", required=True)
    run.add_argument("--seeds-file")
    run.add_argument("--seed", action="append", default=[])
    run.add_argument("--passes", type=int, default=10)
    run.add_argument("--max-docs", type=int, default=0)
    run.add_argument("--max-bytes", type=int, default=0)
    find = c.add_parser("search", help="one page of hits, a JSON object a line")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--kind")
    c.add_parser("stats", help="counters of the store")
    c.add_parser("compact", help="few sorted files in place of many")
    cut = c.add_parser("prune", help="drop the oldest documents until the caps hold")
    cut.add_argument("--keep-docs", type=int)
    cut.add_argument("--max-bytes", type=int)
    cut.add_argument("--max-age-days", type=int)
    page = c.add_parser("fetch", help="what a page says, from a file of HTML")
    page.add_argument("url")
    page.add_argument("--html", required=True)
    out = c.add_parser("export", help="all documents as a folder of text")
    out.add_argument("-o", "--out", default="docs.jsonl")
    out.add_argument("-f", "--format", choices=["jsonl", "array"], default="jsonl")
    c.add_parser("reindex", help="build the index anew from the store")
    take = c.add_parser("import", help="documents of JSON lines")
    take.add_argument("-i", "--input", required=True)
    push = c.add_parser("push", help="send all documents to another service")
    push.add_argument("url")
    push.add_argument("--token", default="")
    return p


def _post(url: str):  # noqa: ANN202
    def send(body: str, headers: dict[str, str]) -> None:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, body.encode(), headers), timeout=60):
            pass

    return send


def main(args: Sequence[str], spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("loam").getOrCreate()
    data, now = given.data.rstrip("/"), int(time.time())
    match given.command:
        case "crawl":
            config = crawl.load_config(given.config)
            known = _docs(spark, data)
            state = crawl.new_state(spark, files.read_seeds(spark, given.seeds_file, listed=given.seed), now, config)
            state.docs = _as_crawled(known, state.docs)
            for n in range(given.passes):
                if state.frontier.isEmpty():
                    break
                at = (now + n * config.max_delay_ms // 1000) * 1000
                state = crawl.crawl_pass(state, spark.read.parquet(given.web), files.read_blocklist(spark), at, config=config, max_docs=given.max_docs, max_bytes=given.max_bytes)
            print(_save(spark, data, maintain.upsert(known, state.docs.where(F.col("fetched_at") >= now))))
        case "search":
            hits = search.search(Index.load(spark, f"{data}/index"), given.query, given.limit, given.offset, given.kind, now)
            for r in search.json_page(hits).collect():  # a page of hits
                print(r["value"])
        case "stats":
            print(json.dumps(maintain.stats(_docs(spark, data)).first().asDict()))
        case "compact":
            print(maintain.compact(spark, f"{data}/docs").count())
        case "prune":
            kept, dropped = maintain.prune(_docs(spark, data), now, given.max_age_days, given.keep_docs, given.max_bytes)
            gone = dropped.count()
            _save(spark, data, kept)
            print(gone)
        case "fetch":
            print(json.dumps(extract.extract_page(Path(given.html).read_text(), given.url), ensure_ascii=False))
        case "export":
            docs = _docs(spark, data)
            (maintain.to_jsonl(docs) if given.format == "jsonl" else maintain.to_json_array(docs)).write.mode("overwrite").text(given.out)
            print(docs.count())
        case "reindex":
            docs = _docs(spark, data)
            build(_indexed(docs)).save(f"{data}/index")
            print(docs.count())
        case "import":
            new, old = files.read_jsonl(spark, given.input, now), _docs(spark, data)
            _save(spark, data, maintain.upsert(old, new))
            print(new.count())
        case "push":
            sinks.push_batches(_docs(spark, data), _post(given.url), 100, given.token)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
