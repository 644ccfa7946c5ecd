"""The tables that registered queries run on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text

NOW = 1_735_689_600

#: URLs that rules are tried on beside the table's own.
URLS = [
    "https://web.archive.org/web/2020/http://x.org/", "https://de.wikipedia.org/wiki/Rust", "https://en.wikipedia.org/wiki/Rust", "https://wikipedia.org/", "https://en.wikipedia.org/wiki/File:A.png",
    "https://x.test/w/index.php?title=A", "https://x.test/a.PDF", "https://x.test/wp-admin/x", "https://x.test/account/login", "https://x.test/labyrinth/7", "https://x.test/a/b/c/d/e/f/g/h/i/j/k",
    "https://x.test/0123456789abcdef0123456789/0123456789abcdef0123456789", "https://x.test/p?SID=1", "https://x.test/p?print=1&a=2", "https://x.test/p?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=10&k=11",
    "https://x.test/tag/rust/2", "https://x.test/blog/tag", "https://x.test/amp/story", "https://x.test/users/ann", "https://x.test/users", "https://x.test/2024", "https://x.test/2024/05", "https://x.test/2024/05/17",
    "https://x.test/2024/05/my-post", "https://x.test/wiki/Category:Birds", "https://x.test/post?replytocom=3", "https://x.test/?s=rust", "https://x.test/register", "https://docs.x.test/register/guide/now",
    "https://www.youtube.com/watch?v=1&si=abc&app=x", "https://www.google.com/search?q=a&ved=1", "https://a.co.uk/x?utm_source=1&b=2&a=1", "http://x.test:80/a", "https://x.test:443/a", "https://x.test:8443/a#b",
    "https://user:pw@x.test/a", "ftp://x.test/a", "https://X.Test/Mixed?Z=1&a=", "https://forum.x.test/viewtopic/9", "https://sub.github.com/a/b", "https://medium.com/@a/b", "https://docs.python.org/3/",
    "https://minecraft.wiki/w/Creeper", "https://m.pinterest.co.uk/pin/1", "https://spam-farm.example.com/x", "https://10.1.2.3/x", "https://8.8.8.8/x", "http://localhost/x",
]
BLOCKED = ["spam-farm.example.com", "cheap-pills.example.net", "casino-win.example.org", "pinterest.co.uk"]
TITLES = ["Just a moment...", "Sign in", " Log In ", "How to sign in", "404 Not Found", "", "   ", "Welcome", "CAPTCHA check", "Best - Top 10 | Reviews 2025"]

URL_SQL = r"'^(?i:(https?))://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work each; where its files make fewer tasks than there are cores, rows are dealt out."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


_INDEXES: dict[tuple[str, str], str] = {}


def loaded_index(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The index of the whole corpus, saved once a session and loaded from its files, as a service has it."""
    from loam.operators import index
    from loam.operators.tables import new_path

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        path = new_path(spark, "index")
        index.build(corpus(spark, sf_dir)).save(path)
        _INDEXES[key] = path
    return index.Index.load(spark, _INDEXES[key])


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values: list[str]) -> str:
    return "[" + quoted(values) + "]"


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url): the pages' URLs, and URLS under negative ids."""
    own = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(own)


PAGE_URLS = "PU AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted([u])})" for i, u in enumerate(URLS)) + ") v(page_id, url))"
URL_PARTS = f"""PP AS (SELECT page_id, url, lower(regexp_extract(url, {URL_SQL}, 1)) AS scheme, regexp_extract(url, {URL_SQL}, 2) AS authority,
 lower(regexp_replace(regexp_replace(regexp_extract(url, {URL_SQL}, 2), '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(url, {URL_SQL}, 3) AS path, regexp_extract(url, {URL_SQL}, 4) AS query FROM PU)"""
PARTS = f"{PAGE_URLS}, {URL_PARTS}"


def site_sql(host: str) -> str:
    from loam.functions.fixed_values import TWO_LEVEL_SUFFIXES

    parts = f"string_split({host}, '.')"
    last = lambda n: f"array_to_string(list_slice({parts}, -{n}, -1), '.')"
    return f"CASE WHEN len({parts}) <= 2 THEN {host} WHEN {last(2)} IN ({quoted(TWO_LEVEL_SUFFIXES)}) THEN {last(3)} ELSE {last(2)} END"


SITES = f"{PARTS}, PS AS (SELECT *, {site_sql('host')} AS site FROM PP)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a search engine, made of the documents table."""
    d = spread(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".test/d/"), "doc_id").alias("url"), F.concat("source", F.lit(".test")).alias("host"), F.array_join(F.slice(text.words(F.col("text")), 1, 8), " ").alias("title"),
        F.col("text").alias("body"), F.lit("").alias("description"), F.when(F.col("doc_id") % 5 == 0, "rss").otherwise("page").alias("kind"), (F.lit(1_704_067_200) + F.col("doc_id") * 600).alias("fetched_at"),
        (F.col("doc_id") % 12).cast("double").alias("authority"),
    )


CORPUS = r"""D AS (SELECT doc_id, 'https://' || source || '.test/d/' || doc_id AS url, source || '.test' AS host,
 array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 1, 8), ' ') AS title, text AS body, '' AS description,
 CASE WHEN doc_id % 5 = 0 THEN 'rss' ELSE 'page' END AS kind, 1704067200 + doc_id * 600 AS fetched_at, CAST(doc_id % 12 AS DOUBLE) AS authority FROM documents)"""


def tokens_sql(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40)"


def bm25_sql(terms: list[str], need: int, boosts: dict[str, float], extra: str = "") -> str:
    """CTEs up to SC (doc_id, bm25), documents with ``need`` of the terms."""
    fields = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, CAST({b} AS DOUBLE) AS boost, {tokens_sql(f)} AS toks FROM D" for f, b in boosts.items())
    values = ", ".join(f"({quoted([t])})" for t in terms)
    return f"""{CORPUS}, TK AS MATERIALIZED ({fields}), FS AS (SELECT field, count(*) AS n, avg(len(toks)) AS al FROM TK GROUP BY field),
PO AS (SELECT * FROM (SELECT doc_id, field, boost, term, len(list_filter(toks, lambda t: t = term)) AS tf, len(toks) AS len FROM TK, (VALUES {values}) q(term)) WHERE tf > 0),
DF AS (SELECT term, field, count(*) AS df FROM PO GROUP BY term, field),
SC AS (SELECT doc_id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al)))) AS bm25, count(DISTINCT term) AS met
 FROM PO JOIN FS USING (field) JOIN DF USING (term, field) GROUP BY doc_id HAVING count(DISTINCT term) >= {need}{extra})"""
