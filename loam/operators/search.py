"""Search over the index tables: retrieval with fallback tiers, re-ranking, caps, diversity, snippets, spelling.

A query is small and parsed on the driver; everything about documents is one
lazy plan.  The only probes are whether a tier found anything.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import fixed_values as V
from loam.functions import urls
from loam.functions.text import clipped

from . import index as ix
from . import queryspec as qs

PER_SITE = 3


def _lit_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a query's terms: bounded by the query


def _sum(values: Column) -> Column:
    """The sum of a group's few values, the same in whatever order its rows come: equal documents have equal scores."""
    return F.aggregate(F.array_sort(F.collect_list(values)), F.lit(0.0), lambda a, b: a + b)


def retrieve(index: ix.Index, clauses: list[qs.Clause], need: int | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, bm25): documents that match ``need`` positive clauses (None: all) and no negative one.

    A clause of several terms is a phrase: the terms stand one after the other in one field.
    """
    boosts = ix.BOOSTS if boosts is None else boosts
    positive = [c for c in clauses if not c.negative]
    if not positive:
        return index.docs.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
    rows = [(i, k, t, f, float(boosts.get(f, 1.0)), len(c.terms), c.negative) for i, c in enumerate(clauses) for k, t in enumerate(c.terms) for f in c.fields if f in boosts or c.negative]
    wanted = _lit_rows(index.docs, rows, "clause int, place int, term string, field string, boost double, n int, negative boolean")
    asked = F.col("term").isin(sorted({t for c in clauses for t in c.terms}))  # reaches the files' statistics
    stats = index.term_stats.where(asked).join(F.broadcast(index.field_stats), "field")
    weights = F.broadcast(wanted.join(stats, ["term", "field"]).select("clause", "place", "term", "field", "boost", "n", "negative", "avg_len", ix.idf(F.col("n_docs"), F.col("df")).alias("idf")))
    found = index.postings.where(asked).join(weights, ["term", "field"])
    single = found.where("n = 1").select("doc_id", "field", "clause", "negative", "boost", "idf", "avg_len", "tf", "len")
    phrases = found.where("n > 1").select("doc_id", "field", "clause", "negative", "boost", "n", "avg_len", "idf", "len", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
    merged = phrases.groupBy("doc_id", "field", "clause", "negative", "boost", "n", "avg_len", "len").agg(_sum(F.col("idf")).alias("idf"), F.collect_list("starts").alias("all"))
    together = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    merged = merged.where(F.size("all") == F.col("n")).withColumn("tf", F.size(together)).where("tf > 0").select(*single.columns)
    hits = single.unionByName(merged) if any(len(c.terms) > 1 for c in clauses) else single
    weight = F.when(F.col("negative"), 0.0).otherwise(F.col("boost") * F.col("idf") * ix.term_weight(F.col("tf"), F.col("len"), F.col("avg_len")))
    docs = hits.groupBy("doc_id").agg(_sum(weight).alias("bm25"), F.size(F.collect_set(F.when(~F.col("negative"), F.col("clause")))).alias("met"), F.max("negative").alias("bad"))
    return docs.where((F.col("met") >= (len(positive) if need is None else need)) & ~F.col("bad")).select("doc_id", "bm25")


def spec_filter(spec: qs.QuerySpec, kind: str | None = None) -> Column:
    """Conditions on documents that a query's operators set."""
    host, low = F.col("host"), F.lower("url")
    of = lambda d: urls.under(host, d) | urls.under(urls.bare(host), d)
    tests = [F.lit(True)]
    if spec.sites:
        tests.append(reduce(lambda a, b: a | b, map(of, spec.sites)))
    tests += [~of(d) for d in spec.not_sites] + [F.contains(low, F.lit(t)) for t in spec.inurl]
    if spec.before is not None:
        tests.append(F.col("fetched_at") <= spec.before)
    if spec.after is not None:
        tests.append(F.col("fetched_at") >= spec.after)
    if kind:
        tests.append(F.lower("kind") == kind.lower())
    return reduce(lambda a, b: a & b, tests)


def _flat(terms: list[str]) -> list[qs.Clause]:
    return [qs.Clause((t,), ("title", "body")) for t in terms]


def _words(spec: qs.QuerySpec) -> list[str]:
    return sorted({t for c in qs.clauses(spec.text) if not c.negative for t in c.terms})


PLAIN = {"title": 1.0, "body": 1.0}


def two_of_n(index: ix.Index, spec: qs.QuerySpec) -> DataFrame | None:
    """Documents with two at least of 2 to 6 distinct words, in title or body."""
    words = [t for t in _words(spec) if len(t.encode()) >= 2]
    return retrieve(index, _flat(words), 2, PLAIN) if 2 <= len(words) <= 6 else None


def anchor(index: ix.Index, spec: qs.QuerySpec) -> str | None:
    """The rarest word of a query that is in the index."""
    stats = index.term_stats.where(F.col("term").isin(_words(spec)) & F.col("field").isin("title", "body"))
    row = stats.groupBy("term").agg(F.sum("df").alias("df")).orderBy("df", "term").first()
    return row["term"] if row else None


def anchored(index: ix.Index, spec: qs.QuerySpec, word: str) -> DataFrame:
    """Documents with the anchor; the other words add to the score."""
    must = retrieve(index, _flat([word]), 1, PLAIN).select("doc_id")
    return retrieve(index, _flat(_words(spec)), 1, PLAIN).join(must, "doc_id", "left_semi")


def navigation(index: ix.Index, text: str) -> DataFrame | None:
    """Up to 20 documents of hosts that the query may name."""
    word = qs.navigational(text)
    if not word:
        return None
    pattern = r"^(.*\.)?" + re.escape(word) + r"\.(" + "|".join(V.NAVIGATION_DOMAINS) + ")$"
    return index.docs.where(F.col("host").rlike(pattern)).select("doc_id").orderBy("doc_id").limit(20)


def candidates(index: ix.Index, spec: qs.QuerySpec, limit: int) -> DataFrame:
    """(doc_id, bm25, rank): the best of the first tier that finds anything, by score and then doc_id."""
    if not spec.text.strip() and spec.has_operators:
        n = max(200, min(20_000, index.docs.count()))
        only = spec_filter(qs.QuerySpec(sites=spec.sites)) if spec.sites else F.lit(True)
        return index.docs.where(only).select("doc_id", F.lit(1.0).alias("bm25")).orderBy("doc_id").limit(n).select("doc_id", "bm25", F.row_number().over(Window.orderBy("doc_id")).alias("rank"))
    top = lambda df: df.orderBy(F.desc("bm25"), "doc_id").limit(max(6 * limit, 200))
    ranked = lambda df: df.select("doc_id", "bm25", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc_id")).alias("rank"))  # noqa: E731  of bounded rows
    parsed = qs.clauses(spec.text) or qs.clauses(qs.sanitize(spec.text))
    strict = ranked(top(retrieve(index, parsed)))
    named = navigation(index, spec.text)
    if named is not None:
        extra = named.join(strict, "doc_id", "left_anti")
        strict = strict.unionByName(extra.select("doc_id", F.lit(0.0).alias("bm25"), (F.lit(1_000_000) + F.row_number().over(Window.orderBy("doc_id"))).alias("rank")))
    if not parsed or not strict.isEmpty() or not _words(spec):
        return strict
    second = two_of_n(index, spec)
    if second is not None and not (found := ranked(top(second))).isEmpty():
        return found
    word = anchor(index, spec)
    return ranked(top(anchored(index, spec, word) if word else retrieve(index, _flat(_words(spec)), 1, PLAIN)))


def title_key(title: Column, host: Column) -> Column:
    """Letters and digits of a title, lower-case, less words that are labels of the host, run together; 48 characters."""
    plain = F.lower(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}\s]", ""))
    labels = F.split(host, r"\.")
    left = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & (w != "www") & (w != F.get(labels, F.lit(0))))
    run = F.array_join(left, "")
    gone = F.exists(F.slice(labels, 2, F.size(labels)), lambda x: x == run)
    return F.when(gone & (F.size(labels) > 1), "").otherwise(F.substring(run, 1, 48))


def cap_sites(hits: DataFrame, most: int = PER_SITE) -> DataFrame:
    """The first hits of each site; ``hits`` has rank and host."""
    w = Window.partitionBy(urls.site_key(F.col("host"))).orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def dedupe(hits: DataFrame, per_site: bool = True) -> DataFrame:
    """At most three hits of a site, then one of each title; ``hits`` has rank, host and title."""
    if per_site:
        hits = cap_sites(hits)
    keyed = hits.withColumn("__key", title_key(F.col("title"), F.col("host")))
    w = Window.partitionBy("__key").orderBy("rank")
    return keyed.withColumn("__n", F.row_number().over(w)).where("__key = '' or __n = 1").drop("__n", "__key")


def _hits(text: Column, terms: list[str]) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def freshness(now: int, newsy: bool) -> Column:
    days = F.greatest(F.lit(now) - F.col("fetched_at"), F.lit(0)) / 86400.0
    rss, page = (7.0, 30.0) if newsy else (60.0, 365.0)
    return F.when(F.lower("kind") == "rss", 1 / (1 + days / rss * 0.4)).otherwise(1 / (1 + days / page * 0.2))


def title_boost(terms: list[str]) -> Column:
    if not terms:
        return F.lit(1.0)
    t = F.lower("title")
    phrase = F.when(F.contains(t, F.lit(" ".join(terms))), 0.35).otherwise(0.0) if len(terms) > 1 else F.lit(0.0)
    return 1 + _hits(t, terms) / len(terms) * 0.4 + phrase


def url_boost(terms: list[str]) -> Column:
    return 1 + _hits(F.lower("url"), terms) / len(terms) * 0.2 if terms else F.lit(1.0)


def name_boost(terms: list[str]) -> Column:
    """6 for a host that is the query's only word, 1.9 for a path that has one of its words as a part."""
    if not 1 <= len(terms) <= 3:
        return F.lit(1.0)
    labels = F.split(F.lower("host"), r"\.")
    name = F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.lower("host"))
    long = [t for t in terms if len(t.encode()) >= 4]
    parts = F.transform(F.split(F.lower("url"), "/"), lambda s: F.regexp_replace(s, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    out = F.when(F.exists(parts, lambda s: s.isin(long)), 1.9).otherwise(1.0) if long else F.lit(1.0)
    return F.when(name == terms[0], 6.0).otherwise(out) if len(terms) == 1 else out


def bait_penalty() -> Column:
    t = F.lower("title")
    marks = sum(((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s) for s in V.BAIT_SEPARATORS), F.lit(0))
    return F.when((marks >= 2) & (_hits(t, V.BAIT_WORDS) >= 2), 0.7).otherwise(1.0)


def rerank(hits: DataFrame, spec: qs.QuerySpec, now: int) -> DataFrame:
    """``hits`` (rank, bm25 and document columns) with score: BM25 times what else speaks for a document."""
    terms = qs.query_terms(spec.text)
    name = name_boost(terms)
    score = (
        F.when(F.col("bm25") > 0, F.col("bm25")).otherwise(1.0) * (1 + F.least(F.col("authority"), F.lit(10.0)) * 0.15) * freshness(now, qs.is_newsy(spec.text)) * urls.host_quality(F.col("host")) * title_boost(terms) * url_boost(terms) * name * bait_penalty()
    )
    return hits.withColumn("score", F.when(name >= 6, F.greatest(score, F.lit(300.0))).otherwise(score))


def sense_key(query: str) -> Column:
    """Site name and the title's first long word that is not in the query: hits of one key have one sense."""
    labels = F.split(urls.bare(F.col("host")), r"\.")
    site = F.array_join(F.when(F.size(labels) >= 2, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels), ".")
    asked = [w for w in re.split(r"[\W_]+", query.lower()) if len(w.encode()) >= 2]
    words = F.filter(F.split(F.lower("title"), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: (F.octet_length(t) >= 4) & ~t.isin(asked + V.SENSELESS_WORDS))
    return F.concat(site, F.lit(":"), F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def diversify(hits: DataFrame, query: str, limit: int) -> DataFrame:
    """``hits`` (score, rank) with place: no sense takes over a third of the front half; the rest keep their order behind.

    ``hits`` are a page's pool, a few hundred at most.
    """
    front, each = max(limit // 2, 4), max((max(limit // 2, 4) + 1) // 3, 2)
    by = [F.desc("score"), "rank"]
    n = F.count("*").over(Window.partitionBy())
    x = hits.withColumn("__n", n).withColumn("__of", F.row_number().over(Window.partitionBy(sense_key(query)).orderBy(*by)))
    fit = F.col("__of") <= each
    x = x.withColumn("__at", F.sum(fit.cast("int")).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    ahead = (F.col("__n") > 6) & fit & (F.col("__at") <= front)
    place = F.row_number().over(Window.orderBy(F.desc(ahead), *by))
    return x.withColumn("place", place).where(F.col("place") <= limit).drop("__n", "__of", "__at")


def snippet(terms: list[str], size: int = 240) -> Column:
    """Description or lead with all terms, else what surrounds the first term in the body, else description, else title."""
    has = lambda t: reduce(lambda a, b: a & b, [F.contains(F.lower(t), F.lit(x)) for x in terms], F.lit(True))
    lead = F.substring("body", 1, size)
    pattern = "(?is)(.{0,100}(?:" + "|".join(map(re.escape, terms)) + ").{0,120})" if terms else "(?!)(x)"
    around = F.substring(F.regexp_extract("body", pattern, 1), 1, size)
    d = F.col("description")
    return F.when((d != "") & has(d), d).when(has(lead), lead).when(around != "", around).when(d != "", d).otherwise(F.col("title"))


def search(index: ix.Index, query: str, limit: int = 20, offset: int = 0, kind: str | None = None, now: int = 0, prefilter: bool = False) -> DataFrame:
    """A page of hits: url, host, title, snippet, score, fetched_at, kind, place.

    ``limit`` is held to 1..100 and ``offset`` to 10000.  Filters act on the
    retrieved candidates, after the choice of tier; with ``prefilter`` they act
    on the documents before retrieval, so that no match can be crowded out.
    """
    limit, offset = max(1, min(100, limit)), max(0, min(10_000, offset))
    spec, top = qs.parse(query), max(1, min(100, limit)) + max(0, min(10_000, offset))
    if prefilter:
        kept = index.docs.where(spec_filter(spec, kind))
        index = ix.Index(kept, index.postings.join(kept.select("doc_id"), "doc_id", "left_semi"), index.lengths, index.term_stats, index.field_stats)
    found = candidates(index, spec, top).join(index.docs, "doc_id").where(spec_filter(spec, kind))
    pool = dedupe(found, not spec.sites).orderBy("rank").limit(max(4 * top, 20))
    ranked = diversify(rerank(pool, spec, now), spec.text, top)
    page = ranked.where(F.col("place") > offset)
    return page.select("doc_id", "url", "host", "title", clipped(snippet(qs.query_terms(spec.text))).alias("snippet"), "score", "fetched_at", "kind", "place").orderBy("place")


def suggest(index: ix.Index, query: str) -> str | None:
    """The query with unknown words replaced by near, frequent ones of the same first two letters; None if nothing changes."""
    words = [w for w in query.lower().split() if len(w.encode()) >= 4]
    if not words:
        return None
    best = {r["word"]: r["term"] for r in suggestions(index, words).collect()}  # one row a word at most
    known = {r["term"] for r in index.term_stats.where(F.col("term").isin(words) & (F.col("field") == "body")).select("term").distinct().collect()}
    out = " ".join(w if w in known else best.get(w, w) for w in words)
    return out if out != " ".join(words) else None


def suggestions(index: ix.Index, words: list[str]) -> DataFrame:
    """(word, term, df): the most frequent body term near each word, first in order among equals."""
    asked = _lit_rows(index.docs, [(w, w[:2], 1 if len(w.encode()) <= 5 else 2) for w in sorted(set(words))], "word string, prefix string, most int")
    begins = reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in sorted({w[:2] for w in words})])  # reaches the files' statistics
    stats = index.term_stats.where(begins & (F.col("field") == "body")).select("term", "df", F.substring("term", 1, 2).alias("prefix"))
    near = stats.join(asked, "prefix").withColumn("far", F.levenshtein("term", "word")).where("far between 1 and most")
    w = Window.partitionBy("word").orderBy(F.desc("df"), "term")
    return near.withColumn("n", F.row_number().over(w)).where("n = 1").select("word", "term", "df")


def json_page(hits: DataFrame) -> DataFrame:
    """One JSON object a hit, in order."""
    return hits.orderBy("place").select(F.to_json(F.struct("url", "host", "title", "snippet", "score", "fetched_at", "kind")).alias("value"))


def rss_page(hits: DataFrame, title: str) -> DataFrame:
    """One RSS 2.0 document of a page of hits."""
    from loam.functions.text import escape_xml, rss_date

    x = lambda c: escape_xml(F.col(c))
    item = F.concat(F.lit("<item><title>"), x("title"), F.lit("</title><link>"), x("url"), F.lit("</link><description>"), x("snippet"), F.lit("</description><pubDate>"), rss_date(F.col("fetched_at")), F.lit("</pubDate></item>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda p: p["item"]), "")
    lead = F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>')
    return hits.agg(F.concat(lead, escape_xml(F.lit(title)), F.lit("</title>"), items, F.lit("</channel></rss>")).alias("rss"))

