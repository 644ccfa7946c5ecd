"""Text sources: seeds, blocklists, robots files, feeds, and JSON lines."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions import fixed_values as V
from loam.functions.text import normalized, simhash64

DOCS = "url string, host string, title string, body string, description string, kind string, fetched_at bigint, authority double, n_outlinks bigint, simhash bigint, links array<string>"


#: White space as Unicode has it.
_SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _lines(text: Column | str) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def lead(text: Column, size: int = 160) -> Column:
    """The first ``size`` bytes of a text if a character ends there, else the whole text."""
    raw = F.encode(text, "UTF-8")
    whole = (F.octet_length(text) <= size) | F.hex(F.substring(raw, size + 1, 1)).between("80", "BF")
    return F.when(whole, text).otherwise(F.decode(F.substring(raw, 1, size), "UTF-8"))


def read_seeds(spark: SparkSession, path: str | None = None, config: list[str] = (), listed: list[str] = (), default: list[str] = ()) -> DataFrame:
    """Seed URLs (url): configured, listed, then the file's lines, without blanks and # comments; defaults if there are none."""
    given = spark.createDataFrame([(u,) for u in [*config, *listed]], "url string")
    if path:
        given = given.unionByName(spark.read.text(path).select(_lines("value").alias("url")))
    given = given.select(F.trim("url").alias("url")).where("url <> '' and not startswith(url, '#')")
    return spark.createDataFrame([(u,) for u in default], "url string") if default and given.isEmpty() else given


def read_blocklist(spark: SparkSession, paths: list[str] = (), builtin: bool = True) -> DataFrame:
    """Distinct blocked domains (domain): lower-case, leading ``*.`` taken off."""
    out = spark.createDataFrame([(h,) for h in (V.BLOCKED_HOSTS if builtin else [])], "domain string")
    for p in paths:
        rows = spark.read.text(p).select(_lines("value").alias("v")).where("v <> '' and not startswith(v, '#')")
        out = out.unionByName(rows.select(F.lower(F.regexp_replace("v", r"^(\*\.)+", "")).alias("domain")))
    return out.distinct()


def read_jsonl(spark: SparkSession, path: str, now: int) -> DataFrame:
    """Documents of JSON lines.  Lines that do not begin with { are skipped, malformed JSON fails.

    Rows without an http URL are left out.  The SimHash is that of the raw text.
    """
    schema = "url string, host string, domain string, title string, text string, fetched_at bigint, added bigint, updated bigint, label string"
    rows = spark.read.text(path).select(_lines("value").alias("v")).where("startswith(v, '{')")
    d = rows.select(F.from_json("v", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*").where("startswith(url, 'http')")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        "url", F.coalesce("host", "domain", F.lit("")).alias("host"), F.coalesce("title", F.lit("")).alias("title"), text.alias("body"), lead(text).alias("description"), F.lit("page").alias("kind"),
        F.coalesce("fetched_at", "added", "updated", F.lit(now)).alias("fetched_at"), F.lit(0.0).alias("authority"), F.lit(0).cast("bigint").alias("n_outlinks"), simhash64(text).alias("simhash"), F.array().cast("array<string>").alias("links"),
    )


def robots_verdict(status: Column) -> Column:
    """What a robots response means: parse its text, allow all, or deny all.  A null status is a network failure."""
    return F.when(status.between(200, 299), "parse").when(status.isNull() | (status >= 500), "deny").otherwise("allow")


def _agent_rules(text: str | None) -> list[tuple[list[str], list[tuple[str, str]]]]:
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    for raw in (text or "").splitlines():
        key, colon, value = raw.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif groups and key in ("allow", "disallow"):
            groups[-1][1].append((key, value))
    return groups


def _fits(pattern: str, path: str) -> bool:
    import re

    body = re.escape(pattern.removesuffix("$")).replace(r"\*", ".*")
    return re.match(body + ("$" if pattern.endswith("$") else ""), path) is not None


def robots_allows(text: str | None, agent: str, path: str) -> bool:
    """RFC 9309: the most specific matching rule of the agent's group (else of *) decides, allow before disallow."""
    groups = _agent_rules(text)
    named = [rules for agents, rules in groups if any(a != "*" and a in agent.lower() for a in agents)]
    rules = [r for g in (named or [rules for agents, rules in groups if "*" in agents]) for r in g]
    best = max(((len(p), kind == "allow") for kind, p in rules if p and _fits(p, path)), default=(0, True))
    return best[1]


def robots_allowed(agent: str):  # noqa: ANN201
    """Column function of (text, path)."""

    @F.pandas_udf(T.BooleanType())
    def test(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([robots_allows(t, agent, p or "/") for t, p in zip(text, path, strict=True)])

    return test


def crawl_delay_ms(text: Column, agent: str) -> Column:
    """The last delay that applies to the agent, in ms; every user-agent line decides anew what applies."""
    line = F.transform(F.split(text, "\r?\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, "#.*$", ""))))
    start = F.struct(F.lit(False).alias("on"), F.lit(0).cast("bigint").alias("ms"))

    def step(state: Column, x: Column) -> Column:
        who, secs = F.trim(F.substr(x, F.lit(12))), F.trim(F.substr(x, F.lit(13))).try_cast("double")
        on = F.when(x.startswith("user-agent:"), (who == "*") | F.contains(F.lit(agent.lower()), who)).otherwise(state["on"])
        ms = F.when(state["on"] & x.startswith("crawl-delay:") & secs.isNotNull(), (secs * 1000).cast("bigint")).otherwise(state["ms"])
        return F.struct(on.alias("on"), ms.alias("ms"))

    return F.aggregate(line, start, step, lambda s: s["ms"])


def robots_sitemaps(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?m)^[Ss]itemap:(.*)$")), lambda u: F.trim(u))


ENTRIES = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("link", "title", "body")] + [T.StructField("ts", T.LongType())]))


def _epoch(text: str | None) -> int | None:
    from datetime import datetime, timezone

    if not text:
        return None
    try:
        when = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        try:
            when = datetime.fromisoformat(text.strip())
        except ValueError:
            return None
    return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())


def parse_feed(body: str | None) -> list[dict]:
    """Entries of an RSS or Atom feed in order: link, title (else the link), summary or content, and time."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    out = []
    for entry in (e for e in root.iter() if name(e) in ("item", "entry")):
        said: dict[str, str] = {}
        for x in entry:
            value = x.get("href", "") if name(x) == "link" and x.get("href") else "".join(x.itertext())
            said.setdefault(name(x), value.strip())
        link = said.get("link") or ""
        when = [_epoch(said.get(k)) for k in ("updated", "pubdate", "published", "date")]
        out.append({"link": link, "title": said.get("title") or link, "body": said.get("summary") or said.get("description") or said.get("content") or said.get("encoded") or "", "ts": next((w for w in when if w), None)})
    return [e for e in out if e["link"]]


@F.pandas_udf(ENTRIES)
def feed_entries(body: pd.Series) -> pd.Series:
    return body.map(parse_feed)


def read_feeds(feeds: DataFrame, now: int) -> DataFrame:
    """Search documents of kind rss from fetched feeds (body): the public link of each entry, its summary as body and description."""
    from loam.functions.urls import host_of, url_is_public

    e = feeds.select(F.explode(feed_entries("body")).alias("e")).select("e.*").where(url_is_public(F.col("link")))
    return e.select(
        F.col("link").alias("url"), host_of(F.col("link")).alias("host"), "title", "body", F.col("body").alias("description"), F.lit("rss").alias("kind"), F.coalesce("ts", F.lit(now)).alias("fetched_at"),
        F.lit(0.0).alias("authority"), F.lit(0).cast("bigint").alias("n_outlinks"), F.lit(0).cast("bigint").alias("simhash"), F.array().cast("array<string>").alias("links"),
    )


def text_simhash(text: Column) -> Column:
    """SimHash of normalised text, as crawled pages have it."""
    return simhash64(normalized(text))
