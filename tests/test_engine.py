"""The query language, search, the crawl, maintenance, streams and the facade, end to end on small tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loam.api import BadRequest, Service
from loam.operators import crawl, dedup, index, maintain, queryspec, search
from loam.plans import catalog, corpora
from loam.sources import sinks
from loam.streaming import crawl_stream

NOW = 1_735_689_600
SCHEMA = "doc_id long, url string, host string, title string, body string, description string, kind string, fetched_at long, authority double"


def docs(spark, *rows):
    full = [(i, u, u.split("/")[2], t, b, "", k, NOW, 0.0) for i, (u, t, b, k) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def urls_of(idx, q, **more):
    return [r.url for r in search.search(idx, q, now=NOW, **more).collect()]


def test_query_operators():
    s = queryspec.parse('rust site:"Docs.rs" -site:bad.com intitle:guide -intitle:old inurl:API -inurl:V1 before:2024 after:2023-02 "exact phrase" before:soon')
    assert (s.sites, s.not_sites, s.inurl) == (["docs.rs"], ["bad.com"], ["api", "v1"])
    assert s.text == 'rust title:guide -title:old "exact phrase" before:soon'
    assert (s.before, s.after) == (1735689599, 1675209600)
    assert queryspec.parse_epoch("2024-02-30", False) is None and queryspec.parse_epoch("1969", False) is None and queryspec.parse_epoch("2024-02", True) == 1709251199
    assert queryspec.strip_unknown_fields("define:word title:x -cache:u a:b:c") == "word title:x -u b:c"
    assert queryspec.sanitize('(a+b) "c d" e_f-g') == "ab cd e_f-g"
    assert queryspec.tokens_of('a "b c" d"e f') == ["a", '"b c"', 'd"e f']
    assert queryspec.navigational("a rust") == "rust" and queryspec.navigational("rust lang") is None
    assert queryspec.is_newsy("scoreboard") and not queryspec.is_newsy("rust")


def test_all_terms_are_needed_and_tiers_relax(spark):
    idx = index.build(docs(spark, ("https://a.test/1", "Rust book", "memory safety guide", "page"), ("https://b.test/1", "Cooking", "rust removal guide", "page"), ("https://c.test/1", "Memory", "lane", "page")))
    assert urls_of(idx, "rust memory safety") == ["https://a.test/1"]
    assert set(urls_of(idx, "rust memory removal")) == {"https://a.test/1", "https://b.test/1"}  # two of three
    assert urls_of(idx, "lane zebra") == ["https://c.test/1"]  # the rarest known word
    assert urls_of(idx, '"rust removal"') == ["https://b.test/1"] and urls_of(idx, "guide -removal") == ["https://a.test/1"]
    assert urls_of(idx, "title:memory") == ["https://c.test/1"] and urls_of(idx, "-rust") == []


def test_site_operators_caps_and_kinds(spark):
    rows = [(f"https://wiki.test/{i}", f"Wiki {i}", "shared words here", "page") for i in range(5)] + [("https://other.test/a", "Other page", "shared words here", "page"), ("https://other.test/f", "Feed item", "shared words here", "rss")]
    idx = index.build(docs(spark, *rows))
    assert sum("wiki.test" in u for u in urls_of(idx, "shared")) == 3
    assert len(urls_of(idx, "shared site:wiki.test")) == 5 and len(urls_of(idx, "site:wiki.test")) == 5
    assert not any("wiki.test" in u for u in urls_of(idx, "shared -site:wiki.test"))
    assert urls_of(idx, "shared", kind="RSS") == ["https://other.test/f"]
    assert len(urls_of(idx, "unknown:shared")) == 5
    assert urls_of(idx, "shared", limit=2, offset=2) == urls_of(idx, "shared", limit=4)[2:4]
    assert set(urls_of(idx, "shared", prefilter=True)) == set(urls_of(idx, "shared"))


def test_titles_are_deduped_and_reference_hosts_lead(spark):
    idx = index.build(docs(spark, ("https://random.test/x", "Firefox browser", "firefox browser text", "page"), ("https://en.wikipedia.org/wiki/Firefox", "Firefox Browser!", "firefox browser text", "page"), ("https://z.test/x", "Something else", "firefox browser text", "page")))
    assert len(urls_of(idx, "firefox")) == 2
    two = index.build(docs(spark, ("https://random.test/x", "Firefox one", "firefox browser text", "page"), ("https://en.wikipedia.org/wiki/Fx", "Firefox two", "firefox browser text", "page")))
    assert urls_of(two, "browser")[0].startswith("https://en.wikipedia.org")


def test_navigation_and_snippets_and_suggestions(spark):
    idx = index.build(docs(spark, ("https://github.com/a", "Code host", "where code lives " * 40 + "needle in it " + "tail " * 60, "page"), ("https://blog.test/github", "About github", "github github github", "page")))
    assert urls_of(idx, "github")[0] == "https://github.com/a"
    assert "needle" in search.search(idx, "needle", now=NOW).first().snippet
    assert search.suggest(idx, "neadle") == "needle" and search.suggest(idx, "needle") is None and search.suggest(idx, "zzzzzz") is None


def test_snippets_of_whole_tables(spark, sf, tmp_path):
    def plain(body, title):
        low = body.lower()
        first = low.find("the")
        if first < 0 or "the" in low[:240]:
            return title if first < 0 else body[:240]
        start = max(0, first - 100)
        return body[start : low.rfind("the", 0, start + 103) + 123]

    bodies = ["x" * 239 + "the end", "y " * 5000 + "tHe last", "z\n" * 300 + "the one" + " q" * 90 + " the other", "the " * 90, "none", "é語 " * 200 + "the the the " + "w" * 300]
    hard = spark.createDataFrame([(i, b, "s") for i, b in enumerate(bodies)], "doc_id long, text string, source string")
    hard.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), sf):
        wanted = {r.doc_id: plain(r.body, r.title) for r in corpora.corpus(spark, folder).collect()}
        got = catalog.queries()["snippet"](spark, folder).collect()
        assert len(got) == len(wanted) and {r.doc_id: r.snippet for r in got} == wanted


def test_index_tables_round_trip(spark, tmp_path):
    idx = index.build(docs(spark, ("https://a.test/1", "Rust book", "memory safety guide", "page")))
    idx.save(f"file://{tmp_path}/index")
    assert urls_of(index.Index.load(spark, f"file://{tmp_path}/index"), "memory") == ["https://a.test/1"]


def test_saves_are_versions_that_readers_see_whole(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        index.Index.load(spark, path)
    one = index.build(docs(spark, ("https://a.test/1", "Rust book", "memory safety guide", "page")))
    one.save(path)
    reader = index.Index.load(spark, path)
    new = docs(spark, ("https://b.test/1", "Other", "memory lane", "page"), ("https://a.test/1", "Rust again", "no such word", "page")).withColumn("doc_id", F.col("doc_id") + 10)
    index.Index.load(spark, path).upsert(new).save(path)
    assert urls_of(reader, "safety") == ["https://a.test/1"]
    index.Index.load(spark, path).upsert(new).save(path)
    now = index.Index.load(spark, path)
    assert urls_of(now, "memory") == ["https://b.test/1"] and urls_of(now, "again") == ["https://a.test/1"] and now.docs.count() == 2
    fresh = index.build(now.docs)
    for a, b in ((now.term_stats, fresh.term_stats), (now.field_stats, fresh.field_stats), (now.postings, fresh.postings)):
        assert sorted(map(repr, (tuple(r) for r in a.select(*b.columns).collect()))) == sorted(map(repr, (tuple(r) for r in b.collect())))
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("v-")]) == 2
    gone = now.delete(new.where("startswith(url, 'https://b')").select("url"))
    assert urls_of(gone, "lane") == [] and gone.has(new).count() == 1
    table = maintain.save_docs(one.docs, f"file://{tmp_path}/docs")
    assert maintain.compact(spark, f"file://{tmp_path}/docs", 1).count() == table.count() == maintain.load_docs(spark, f"file://{tmp_path}/docs").count()


def test_a_query_reads_its_own_terms(spark, tmp_path):
    index.build(docs(spark, ("https://a.test/1", "Rust book", "memory safety guide", "page"))).save(f"file://{tmp_path}/index")
    idx = index.Index.load(spark, f"file://{tmp_path}/index")
    plan = search.retrieve(idx, queryspec.clauses("memory safety"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [In(term, [memory,safety])") == 2
    assert "lengths" not in plan and plan.count("Exchange hashpartitioning") == 1  # only what is found is put together, by document
    plan = search.suggestions(idx, ["memroy", "gudie"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,me)" in plan and "StringStartsWith(term,gu)" in plan

def test_equal_documents_rank_by_id_however_their_postings_come(spark):
    other = [(f"https://b.test/{i}", " ".join(["beta", "gamma", "delta"][: i % 3 + 1]), "alpha beta " * i + "gamma", "page") for i in range(1, 9)]
    same = [(f"https://a.test/{i}", "alpha beta gamma delta", "beta alpha beta gamma beta gamma delta and more of it", "page") for i in range(60)]
    idx = index.build(docs(spark, *same, *other))
    rows = idx.postings.collect()
    random.Random(3).shuffle(rows)
    mixed = index.Index(idx.docs, spark.createDataFrame(rows, idx.postings.schema).coalesce(1), idx.lengths, idx.term_stats, idx.field_stats)
    for q in ("alpha beta gamma delta", '"alpha beta gamma delta" alpha beta gamma delta'):
        found = search.candidates(mixed, queryspec.parse(q), 20).join(idx.docs, "doc_id").where("host = 'a.test'").orderBy("rank").collect()
        assert len(found) == 60 and len({r.bm25 for r in found}) == 1
        assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)


def test_diversify_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    for n, limit in ((5, 4), (30, 10), (40, 20), (9, 8)):
        hits = [(i, 100.0 - i // 2, f"s{rng.randint(0, 2)}.test", f"title{rng.randint(0, 2)}xx") for i in range(n)]
        front_cap = max(limit // 2, 4)
        each, used, front, rest = max((front_cap + 1) // 3, 2), {}, [], []
        for h in hits:
            key = h[2:]
            if n > 6 and len(front) < front_cap and used.get(key, 0) < each:
                used[key] = used.get(key, 0) + 1
                front.append(h[0])
            else:
                rest.append(h[0])
        got = search.diversify(spark.createDataFrame(hits, "rank int, score double, host string, title string"), "query", limit)
        assert [r["rank"] for r in got.orderBy("place").collect()] == (front + rest)[:limit]


def test_greedy_near_duplicates_equal_the_sequential_walk(spark):
    rng = random.Random(2)
    for seed in range(3):
        hashes = [rng.getrandbits(64)]
        for _ in range(60):
            h = rng.choice(hashes)
            for _ in range(rng.choice([0, 1, 2, 2])):
                h ^= 1 << rng.randrange(64)
            hashes.append(h)
        kept: list[tuple[int, int]] = []
        for i, h in enumerate(hashes):
            if all((h ^ k).bit_count() > 3 for _, k in kept):
                kept.append((i, h))
        rows = spark.createDataFrame([(i, h - ((h >> 63) << 64)) for i, h in enumerate(hashes)], "id long, simhash long")
        assert sorted(r.id for r in dedup.greedy_kept(rows).collect()) == [i for i, _ in kept], seed


def test_banding_grows_with_the_table():
    assert dedup.banding(1000, 3) == (4, 1) and dedup.banding(10**6, 3) == (4, 1)
    assert dedup.banding(10**8, 3) == (5, 2) and dedup.banding(10**10, 3) == (6, 3)


def test_pairs_of_whole_hashes(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate("abcab") for _ in range(1 + (i == 4))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["simhash_md5_pairs"](spark, str(tmp_path)).collect())
    assert got == [(0, 3), (1, 4), (1, 4)]
    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(40)]
    hashes = sorted({b ^ sum(1 << k for k in rng.sample(range(60), n)) for b in base for n in range(5)} | {b ^ 0xFFFF << 44 for b in base})
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, simhash long")
    wanted = {(i, j) for j in range(len(hashes)) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= 3}
    assert wanted and {(r.a, r.b) for r in dedup.hamming_pairs(rows, 3, 60).collect()} == wanted


@pytest.mark.parametrize("keep", [1, 2, 3])
def test_hamming_pairs_equal_brute_force(spark, keep, monkeypatch):
    monkeypatch.setattr(dedup, "banding", lambda n, most, bits=64: (most + keep, keep))
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = sorted({b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base for _ in range(6)})
    got = {(r.a, r.b) for r in dedup.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, simhash long")).collect()}
    assert got == {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 3}


def test_running_authority_across_blocks(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 50), f"h{rng.randint(0, 2)}") for _ in range(200)]
    pages = [(i, f"h{i % 3}") for i in range(51)]
    got = crawl.running_authority(spark.createDataFrame(pages, "seq long, host string"), spark.createDataFrame(links, "seq long, host string"), 7)
    assert {(r.seq, r.host): r.inlinks for r in got.collect()} == {(s, h): sum(x <= s and y == h for x, y in links) for s, h in pages}


def page(title, words, links=""):
    return f"<html><head><title>{title}</title></head><body><p>{words}</p>{links}</body></html>"


def test_documents_pass_the_gates_once(spark):
    prose = "the cat sat on the mat and it was a good day for all of the people in the town with a view of the sea " * 4
    other = "a storm came to the coast and the boats were in the harbour for days as it is with the weather at this time of year " * 4
    pages = spark.createDataFrame(
        [
            (1, "https://a.test/one", page("One", prose, '<a href="https://b.test/x"></a><a href="https://a.test/two?utm_source=1"></a>')),
            (2, "https://c.test/copy", page("One", prose)),
            (3, "https://b.test/x", page("Storm", other)),
            (4, "https://a.test/tag/list/1", page("Hub", other + "hub")),
            (5, "https://a.test/thin", page("Thin", "too short")),
            (6, "https://a.test/wall", page("Just a moment...", other + " more words in here")),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in crawl.documents(pages).collect()}
    assert set(got) == {1, 3} and got[3].inlinks == 1 and got[1].n_outlinks == 2 and got[1].inlinks == 1
    capped = crawl.documents(pages, crawl.CrawlConfig(pages_per_site=0))
    assert capped.count() == 0


def test_canonical_urls_are_those_of_documents(spark):
    prose = lambda k: " ".join(f"{k}{i} is the {k}{i * i}" for i in range(40))
    said = lambda k, to: f'<html><head><title>{k}</title><link rel="canonical" href="{to}"></head><body><p>{prose(k)}</p></body></html>'
    pages = [
        (1, "https://a.test/one?x=1", said("one", "HTTPS://A.test:443/one?utm_source=q")),  # written otherwise, the same URL
        (2, "https://a.test/one?x=2", said("two", "/one")),  # there is one already
        (3, "https://a.test/one", said("three", "/one")),  # the very URL replaces it
        (4, "https://b.test/p", said("four", "https://a.test/one")),  # of another host
        (5, "https://c.test/p?v=2", said("five", "/p")),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.url: r.page_id for r in crawl.documents(frame).collect()}
    assert got == {"https://a.test/one": 3, "https://b.test/p": 4, "https://c.test/p": 5}
    known = spark.createDataFrame([("https://c.test/p", 1), ("https://a.test/one", 2)], "url string, simhash long")
    got = {r.url: r.page_id for r in crawl.documents(frame, known=known).collect()}
    assert got == {"https://a.test/one": 3, "https://b.test/p": 4}


def test_fates_and_links_to_follow(spark):
    own = "".join(f'<a href="/m{i}"></a>' for i in range(60))
    rows = [
        (1, "https://a.test/x", page("Maze", "the short of it is " + "letters " * 40, own + '<a href="https://away.test/1"></a>')),
        (2, "https://a.test/tag/list/1", page("Hub", "x", '<a href="/y"></a>')),
        (3, "https://a.test/none", '<meta name="robots" content="noindex"><a href="/y">y</a>'),
        (4, "https://a.test/thin", page("Thin", "x", '<a href="/y"></a>')),
    ]
    got = {r.page_id: (r.fate, r.follow) for r in crawl.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("tarpit", ["https://away.test/1"]), 2: ("hub", ["https://a.test/y"]), 3: ("noindex", []), 4: ("thin", [])}


def _site(spark, pages, **more):
    """What fetches of a small site give."""
    rows = [(u, more.get("status", {}).get(u, 200), h, "text/html", 10, None, None, "e", "") for u, h in pages.items()]
    return spark.createDataFrame(rows, "url string, status int, html string, content_type string, latency_ms int, retry_after int, error string, etag string, last_modified string")


def test_crawl_passes(spark):
    prose = lambda k: " ".join(f"{k}{i} is the {k}{i * i}" for i in range(40))
    link = lambda *us: "".join(f'<a href="{u}"></a>' for u in us)
    site = {
        "https://s.test/": page("Home", prose("home"), link("/a", "https://o.test/")),
        "https://s.test/a": page("A", prose("alpha")),
        "https://r.test/secret/x": page("X", prose("hidden")),
        "https://o.test/": page("O", prose("other")),
        "https://m.test/sitemap.xml": "<urlset><url><loc>https://m.test/b?from=map</loc></url></urlset>",
        "https://m.test/b?from=map": page("Map", prose("gamma")),
    }
    robots = spark.createDataFrame([("r.test", 200, "User-agent: *\nDisallow: /secret/"), ("s.test", 200, "Sitemap: https://s.test/map.xml")], "site string, status int, body string")
    blocked = spark.createDataFrame([("bad.test",)], "domain string")
    config, empty = crawl.CrawlConfig(jitter_ms=0), spark.createDataFrame([], "url_key long, seen_at long")
    state = crawl.new_state(spark, spark.createDataFrame([(u,) for u in ("https://s.test/", "https://r.test/secret/x", "https://bad.test/", "https://fail.test/")], "url string"), NOW, config)
    sitemap = crawl.seed(spark.createDataFrame([("https://m.test/map",)], "url string"), empty, NOW).withColumn("url", F.lit("https://m.test/sitemap.xml"))
    state.frontier = state.frontier.unionByName(sitemap.select(*state.frontier.columns))
    state = crawl.crawl_pass(state, _site(spark, site), blocked, NOW * 1000, robots, config)
    assert {r.url for r in state.docs.collect()} == {"https://s.test/"}
    assert {(r.url, r.attempts) for r in state.frontier.collect()} == {("https://s.test/a", 0), ("https://o.test/", 0), ("https://m.test/b?from=map", 0), ("https://s.test/map.xml", 0), ("https://fail.test/", 1)}
    state = crawl.crawl_pass(state, _site(spark, site), blocked, NOW * 1000 + 40_000, robots, config)
    # Of s.test one of its two URLs was leased.
    assert {r.url for r in state.docs.collect()} - {"https://s.test/a"} == {"https://s.test/", "https://o.test/", "https://m.test/b?from=map"} and state.frontier.where("site = 's.test'").count() == 1
    hosts = {r.site: r for r in state.host_state.collect()}
    assert hosts["fail.test"].failures == 2 and hosts["s.test"].failures == 0 and not any(r.in_flight for r in hosts.values())
    assert crawl.crawl_pass(state, _site(spark, site), blocked, NOW * 1000, robots, config, max_docs=1) is state


def test_refusals_and_penalties_reach_the_host_state(spark):
    pages = {"https://r.test/": "", "https://s.test/": ""}
    web = _site(spark, pages, status={"https://r.test/": 429, "https://s.test/": 403}).withColumn("retry_after", F.lit(90))
    config, none = crawl.CrawlConfig(jitter_ms=0), spark.createDataFrame([], "domain string")
    state = crawl.new_state(spark, spark.createDataFrame([(u,) for u in pages], "url string"), NOW, config)
    after = {r.site: r for r in crawl.crawl_pass(state, web, none, NOW * 1000, config=config).host_state.collect()}
    assert (after["r.test"].next_allowed_ms, after["r.test"].failures) == (NOW * 1000 + 90_000, 1)
    assert (after["s.test"].next_allowed_ms, after["s.test"].failures) == (NOW * 1000 + 4000, 1)


def test_the_priority_lane_comes_first(spark):
    rows = [(1, "a", 0, 1, False), (2, "b", 2, 9, True), (3, "c", 1, 5, True), (4, "c", 0, 1, False), (5, "d", 0, 0, False)]
    queue = spark.createDataFrame(rows, "url_key long, site string, depth int, enqueued_at long, priority boolean")
    state = spark.createDataFrame([("a", 50, 0, False), ("d", 9_999, 0, False)], "site string, next_allowed_ms long, banned_until long, in_flight boolean")
    assert [r.url_key for r in crawl.lease(queue, state, 100, 3).collect()] == [3, 2, 1]


def test_config_of_files_and_variables(tmp_path):
    (tmp_path / "c.toml").write_text("[crawl]\nmax_depth = 7\ndelay_factor = 1.5\nunknown = 1\n")
    got = crawl.load_config(str(tmp_path / "c.toml"), {"LOAM_MAX_OUTLINKS": "9", "LOAM_PAGES_PER_SITE": "many", "LOAM_MAX_DEPTH": "2"})
    assert (got.max_depth, got.delay_factor, got.max_outlinks, got.pages_per_site) == (2, 1.5, 9, 500)


def test_frontier(spark):
    seen = spark.createDataFrame([(None, NOW - 10)], "url_key long, seen_at long").limit(0)
    rows = crawl.seed(spark.createDataFrame([("https://a.test/1",), ("https://a.test/1#x",), ("https://a.test/x.pdf",)], "url string"), seen, NOW)
    assert [(r.url, r.site, r.depth) for r in rows.collect()] == [("https://a.test/1", "a.test", 0)]
    known = rows.select("url_key", F.lit(NOW - 10).cast("long").alias("seen_at"))
    one = spark.createDataFrame([("https://a.test/1",)], "url string")
    assert crawl.seed(one, known, NOW).count() == 0 and crawl.seed(one, known, NOW + 10**6).count() == 1 and crawl.seed(one, known, NOW, priority=True).count() == 1
    pages = spark.createDataFrame([(1, ["https://b.test/1", "https://b.test/1", "https://facebook.com/x", "https://a.test/1"], 2, 1.0, 5), (2, ["https://d.test/1"], 3, 1.0, 5)], "page_id long, links array<string>, depth int, score double, fetched_at long")
    from loam.sources.files import read_blocklist

    got = crawl.expand(pages, rows, seen, read_blocklist(spark)).collect()
    assert [(r.url, r.depth, round(r.score, 3)) for r in got] == [("https://b.test/1", 3, 0.9)]


def test_prune_and_export(spark):
    d = spark.createDataFrame([(i, f"https://a.test/{i}", "a.test", f"T{i}", "x" * 100, "", "page", NOW - i * 86_400, 0.0) for i in range(5)], SCHEMA)
    kept, dropped = maintain.prune(d, NOW, keep=2)
    assert (kept.count(), dropped.count()) == (2, 3) and {r.doc_id for r in kept.collect()} == {0, 1}
    kept, dropped = maintain.prune(d, NOW, max_bytes=250)
    assert kept.count() == 2 and dropped.count() == 3
    assert maintain.prune(d, NOW, days=2)[0].count() == 3
    lines = [r.value for r in maintain.to_json_array(d).collect()]
    assert lines[0] == "[" and lines[-1] == "]" and lines.count(",") == 4 and len(json.loads("".join(lines))) == 5
    lines = maintain.metrics({"docs": 5, "uptime_secs": 7}).splitlines()
    assert len(lines) == 11 and lines[0] == "loam_docs 5" and lines[-1] == "loam_uptime_secs 7" and "loam_io_errors 0" in lines


def test_push_batches(spark, tmp_path):
    d = docs(spark, *[(f"https://a.test/{i}", "T", "b", "page") for i in range(7)]).coalesce(1)
    target = str(tmp_path / "sent")

    def send(body, headers):
        with open(target, "a") as f:
            f.write(json.dumps([json.loads(body), headers]) + "\n")

    sinks.push_batches(d, send, 3, "secret")
    sent = [json.loads(x) for x in (tmp_path / "sent").read_text().splitlines()]
    assert [len(body["ops"]) for body, _ in sent] == [3, 3, 1] and all(h["X-Access-Token"] == "secret" for _, h in sent)


def test_service(spark):
    s = Service(spark, docs(spark, ("https://a.test/1", "Rust", "memory safety", "page")), NOW, token="t")
    assert s.search("memory")["hits"][0]["url"] == "https://a.test/1" and s.search("memroy")["did_you_mean"] == "memory"
    for bad in ("", " ", "x" * 513):
        with pytest.raises(BadRequest):
            s.search(bad)
    with pytest.raises(BadRequest):
        s.index_doc("http://192.168.1.1/x")
    s.index_doc("https://b.test/n", "New", "fresh memory")
    assert len(s.search("memory")["hits"]) == 2 and s.stats()["docs"] == 2 and "loam_docs 2" in s.metrics()
    assert s.authorized("Bearer t") and s.authorized("t") and not s.authorized("x") and not s.authorized(None)
    assert "<rss" in s.search_rss("memory") and s.health() == "ok"
    seen = spark.createDataFrame([], "url_key long, seen_at long")
    assert s.seed(["https://c.test/1"], seen) == 1
    feed = spark.createDataFrame([("<rss><channel><item><title>N</title><link>https://f.test/1</link><description>memory lane</description></item></channel></rss>",)], "body string")
    assert s.add_feed("https://f.test/feed", feed) == 1 and s.feeds == ["https://f.test/feed"] and s.search("lane")["hits"][0]["kind"] == "rss"
    for bad in ("http://[::1]/", "http://127.1/", "http://2130706433/"):
        with pytest.raises(BadRequest):
            s.index_doc(bad)
    s.index_doc("https://b.test/n", "New", "other words")
    assert [h["url"] for h in s.search("memory safety")["hits"]] == ["https://a.test/1"]
    v1 = s.search_v1("memory " + "x" * 600)
    assert set(v1) == {"hits", "did_you_mean", "took_ms"} and set(s.search_v1("memory")["hits"][0]) == {"url", "host", "title", "snippet", "kind", "score", "ts"}
    again = feed.select(F.lit("https://f.test/feed").alias("url"), F.replace("body", F.lit("lane"), F.lit("street")).alias("body"))
    assert s.refresh_feeds(again) == 1 and s.search("street")["hits"][0]["kind"] == "rss" and s.stats()["docs"] == 3
    assert s.accepts(b"x" * 9) and not s.accepts(b"x" * (s.body_limit + 1)) and "loam_queries_total 8" in s.metrics()


def test_stream_upsert_and_windows(spark, tmp_path):
    first = spark.createDataFrame([("u1", 1), ("u2", 1)], "url string, fetched_at long")
    second = spark.createDataFrame([("u1", 2), ("u3", 1)], "url string, fetched_at long")
    path = f"file://{tmp_path}/table"
    merge = crawl_stream.upsert_into(path)
    merge(first, 0)
    merge(second, 1)
    merge(second, 1)  # again, as after a failure
    merge(first.limit(0), 2)
    assert not (tmp_path / "table" / "v000000000").exists()
    assert sorted((r.url, r.fetched_at) for r in spark.read.parquet(f"{path}/v000000001").collect()) == [("u1", 2), ("u2", 1), ("u3", 1)]
    spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a") for m in (1, 2, 40)], "t string, k string").selectExpr("to_timestamp(t) t", "k").write.parquet(f"{tmp_path}/events_x/events.parquet")
    stream = crawl_stream.read_tables(spark, f"{tmp_path}/events_x", "part", "t timestamp, k string")
    out = crawl_stream.run_available(crawl_stream.counts(stream, "t", "30 minutes", ["k"]), "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_stream_politeness_backs_off(spark, tmp_path):
    rows = [("a", 1, 0, False, 100, 0), ("a", 2, 5000, False, 100, 0), ("a", 3, 20_000, True, 100, 0), ("b", 1, 0, True, 100, 5000)]
    spark.createDataFrame(rows, "site string, seq long, at_ms long, ok boolean, latency_ms long, robots_ms long").write.parquet(f"{tmp_path}/fetches")
    stream = crawl_stream.read_tables(spark, f"{tmp_path}/fetches", "part", "site string, seq long, at_ms long, ok boolean, latency_ms long, robots_ms long")
    out = crawl_stream.run_available(crawl_stream.politeness(stream))
    assert {(r.site, r.seq): (r.failures, r.next_allowed_ms) for r in out.collect()} == {("a", 1): (1, 4000), ("a", 2): (2, 13_000), ("a", 3): (0, 22_000), ("b", 1): (0, 5000)}


def test_commands(spark, tmp_path, capsys):
    from loam.__main__ import main

    data = f"file://{tmp_path}/data"
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"url": f"https://a.test/{i}", "host": "a.test", "title": f"Title {i}", "text": f"memory of number{i}", "fetched_at": NOW + i}) + "\n" for i in range(4)))

    def run(*args):
        assert main(["--data", data, *args], spark) == 0
        return capsys.readouterr().out.strip().splitlines()

    assert run("import", "-i", f"file://{tmp_path}/in.jsonl") == ["4"]
    assert [json.loads(x)["url"] for x in run("search", "number2")] == ["https://a.test/2"]
    assert json.loads(run("stats")[0])["docs"] == 4
    assert run("prune", "--keep-docs", "3") == ["1"] and run("search", "number0 memory") != run("search", "number0")
    assert run("compact") == ["3"] and run("reindex") == ["3"]
    assert run("export", "-o", f"file://{tmp_path}/out", "-f", "array") == ["3"]
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert lines.count("[") == lines.count("]") == 1 and sum(x.startswith("{") for x in lines) == 3
    (tmp_path / "p.html").write_text("<title>T</title><a href='/x'>y</a>")
    assert json.loads(run("fetch", "https://a.test/", "--html", str(tmp_path / "p.html"))[0])["links"] == ["https://a.test/x"]
    prose = " ".join(f"w{i} is the w{i * i}" for i in range(40))
    _site(spark, {"https://s.test/": page("Home", prose)}).write.parquet(f"file://{tmp_path}/web")
    assert run("crawl", "--web", f"file://{tmp_path}/web", "--seed", "https://s.test/", "--passes", "1") == ["4"]
    assert [json.loads(x)["url"] for x in run("search", "w3")] == ["https://s.test/"] and len(run("search", "memory")) == 3
