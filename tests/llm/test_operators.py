"""Every operator against its plain version, over a whole test table and over hand-made hard rows."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loam.llm import decontaminate, language_id, line_dedup, packing, quality_rules, queries, secrets, simhash, substring_dedup, token_files, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, n_words string, row int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, ties, repeats, odd white space, and columns with names that operators use."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [None, "", " ", "\n", "\n\n \n", "a", "a  b   c ", " lead", "tab\tand\x0b\x0cform\r\nfeed", "   wide   x", "Ünïcode ŝtrange 語 文字 Ġ 🎈 İI", "x" * 5000, "<|endoftext|> a <|endoftext|>"]
    texts += [prose(8000), "word " * 3000, (prose(5) + "\n") * 200]
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(6)] + [passage, passage.upper()]
    texts += [base] * 30 + [base + " tail" * k for k in range(4)]
    texts += [f"{prose(9)}\n  Shared LINE here \t\n{prose(4)}" for _ in range(12)] + ["shared line HERE"]
    texts += [f'password = "{"aB3" * k}" token: secret:abcdefgh12 AKIA{"A1" * k} {"0af" * (3 * k)}é API_KEY=\'zz\' {prose(3)}' for k in range(1, 6)]
    texts += ["Qw8" * 9 + f" {k}" for k in range(3)] + [("ab12CD34ef56GH78ij90" + " ") * 2] * 5
    texts += ["benchmark item one has exactly these twelve words in a row okay done", "tiny item", "xx Tiny, ITEM! yy benchmark item one has exactly these twelve words in"]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else f"owner{i % 4}/r{i % 9}", None, "k", i, "w", 1) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[0], (None, "null id", "en", "s", 1, None, None, None, None), (None, base, "en", "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "Benchmark item one has exactly these twelve words in a row, okay"), (2, "tiny item"), (3, None), (4, "..."), (5, "item one has exactly these twelve words in a row and more of them"), (10, "tiny item"), (11, "item")], "item_id long, text string"
    )


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(found, wanted):
    assert found == sorted(wanted, key=repr)


@pytest.fixture(params=["hard", "table", "empty"])
def docs(request, hard, table):
    return {"hard": hard, "table": table, "empty": hard.limit(0)}[request.param]


def test_packing(docs):
    encode = brute.tokenizer(queries.tokenizer_path())
    out = packing.pack(docs, queries.tokenizer_path())
    same(rows(out, "doc_id", "piece", "start", "length", "ids_crc32"), brute.pieces(pairs(docs), encode))
    bins = {}
    for s, o, n in rows(out, "sequence_id", "offset", "length"):
        bins.setdefault(s, []).append((o, n))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    least = -(-sum(n for held in bins.values() for _, n in held) // 2048)
    assert len(bins) <= least * 1.02 + 1


def test_packing_keeps_ids_and_bounds_open_bins(hard):
    out = packing.pack(hard, queries.tokenizer_path(), size=64, with_ids=True, open_bins=2).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)


def test_merging_of_open_bins_over_many_partitions(spark):
    fills = spark.range(3000).select((F.col("id") * (1 << 32)).alias("bin"), (F.col("id") % 200 + 1).alias("fill"))
    out = packing.merge(fills, 2048).join(fills, "bin").groupBy("sequence_id").agg(F.sum("fill").alias("fill"), F.max(F.col("base") + F.col("fill")).alias("top")).collect()
    assert all(r.fill == r.top <= 2048 for r in out)
    assert sum(r.fill for r in out) == sum(i % 200 + 1 for i in range(3000))
    assert len(out) <= 1.1 * sum(r.fill for r in out) / 2048 + 2


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 8)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert fit.closed == [1]
    assert fit.place(9) == (3, 0)
    assert fit.closed == [1, 2]  # of 6 and 8 filled, the fuller one


@pytest.mark.parametrize(("bytes_", "keys"), [(line_dedup.MAX_FILTER_BYTES, line_dedup.KEYS_PER_SHARD), (0, 2)])
def test_line_dedup(docs, spark, bytes_, keys, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", keys)
    index = line_dedup.LineIndex(spark, 10, bytes_).insert(docs)
    assert len(index._broadcast()) == (1 if bytes_ else max(1, index.filters.count()))
    out = index.strip(docs)
    assert {"source", "lang"} <= set(out.columns)
    same(rows(out, "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)), brute.line_dedup(pairs(docs)))


def test_keys_that_a_filter_mistakes_are_spared(spark):
    from loam.llm import cuckoo

    docs = spark.createDataFrame([(i, "common\nown" if i == 0 else "common") for i in range(4)], "id long, text string")
    index = line_dedup.LineIndex(spark, 3).insert(docs)
    first, second = line_dedup._halves([line_dedup.line_key(x) for x in (b"common", b"own", b"never seen")])
    table = cuckoo.build(first.tolist(), second.tolist()).table
    index.filters = spark.createDataFrame([(0, bytearray(table.tobytes()))], "shard int, payload binary")
    kept = index.strip(spark.createDataFrame([(9, "never seen\nCommon\nown")], "id long, text string")).first()
    assert (kept.text, kept.n_lines, kept.n_dropped) == ("never seen\nown", 3, 1)


def test_line_dedup_can_be_undone(hard, spark):
    half = hard.where("doc_id % 2 = 0")
    rest = hard.where("not (doc_id % 2 = 0) or doc_id is null")
    both = line_dedup.LineIndex(spark, 5).insert(half).insert(rest)
    again = both.delete(rest)
    once = line_dedup.LineIndex(spark, 5).insert(half)
    assert rows(again.counts, "key", "n") == rows(once.counts, "key", "n")
    same(rows(again.strip(half), "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)), brute.line_dedup(pairs(half), 5))
    same(rows(both.strip(hard), "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)), brute.line_dedup(pairs(hard), 5))
    assert both.delete(hard).counts.count() == 0


def test_token_files(docs, spark, tmp_path):
    encode = brute.tokenizer(queries.tokenizer_path())
    one = docs.dropDuplicates(["doc_id"]).orderBy("doc_id").repartition(2)
    path = f"file://{tmp_path}/tokens"
    token_files.write(one, path, queries.tokenizer_path())
    out = token_files.read(spark, path)
    ordered = sorted(pairs(one), key=lambda r: (r[0] is not None, r[0] or 0))
    same(rows(out, "doc_id", "start", "n_tokens", "ids_crc32"), brute.token_starts(ordered, encode))
    texts = dict(ordered)
    assert all(r.ids == [*encode(texts[r.doc_id]), 2] for r in out.collect())


def test_vocabularies_that_cut_otherwise_are_left_alone():
    import public_tokenizers

    from loam.llm.tokens import Encoder

    texts = ["A text, of Words.\nAnd  more", None, "", "<|endoftext|>x", "Ünïcode 語"]
    for name, cuts in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        found, plain = Encoder(path), brute.tokenizer(path)
        assert found.cuts is cuts
        assert [list(memoryview(x).cast("I")) for x in found.encode(texts)] == [plain(t) for t in texts]


def test_token_blocks_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for ids in (np.zeros(1, np.uint32), np.arange(1000), rng.integers(0, 50257, 200_000), rng.integers(0, 2**32, 999), 1 << rng.integers(0, 32, 70_000), np.zeros(0)):
        ids = ids.astype(np.uint32)
        raw = [b.astype("<u4").tobytes() for b in np.array_split(ids, 7)]
        assert [x.astype("<u4").tobytes() for x in token_files.decode_chunk(token_files.encode_chunk(raw))] == raw


@pytest.mark.parametrize(("hot", "bytes_", "batches"), [(substring_dedup.HOT, substring_dedup.FILTER_BYTES, substring_dedup.BATCHES), (3, 8192, 5)])
def test_substring_dedup(docs, hot, bytes_, batches):
    out = substring_dedup.remove_repeats(docs, hot=hot, filter_bytes=bytes_, batches=batches)
    same(rows(out, "doc_id", "n_words", "n_removed", F.sha2("text", 256)), brute.substring_dedup(pairs(docs)))


def test_substring_dedup_in_batches(hard, spark):
    parts = [hard.where(f"coalesce(doc_id, 1) % 3 = {i}") for i in range(3)]
    index, before = substring_dedup.FingerprintIndex(spark, fan_in=2), None
    for part in parts:
        out = substring_dedup.remove_repeats(part, index=index, history=before)
        before = part if before is None else before.unionByName(part)
        mine = {(r[0], r[1]) for r in pairs(part)}
        wanted = [w for (d, t), w in zip(pairs(before), brute.substring_dedup(pairs(before)), strict=True) if (d, t) in mine]
        same(rows(out, "doc_id", "n_words", "n_removed", F.sha2("text", 256)), wanted)
        assert len(index.runs) == 1
    every = substring_dedup.fingerprints(hard.select(F.col("doc_id").alias("row"), "text"), substring_dedup.WIDTH, substring_dedup.GRAM).groupBy("fp").agg(F.sum("n").alias("n"))
    assert rows(index.table(), "fp", "n") == rows(every, "fp", "n")
    index.drop()


def test_history_is_joined_without_a_shuffle(hard, spark):
    prints = substring_dedup.fingerprints(hard.select(F.col("doc_id").alias("row"), "text"), substring_dedup.WIDTH, substring_dedup.GRAM)
    index = substring_dedup.FingerprintIndex(spark, fan_in=9)
    for _ in range(2):
        index.add(prints)
    a, b = (spark.table(r) for r in index.runs)
    plan = a.hint("merge").join(b.hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()
    assert not index.runs


def test_a_window_of_very_many_places_is_held_once(spark):
    copies = spark.range(400).select("id", F.lit(" ".join(f"w{i}" for i in range(60))).alias("text"))
    docs = copies.unionByName(spark.range(400, 800).select("id", F.concat(F.lit("x"), "id", F.lit(" "), F.lit(" ".join(f"w{i}" for i in range(36))), F.lit(" y"), "id").alias("text")))
    out = substring_dedup.remove_repeats(docs.repartition(16), id="id", hot=5)
    assert {(r.n_words, r.n_removed) for r in out.select("n_words", "n_removed").collect()} == {(60, 60), (38, 36)}


@pytest.mark.parametrize("most", [decontaminate.MAX_WORDS, 13])
def test_decontamination(docs, items, spark, sf, most):
    for held in (items, spark.read.parquet(f"{sf}/benchmark.parquet"), items.limit(0)):
        out = decontaminate.find_hits(docs, held, max_words=most if held is items else decontaminate.MAX_WORDS)
        found = rows(out, "doc_id", F.col("n_words").cast("long"), "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
        same(found, brute.decontamination(pairs(docs), [(r[0], r[1]) for r in held.collect()]))


def test_automata_of_repeated_words_are_linear(spark):
    import time

    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        found = decontaminate.SuffixAutomaton([("k", [b"a"] * n), ("s", [b"a", b"b"])], 10)
        spans, keys = found.scan([b"a"] * n + [b"c"] + [b"a"] * 9 + [b"b"])
        took.append(time.process_time() - began)
        assert (spans, keys) == ([(0, n), (n + 9, n + 11)], {"k", "s"})
    assert took[1] < 4 * took[0] + 0.5


def test_decontaminated_texts(spark, sf):
    got = {r.doc_id: r for r in queries.decontaminated_texts(spark, sf).collect()}
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    wanted = brute.decontaminated(docs, items, queries.MAX_SPAN, queries.MAX_COVERAGE)
    assert {k: r.kept_sha256 for k, r in got.items()} == wanted
    assert any(wanted[k] != brute.sha(dict(docs)[k] or "") for k in wanted)
    strict = decontaminate.decontaminate(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")), max_span=9, max_coverage=0.02)
    wanted = brute.decontaminated(docs, items, 9, 0.02)
    assert {r[0]: r[1] for r in strict.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()} == wanted
    assert 0 < len(wanted) < len(docs)


def test_decontamination_cuts_spans_or_drops_documents(spark, items):
    docs = spark.createDataFrame([(1, "Before it. A Tiny -- Item; after"), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items.where("item_id = 2")).orderBy("doc_id").collect()] == [2, 3]
    cut = decontaminate.decontaminate(docs, items.where("item_id = 2"), max_coverage=1.0).orderBy("doc_id").collect()
    assert [r.text for r in cut] == ["Before it. A ; after", "clean text", None]


def test_secrets(docs):
    out = secrets.digests(secrets.find_secrets(docs))
    same(rows(out, "doc_id", F.col("n_assign").cast("int"), F.col("n_access").cast("int"), F.col("n_hex").cast("int"), "base_sha256"), brute.secrets(pairs(docs)))


def test_secrets_tell_owned_from_copied(spark):
    token = "ab12CD34ef56GH78ij90"
    docs = spark.createDataFrame([(i, f"é see {token} here", f"owner{i}/x") for i in range(4)] + [(9, "é own Zz9" + "q" * 20, "a/b"), (10, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.spans, r.n_copied) for r in secrets.digests(secrets.find_secrets(docs)).collect()}
    assert got == {**{i: ("", 1) for i in range(4)}, 9: ("live:6:29", 0), 10: ("", 0)}


def test_quality_rules(docs):
    out = quality_rules.assess(docs)
    same(rows(out, "doc_id", F.col("n_words").cast("int"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality(pairs(docs)))
    assert out.where("base_failed and kept").count() == 0


def test_quality_rules_against_labels(spark, sf):
    spark_docs = quality_rules.assess(spark.read.parquet(f"{sf}/documents.parquet"))
    both = spark_docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good = both.where("quality = 1")
    assert good.where("not kept").count() == 0
    assert both.where("quality = 0 and kept").count() <= 0.1 * both.where("quality = 0").count()


@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_simhash(docs, cell):
    got = simhash.cluster(docs, cell=cell).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0"), "component_id")
    prints = [(d, brute.fingerprint(t)) for d, t in pairs(docs)]
    same(rows(got, *got.columns), [(d, f"{f:016x}", c) for d, f, c in brute.clusters(prints)])


@pytest.mark.parametrize("cell", [simhash.CELL, 50])
def test_trie_join_against_all_pairs(spark, cell):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) << rng.randrange(64) for b in base for _ in range(12)} | {rng.getrandbits(20) << 44 for _ in range(300)} | {rng.getrandbits(12) for _ in range(200)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    from loam.llm.common import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "simhash long").repartition(5), 2, cell)).collect()}
    sign = dict(zip(prints, (s for (s,) in signed), strict=True))
    wanted = brute.clusters([(sign[p], p) for p in prints])
    assert {s: got.get(s, s) for (s,) in signed} == {d: c for d, _, c in wanted}


def test_links_of_earlier_pairs_outlast_later_ones(spark):
    import numpy as np

    from loam.llm.common import components

    m = 0xC << 60
    far, p = m | 1 << 50 | 1 << 30, m ^ 1 << 63
    q = far ^ 1 << 62
    prints = [m, far, p, p | 1 << 25, q, q | 1 << 25]  # one component, whose pairs the trie gives in two parts
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "simhash long"))).collect()}
    assert {got.get(s, s) for (s,) in signed} == {min(s for (s,) in signed)}
    rng = np.random.default_rng(0)
    for _ in range(500):
        i, j = rng.integers(0, 12, (2, 10))
        wanted = list(range(12))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            wanted = [min(wanted[a], wanted[b]) if w in (wanted[a], wanted[b]) else w for w in wanted]
        assert simhash._forest(12, iter([(i[:5], j[:5]), (i[5:], j[5:])])).tolist() == wanted


def accuracy(spark, out, sf, column, wanted, held):
    both = out.where(held).join(spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").select("doc_id", "lang", "toxic"), "doc_id")
    both = both.where(F.col(wanted).isNotNull())
    return both.where(F.col(column) == F.col(wanted)).count() / max(1, both.count())


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op3_language_id(spark, sf)
    assert accuracy(spark, out, sf, "lang_pred", "lang", "held_out") > 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_id_hard_rows(spark, hard):
    scorer = language_id.train(hard)
    out = language_id.identify(hard, scorer)
    assert out.count() == hard.count()
    lettered = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    assert out.where(lettered == (F.col("lang_pred") == "und")).count() == 0
    none = language_id.identify(hard, language_id.train(hard.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(hard.limit(0), scorer).count() == 0


SCRIPTS = ["नमस्ते दुनिया यह हिन्दी है", "สวัสดีชาวโลก", "e\u0301te\u0301 n\u0303", "ÀÉ ß ſ", "一二三 四五"]


def test_language_id_against_dictionaries(spark, table):
    known = [(r.text, r.lang) for r in table.where("doc_id < 60 and lang is not null").collect()] + [(t, "xx") for t in SCRIPTS] + [(None, "xx"), ("", "xx")]
    docs = [(i, t) for i, t in enumerate([r.text for r in table.where("doc_id between 60 and 90").collect()] + SCRIPTS + [None, "", "123", "\u0301", "zzz qqq", "a" * 3000])]
    scorer = language_id.train(spark.createDataFrame(known, "text string, lang string").repartition(3))
    model = brute.KneserNey(known, language_id.ORDER)
    for found in (scorer, language_id.Scorer(scorer.counts, max_grams=scorer.counts.count() // 3)):
        got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(docs, "doc_id long, text string"), found).collect()}
        assert len(got) == len(docs)
        for i, t in docs:
            lang, score, loss = brute.language(model, t)
            assert got[i].lang_pred == lang
            assert (got[i].score, got[i].cross_entropy) == (pytest.approx(score, rel=1e-3, abs=1e-6), loss if loss is None else pytest.approx(loss, rel=1e-5))
    assert found.shards > 1


def test_toxicity_against_dictionaries(spark, table):
    known = [(r.text, "1" if r.doc_id % 3 == 0 else "0") for r in table.where("doc_id < 60").collect()] + [(None, "0"), ("", "1"), ("rare words", "1")]
    docs = [(i, t) for i, t in enumerate([r.text for r in table.where("doc_id between 60 and 90").collect()] + SCRIPTS + [None, "", "123", "rare", "x" * 3000])]
    from loam.llm import kneser_ney as kn
    from loam.llm.common import materialize

    counts = materialize(kn.gram_counts(spark.createDataFrame(known, "text string, label string").repartition(3), "text", "label", toxicity.ORDER))
    model = brute.KneserNey(known, toxicity.ORDER, toxicity.SHARED_BELOW)
    for most in (10**9, counts.count() // 3):
        scorer = language_id.Scorer(counts, toxicity.ORDER, most, toxicity.SHARED_BELOW)
        got = {r.doc_id: r.margin for r in toxicity.margins(spark.createDataFrame(docs, "doc_id long, text string"), scorer, "text").collect()}
        assert got == {i: pytest.approx(brute.margin(model, t), rel=1e-4, abs=1e-5) for i, t in docs}
    assert scorer.shards > 1


def test_shards_of_a_large_model_are_the_one_model(spark, table):
    scorer = language_id.train(table.where("doc_id < 40"))
    counts, docs = scorer.counts, table.where("doc_id between 40 and 99").select("doc_id", "text")
    for most in (counts.count() // 2, counts.count() // 9):
        parts = language_id.Scorer(counts, max_grams=most)
        assert scorer.shards == 1 < parts.shards <= 2 * counts.count() / most + 1
        assert [x.tolist() for x in parts.stats()] == [pytest.approx(x.tolist(), rel=1e-6) for x in scorer.stats()]
        a, b = ({r.doc_id: r for r in language_id.identify(docs, s).collect()} for s in (scorer, parts))
        assert a and a.keys() == b.keys()
        for k in a:
            assert (a[k].lang_pred, a[k].rejected) == (b[k].lang_pred, b[k].rejected)
            assert (a[k].score, a[k].cross_entropy) == pytest.approx((b[k].score, b[k].cross_entropy), rel=1e-6)
    # Where no two characters deal a model finely enough, three do.
    finer = language_id.Scorer(counts, max_grams=400)
    assert finer.depth > 2 and finer.shards > 10


def test_probabilities_sum_to_one():
    import numpy as np

    from loam.llm import kneser_ney as kn

    texts = ["banana band abandon", "cabana bandana", "nab a cab"]
    grams, n = np.unique(kn.stream(texts, 4).codes, return_counts=True)
    model = kn.build({"a": (grams, n), "b": (grams[::2], n[::2])}, 4)
    alphabet = np.unique(grams & ((1 << 15) - 1))
    for context in np.unique(grams >> 15):
        p = np.exp(model.score((context << 15) | alphabet).astype(float)).sum(0)
        unseen = np.exp(model.score(np.array([(context << 15) | 5])).astype(float))[0]
        assert np.allclose(p + unseen, 1, atol=1e-4)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"  # some of its labels say toxic where nothing in the text does
    out = queries.op10_toxicity(spark, sf).cache()
    assert accuracy(spark, out, sf, "predicted", "toxic", "held_out") > 0.9
    words = "(?i)\\b(worthless|scum|moron|disgusting|stupid|loser|pathetic|idiot|trash|clown)\\b"
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").rlike(words).alias("has")), "doc_id")
    assert held.where("has and predicted = 0").count() <= 0.1 * held.where("has").count()
    assert held.where("not has and predicted = 1").count() <= 0.01 * held.count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_labels_meet_documents_with_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a", 7, "q"), (1, "a", 7, "q"), (2, "b", 7, "q"), (None, "c", 7, "q")], "doc_id long, text string, TOXIC int, quality string")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert rows(toxicity.labelled(docs, labels), "doc_id", "text", "toxic", "quality") == [(1, "a", 1, 0)] * 2


def test_scored_columns_of_the_same_name_are_replaced(spark, hard):
    docs = hard.withColumns({"Score": F.lit("x"), "MARGIN": F.lit(None), "lang_pred": F.lit(9)})
    scorer = language_id.train(hard)
    assert language_id.identify(docs, scorer).where("score between 0 and 1").count() == hard.count()
    model = toxicity.train(hard.withColumn("toxic", F.when(F.col("text").contains("abcde"), 1).otherwise(0)))
    assert model.score(docs).where("score between 0 and 1 and margin >= 0").count() == hard.count()


def test_toxicity_hard_rows(spark, hard):
    labelled = hard.withColumn("toxic", F.when(F.col("text").contains("abcde"), 1).when(F.col("doc_id") % 5 == 0, None).otherwise(0))
    model = toxicity.train(labelled)
    assert model.score(hard).where("score between 0 and 1").count() == hard.count()
    assert toxicity.train(labelled.where("toxic = 0")).score(hard).where("score > 0").count() == 0
    assert model.score(hard.limit(0)).count() == 0
    assert toxicity.train(labelled.limit(0)).score(hard).where("score = 0").count() == hard.count()
