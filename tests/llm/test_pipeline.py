"""The pipeline's stages, each judged on its own input, against plain versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
from loam.llm.common import materialize
from loam.llm.queries import tokenizer_path
from loam.llm.quality_rules import STOP_WORDS

from . import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected_quality(docs):
    kept = []
    for r, measured in zip(docs, brute.quality([(r.doc_id, r.text) for r in docs]), strict=True):
        _, n, chars, symbols, again, _, failed = measured
        lines = sum(1 for x in (r.text or "").split("\n") if brute.words(x))
        stop = sum(w.translate(brute.LOWER) in STOP_WORDS for w in brute.words(r.text))
        if not failed and 2 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.02 and again / max(lines, 1) <= 0.6:
            kept.append(r)
    return kept


def expected_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(brute.LOWER)
    held = Counter(k for r in docs for k in {key(x) for x in (r.text or "").split("\n")})
    out = []
    for r in docs:
        text = "\n".join(x for x in (r.text or "").split("\n") if not key(x) or held[key(x)] < 10)
        out.append(type(r)(**{**r.asDict(), "text": text, "n_chars": len(text)}))
    return out


def expected_single(docs):
    """One document of each component: the smallest id, ids before none; of equal ids any one text."""
    classes = brute.clusters([(i, brute.fingerprint(r.text)) for i, r in enumerate(docs)])
    groups = {}
    for r, (_, _, c) in zip(docs, classes, strict=True):
        groups.setdefault(c, []).append(r)
    least = lambda rs: min((r.doc_id is None, r.doc_id or 0) for r in rs)
    return [{r.text for r in rs if (r.doc_id is None, r.doc_id or 0) == least(rs)} for rs in groups.values()], [least(rs) for rs in groups.values()]


def expected_clean(docs, items):
    bad = brute.decontamination([(i, r.text) for i, r in enumerate(docs)], items)
    return [r for r, b in zip(docs, bad, strict=True) if not b[-1]]


def packed_well(rows):
    """Sequences are gapless and hold 2048 tokens at most."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "x", 0)], docs.schema))
    stages = dict(cp.STAGES)

    good = materialize(stages["quality rules"](spark, docs, sf))
    assert rows(good) == sorted((tuple(r) for r in expected_quality(docs.collect())), key=repr)

    stripped = materialize(stages["line dedup"](spark, good, sf))
    wanted = Counter((d, h) for d, _, _, h in brute.line_dedup([(r.doc_id, r.text) for r in good.collect()]))
    assert Counter((r.doc_id, brute.sha(r.text)) for r in stripped.collect()) == wanted
    assert all(len(r.text) == r.n_chars for r in stripped.collect()) and stripped.columns == docs.columns

    single = materialize(stages["SimHash near-dedup"](spark, stripped, sf))
    texts, ids = expected_single(stripped.collect())
    kept = single.collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == Counter(ids)
    assert all(any(r.text in t for t in texts) for r in kept)
    assert single.columns == docs.columns

    clean = materialize(stages["benchmark decontamination"](spark, single, sf))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(clean) == sorted((tuple(r) for r in expected_clean(kept, items)), key=repr)

    packed = stages["best-fit packing"](spark, clean, sf)
    pieces = brute.pieces([(r.doc_id, r.text) for r in clean.collect()], brute.tokenizer(tokenizer_path()))
    assert rows(packed.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(pieces, key=repr)
    packed_well(packed.collect())


def test_run_is_all_stages_in_a_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()  # of distinct ids, so that what is kept is told
    stripped = expected_lines(expected_quality(docs))
    _, ids = expected_single(stripped)
    single = [r for r in stripped if (False, r.doc_id) in set(ids)]
    clean = expected_clean(single, [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert 0 < len(clean) < len(single) < len(stripped) < len(docs)
    out = cp.run(spark, sf)
    pieces = brute.pieces([(r.doc_id, r.text) for r in clean], brute.tokenizer(tokenizer_path()))
    assert rows(out.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(pieces, key=repr)
    packed_well(out.collect())


def test_an_empty_table(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_documents_without_ids_or_with_one_id_are_kept_apart(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    words = lambda k: " ".join(f"{k}{i}" for i in range(80))
    row = lambda i, t: (i, t, "en", "s", len(t))
    kept = lambda given: sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, spark.createDataFrame(given, schema).repartition(3), sf).collect()), key=repr)
    nulls = [row(None, words(k)) for k in "abc"]
    assert kept(nulls + nulls[:1]) == sorted(((None, r[1]) for r in nulls), key=repr)
    shared = [row(3, words("a")), row(5, words("a")), row(5, words("b")), row(5, words("b"))]
    assert kept(shared) == [(3, words("a")), (5, words("b"))]
    assert kept([row(None, words("a")), row(9, words("a")), row(None, words("z"))]) == [(9, words("a")), (None, words("z"))]
    assert kept([row(4, ""), row(5, "   "), (6, None, "en", "s", 0)]) == [(4, "")]
