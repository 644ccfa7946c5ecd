"""Every registered query of the engine runs, and equals its SQL where it has some."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from loam.operators import queryspec, search
from loam.plans import catalog, corpora

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, sf, duck, name):
    out = catalog.queries()[name](spark, sf)
    found = canonical(out.columns, out.collect())
    assert found[1] or name in ("nav_lane", "hamming_join", "prune_age")
    if name in catalog.oracle_sql():
        cursor = duck.execute(catalog.oracle_sql()[name])
        assert found == canonical([d[0] for d in cursor.description], cursor.fetchall())


def test_site_only_equals_its_sql_on_larger_sites(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, 'some words ' || i AS text, 'en' AS lang, 'src' || (4 + i % 2) AS source, 12 AS n_chars FROM range(700) r(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    found = [r.doc_id for r in catalog.queries()["site_only"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(r[0] for r in con.execute(catalog.oracle_sql()["site_only"]).fetchall()) and len(found) == 200
    whole = search.candidates(corpora.loaded_index(spark, str(tmp_path)), queryspec.parse("site:src4.test"), 20)
    assert whole.count() == 350  # the operator leaves none out


def test_entry_imports_and_flagship_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
