"""Text and page functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V
from .urls import alternation

ALNUM = r"\p{IsAlphabetic}\p{N}"
TOKEN = rf"[{ALNUM}]+"


def junk_title(title: Column) -> Column:
    """Titles of walls, failures and log-in forms."""
    t = F.lower(F.trim(title))
    return t.rlike(alternation(V.JUNK_PHRASES)) | t.isin(V.AUTH_TITLES)


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{ALNUM}]", ""))


def is_indexable(title: Column, text: Column, least: int | Column = 200) -> Column:
    """A good title and enough letters and digits."""
    return ~junk_title(title) & (alnum_count(text) >= least)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def display_title(title: Column, text: Column) -> Column:
    """The title if it is good, else the text's first eight words, else ``untitled``."""
    lead = F.array_join(F.slice(words(text), 1, 8), " ")
    return F.when((F.trim(title) != "") & ~junk_title(title), F.trim(title)).when(lead != "", lead).otherwise("untitled")


@F.pandas_udf(T.StringType())
def _clip(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    cut = lambda t, n: t if t is None or not n else t.encode()[: int(n)].decode(errors="ignore")
    return pd.Series([cut(t, n) for t, n in zip(texts, sizes, strict=True)], dtype=object)


def clip_text(text: Column, size: int = 16384) -> Column:
    """At most ``size`` bytes, whole characters; 0 for no limit.  Only longer texts go through Python."""
    if not size:
        return text
    short = F.octet_length(text) <= size
    return F.when(short, text).otherwise(_clip(F.when(~short, text), F.lit(size)))


def clipped(text: Column, size: int = 240) -> Column:
    return F.when(F.length(F.trim(text)) <= size, F.trim(text)).otherwise(F.concat(F.substring(F.trim(text), 1, size), F.lit("...")))


def is_link_maze(text: Column, n_links: Column) -> Column:
    return (n_links >= 48) & (F.octet_length(text) < 2000)


def babble_measures(text: Column) -> Column:
    """(n, common, kinds): tokens, function words among them, and distinct tokens, with A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.regexp_extract_all(low, F.lit(f"({TOKEN})"))
    of = lambda t: F.struct(F.size(t).alias("n"), F.size(F.filter(t, lambda w: w.isin(V.FUNCTION_WORDS))).alias("common"), F.size(F.array_distinct(t)).alias("kinds"))
    return F.element_at(F.transform(F.array(tokens), of), 1)


def is_babble(text: Column) -> Column:
    """Long texts with hardly any English function words, or hardly any repeated word."""
    def test(m: Column) -> Column:
        return (m["n"] >= 60) & ((m["common"] / m["n"] < 0.12) | (m["kinds"] / m["n"] > 0.92))

    return F.element_at(F.transform(F.array(babble_measures(text)), test), 1)


def normalized(text: Column) -> Column:
    """Collapsed white space, lower case: what near-duplicates are judged on."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """SimHash of word trigrams (single words under three) by XXH3-64, signed; 0 without words; a bit needs a majority."""
    import numpy as np
    import xxhash

    def one(text: str | None) -> int:
        w = (text or "").split()
        if not w:
            return 0
        grams = w if len(w) < 3 else [" ".join(g) for g in zip(w, w[1:], w[2:], strict=False)]
        hashes = np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)
        votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int(np.packbits(2 * votes > len(grams), bitorder="little").view(np.int64)[0])

    return texts.map(one)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rss_date(epoch: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def retry_after_ms(header: Column) -> Column:
    """Whole seconds only; NULL for dates."""
    return F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).try_cast("long") * 1000)


def content_type_ok(kind: Column) -> Column:
    return (F.trim(kind) == "") | F.lower(kind).rlike("html|text/plain|xml")


def slow_drip(received: Column, seconds: Column) -> Column:
    return (received >= 65536) & (received / 1024 / F.greatest(seconds, F.lit(1e-9)) < 8)
