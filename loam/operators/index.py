"""The inverted index as tables: postings, field lengths, term and field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import ALNUM
from loam.functions.urls import let

from .tables import Versions, saved

FIELDS = ("title", "body", "description")
BOOSTS = {"title": 4.0, "body": 1.0, "description": 2.0}
K1, B = 1.2, 0.75
TOKEN_BYTES = 40


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 40 bytes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([{ALNUM}]+)"))
    return F.filter(found, lambda t: F.octet_length(t) <= TOKEN_BYTES)


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame  # term, field, doc_id, tf, positions, len (tokens of the field)
    lengths: DataFrame  # doc_id, field, len
    term_stats: DataFrame  # term, field, df
    field_stats: DataFrame  # field, n_docs, avg_len

    def save(self, path: str) -> None:
        """Commit all tables as a new version: a reader sees the old ones or the new ones.

        Postings and term statistics are in ranges of terms and sorted, so that look-ups prune files.
        """
        versions = Versions(self.docs.sparkSession, path)
        to = versions.new()
        for name in ("postings", "term_stats"):
            getattr(self, name).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{to}/{name}")
        for name in ("docs", "lengths", "field_stats"):
            getattr(self, name).write.parquet(f"{to}/{name}")
        versions.publish(to)

    @staticmethod
    def load(spark, path: str) -> Index:  # noqa: ANN001
        version = Versions(spark, path).current()
        if version is None:
            raise FileNotFoundError(f"no index at {path}")
        return Index(*(spark.read.parquet(f"{version}/{t}") for t in ("docs", "postings", "lengths", "term_stats", "field_stats")))

    def delete(self, gone: DataFrame) -> Index:
        """Without the documents of the URLs ``gone`` (url).  Only their own postings are counted again."""
        return self._changed(gone.select("url").distinct(), None)

    def upsert(self, new: DataFrame) -> Index:
        """With the documents ``new``, of distinct URLs, in place of those with their URLs.  Only the new texts are cut into tokens."""
        return self._changed(new.select("url"), build(new.select(*self.docs.columns)))

    def has(self, urls: DataFrame) -> DataFrame:
        """The URLs (url) that are indexed."""
        return urls.select("url").join(self.docs.select("url"), "url", "left_semi")

    def _changed(self, urls: DataFrame, added: Index | None) -> Index:
        gone = saved(self.docs.join(urls, "url", "left_semi").select("doc_id"))
        stay = lambda df: df.join(gone, "doc_id", "left_anti")
        stats = self.term_stats.unionByName(self.postings.join(gone, "doc_id", "left_semi").groupBy("term", "field").agg((-F.count("*")).alias("df")))
        docs, postings, lengths = stay(self.docs), stay(self.postings), stay(self.lengths)
        if added is not None:
            docs, postings, lengths = docs.unionByName(added.docs), postings.unionByName(added.postings), lengths.unionByName(added.lengths)
            stats = stats.unionByName(added.term_stats)
        return Index(docs, postings, lengths, stats.groupBy("term", "field").agg(F.sum("df").alias("df")).where("df > 0"), _field_stats(lengths))


def _field_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def build(docs: DataFrame, terms: list[str] | None = None, fields: tuple[str, ...] = FIELDS) -> Index:
    """An index of ``docs`` (doc_id and the fields).

    With ``terms`` only their postings are made, in one scan and without a
    shuffle; statistics of fields are those of all tokens either way.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields])
    rows = docs.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", "f.tokens")
    if terms is not None:
        wanted = F.array(*[F.lit(t) for t in sorted(set(terms))]) if terms else F.array().cast("array<string>")
        place = lambda t: F.filter(F.transform("tokens", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
        hits = F.transform(F.array_intersect(F.col("tokens"), wanted), lambda t: F.struct(t.alias("term"), place(t).alias("positions")))
        # Texts are read and cut into tokens once; all tables come of what is written here.
        slim = saved(rows.select("doc_id", "field", F.size("tokens").alias("len"), hits.alias("hits")))
        lengths = slim.select("doc_id", "field", "len")
        found = slim.select("doc_id", "field", "len", F.explode("hits").alias("p"))
        postings = found.select("p.term", "field", "doc_id", F.size("p.positions").alias("tf"), "p.positions", "len")
    else:
        lengths = rows.select("doc_id", "field", F.size("tokens").alias("len"))
        # A field's tokens are all in its row, so its postings are made there, without a shuffle.
        def of(t: Column) -> Column:
            begin = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x["term"] != F.get(t, i - 1)["term"]), i)), lambda i: i.isNotNull())
            end = lambda first, k: F.coalesce(F.get(first, k + 1), F.size(t))
            part = lambda first, s, k: F.transform(F.slice(t, s + 1, end(first, k) - s), lambda x: x["at"])
            return let(begin, lambda first: F.transform(first, lambda s, k: F.struct(F.get(t, s)["term"].alias("term"), part(first, s, k).alias("positions"))))

        spread = F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("at"))))
        found = rows.select("doc_id", "field", F.size("tokens").alias("len"), F.explode(let(spread, of)).alias("p"))
        postings = found.select("p.term", "field", "doc_id", F.size("p.positions").alias("tf"), "p.positions", "len")
    stats = postings.groupBy("term", "field").agg(F.count("*").alias("df"))
    return Index(docs, postings, lengths, stats, _field_stats(lengths))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
