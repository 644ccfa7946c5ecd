"""Toxicity by class-conditional Kneser-Ney character models.

A model of toxic text and one of ordinary text give each expression (a run of
words) a log-likelihood.  Both are normalised by the expression's length and
compared; a text is as toxic as its most toxic expression, so that neither its
length nor how much else it says matters.  The longest grams, of three and four
characters, are counted by class; the orders that they back off to are counted
over both classes together, so that what a class has seen rarely backs off to
what both share and by itself speaks for neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import KeyFilter, map_texts, materialize, passing
from .language_id import MAX_GRAMS, Scorer

ORDER = 4
#: Orders below this one are counted over both classes.
SHARED_BELOW = 3
#: Words of an expression.
EXPRESSION = 1
#: Characters that every expression is taken to have besides its own, as likely in both classes.
PRIOR_CHARS = 5
BINS, REACH = 8192, 8.0


class Toxicity:
    """Learned models and the curve, through points (margin, share), from a text's margin to a probability."""

    def __init__(self, scorer: Scorer, points: np.ndarray, shares: np.ndarray) -> None:
        self.scorer, self.points, self.shares = scorer, points, shares

    def score(self, docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
        """``docs``, less the columns ``drop``, with margin and score (0 to 1).

        A null text counts as empty; an empty text has margin 0 and what the
        curve says of it.  Texts are read whole at any length.  Every row is
        judged by its text alone, so repeated rows get the same; an empty table
        gives none.  Columns named margin or score, in any case, are replaced.
        If only one class was learned, that class alone decides: score is 1.0 if
        it is the toxic one, else (and if nothing was learned) 0.0.
        """
        points, shares = self.points, self.shares

        def curve(batch: pa.RecordBatch) -> list:
            return [np.interp(batch.column(0).to_numpy(), points, shares)]

        return map_texts(margins(docs, self.scorer, text, drop), ["margin"], "score double", curve)


def margins(docs: DataFrame, scorer: Scorer, text: str, drop: tuple[str, ...] = (), words: int = EXPRESSION) -> DataFrame:
    """``docs``, less the columns ``drop``, with margin: by how much the toxic log-likelihood per character exceeds the ordinary one, in the expression of ``words`` words where it does most; 0 at least."""
    both = scorer.labels == ["0", "1"]

    def finish(sums: np.ndarray, n: np.ndarray, owner: np.ndarray, stream: kn.Stream) -> list:
        out = np.zeros(len(stream.letters))
        if both and len(owner):
            log = [np.concatenate([[0], np.cumsum(x)]) for x in (sums[:, 1], sums[:, 0], n)]
            begin = np.arange(len(owner))
            end = np.minimum(begin + words, np.searchsorted(owner, owner, "right"))
            toxic, ordinary, chars = (x[end] - x[begin] for x in log)
            np.maximum.at(out, owner, toxic / (chars + PRIOR_CHARS) - ordinary / (chars + PRIOR_CHARS))
        return [out]

    return scorer.apply(docs, text, "margin double", finish, words=True, drop=drop)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of the non-decreasing curve through weighted shares ``y`` at ascending ``x`` (pool adjacent violators).

    Each block counts one row more, of the overall share.
    """
    share = float(np.average(y, weights=w))
    blocks: list[np.ndarray] = []
    for block in np.stack([x * w, y * w, w], 1):
        blocks.append(block)
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = blocks[-1] + last
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], (sums[:, 1] + share) / (sums[:, 2] + 1)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", filter_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the columns of ``labels``, for those that have a label.

    Labels grow with the documents, so they are never broadcast: a filter of
    fixed size spares most unlabelled texts the shuffle (with more than about
    8 labels a byte of it, none), and the join is the same at every size.  Rows
    with a null key have no label; a row comes once for each label of its key.
    Columns of ``docs`` that have the name of one of ``labels``, in any case,
    give way to it.
    """
    named = {c.lower() for c in labels.columns} - {key.lower()}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in named])
    hashed = F.xxhash64(F.col(f"`{key}`")).alias("__key")
    maybe = passing(docs.select("*", hashed), KeyFilter.of(labels.select(hashed), filter_bytes), True, "__key").drop("__key")
    return maybe.join(labels.hint("merge"), key)


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", order: int = ORDER, max_grams: int = MAX_GRAMS) -> Toxicity:
    """Learn from every row with a label of 0 or 1; other rows are left out.

    A null text counts as empty; repeated rows count as often as they come; an
    empty table, or one of a single class, gives a model that says so of every
    text.  Other columns are not looked at.

    Rows are dealt into two folds by a hash of ``key``.  The curve is fitted to
    what each fold's rows get from the models of the other fold, counted in
    fixed bins (a non-decreasing one, so that labels that the text does not bear
    out only lift its low end), so that all rows count and the driver sees at most
    ``BINS`` pairs of numbers.  The final models have the counts of both folds.  Where
    a fold lacks a class, its part of the curve comes of the final models.
    """
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("y"), F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    )
    rows = materialize(rows)
    tagged = materialize(kn.gram_counts(rows.withColumn("tag", F.concat_ws("/", "fold", "y")), "text", "tag", order).select(F.substring("label", 1, 1).cast("int").alias("fold"), F.substring("label", 3, 1).alias("label"), "gram", "n"))
    whole = Scorer(materialize(tagged.groupBy("label", "gram").agg(F.sum("n").alias("n"))), order, max_grams, SHARED_BELOW)
    if whole.labels != ["0", "1"]:
        return Toxicity(whole, np.zeros(1), np.full(1, float(whole.labels == ["1"])))
    found = None
    for fold in (0, 1):
        other = Scorer(tagged.where(F.col("fold") == 1 - fold).drop("fold"), order, max_grams, SHARED_BELOW)
        if other.labels != ["0", "1"]:
            other = whole
        part = margins(rows.where(F.col("fold") == fold), other, "text", ("text",)).select("y", F.floor(F.col("margin") * (BINS / REACH)).cast("int").alias("bin"))
        found = part if found is None else found.unionByName(part)
    bins = found.select("y", F.least(F.lit(BINS - 1), "bin").alias("bin")).groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    b, y, n = (np.array([r[i] for r in bins], dtype=np.float64) for i in range(3))
    return Toxicity(whole, *_isotonic((b + 0.5) * (REACH / BINS), y / n, n))
