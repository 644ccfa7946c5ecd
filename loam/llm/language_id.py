"""Language identification with one Kneser-Ney character model per language."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import GATHERED_BYTES, forget, map_texts, materialize

ORDER = 5
MAX_GRAMS = 2_000_000


class Scorer:
    """Class scores of texts, from models of at most ``max_grams`` (label, gram) rows each.

    ``counts`` has all training grams.  Where they are more than ``max_grams``
    rows they are dealt into shards by the last characters of the context, as
    many of them as it takes to keep each bucket of contexts below the bound.
    Discounts and short orders are counted over all shards, and the sums of all
    shards are those of the one model.  Texts are read once at every size: a
    task gathers a few megabytes and scores them shard after shard.  The driver
    builds one shard's model at a time and keeps its mean, deviation and weight.
    """

    def __init__(self, counts: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, shared_below: int = 0) -> None:
        self.counts, self.order, self.shared_below = counts, order, shared_below
        rows = counts.groupBy("label").agg(F.count("*").alias("n")).collect()  # one row a label
        self.labels = sorted(r["label"] for r in rows)
        self.depth, self.shard_of = 0, np.zeros(kn.BUCKETS, np.int32)
        if sum(r["n"] for r in rows) > max_grams:
            self._deal(max_grams)
        self.shards = int(self.shard_of.max()) + 1
        self._held: list[Broadcast] | None = None
        self._stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _deal(self, max_grams: int) -> None:
        """Buckets of contexts to shards; the driver sees one number a bucket."""
        for self.depth in range(2, max(3, self.order)):
            found = self.counts.groupBy(kn.bucket_of(F.col("gram"), self.order, self.depth).alias("b")).agg(F.count("*").alias("n")).collect()
            if max(r["n"] for r in found) <= max_grams:
                break
        else:
            raise ValueError(f"one bucket of contexts has more than {max_grams} grams; raise max_grams")
        shard = held = 0
        for r in sorted(found, key=lambda r: r["b"]):
            if held and held + r["n"] > max_grams:
                shard, held = shard + 1, 0
            self.shard_of[r["b"]] = shard
            held += r["n"]

    def models(self) -> list[Broadcast]:
        """One broadcast model a shard."""
        if self._held is None:
            common = (self._given(), kn.discounts(self.counts, self.order, self.shared_below)) if self.shards > 1 else ()
            spark, self._held = self.counts.sparkSession, []
            for shard in range(self.shards):
                part = self.counts
                if self.shards > 1:
                    mine = F.array(*[F.lit(int(b)) for b in np.flatnonzero(self.shard_of == shard)])
                    part = part.where(F.array_contains(mine, kn.bucket_of(F.col("gram"), self.order, self.depth)))
                table = part.toArrow()  # max_grams rows at most
                label, gram, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("label", "gram", "n"))
                model = kn.build({k: (gram[label == k], n[label == k]) for k in self.labels}, self.order, self.shared_below, *common)
                self._stats.append((model.weight, model.mean, model.deviation))
                self._held.append(spark.sparkContext.broadcast(model))
        return self._held

    def stats(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of each label's loss a character on its own training text."""
        self.models()
        weight, mean, deviation = (np.array(x) for x in zip(*self._stats, strict=True))
        if len(mean) == 1 or not self.labels:
            return mean[0], deviation[0]
        whole = np.average(mean, axis=0, weights=weight)
        return whole, np.sqrt(np.average(deviation**2 + (mean - whole) ** 2, axis=0, weights=weight))

    def _given(self) -> dict[int, dict[str | None, tuple[np.ndarray, np.ndarray]]]:
        """Numbers of distinct predecessors of the grams of up to ``depth`` characters, over all shards, by label and of all labels (None)."""
        bits, out = 60 // self.order, {}
        for n in range(1, self.depth + 1):
            mask = lambda k: (1 << bits * k) - 1
            longer = self.counts.select("label", F.col("gram").bitwiseAND(mask(n + 1)).alias("longer"))
            longer = longer.unionByName(longer.withColumn("label", F.lit(None).cast("string"))).distinct()
            rows = longer.groupBy("label", F.col("longer").bitwiseAND(mask(n)).alias("g")).agg(F.count("*").alias("n")).toArrow()
            label, g, c = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("label", "g", "n"))
            out[n] = {}
            for k in (*self.labels, None):
                mine = np.array([x == k for x in label.tolist()], bool)
                by = np.argsort(g[mine])
                out[n][k] = g[mine][by], c[mine][by].astype(np.float64)
        return out

    def apply(self, docs: DataFrame, text: str, added: str, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, kn.Stream], list], words: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
        """``docs``, less the columns ``drop``, with the columns ``added``, which ``finish`` makes of a batch's sums.

        It gets the log-probability sums (units, labels), the characters and the
        text of each unit, and the stream.  A unit is a text or, with ``words``,
        one of its words.  A null text counts as empty.
        """
        order, k, depth = self.order, len(self.labels), self.depth
        held, of = self.models(), self.shard_of
        mask = (1 << 60 // order) - 1

        def each(batch: pa.RecordBatch) -> list:
            s = kn.stream(batch.column(0).to_pylist(), order)
            if words:
                unit = np.cumsum((s.codes & mask) == 32) - 1
                owner = np.zeros(int(unit[-1]) + 1 if len(unit) else 0, np.int64)
                owner[unit] = s.doc
            else:
                unit, owner = s.doc, np.arange(batch.num_rows)
            shard = of[kn.bucket_of(s.codes, order, depth)] if len(held) > 1 else None
            sums = np.zeros((len(owner), k))
            for i, model in enumerate(held):
                mine = slice(None) if shard is None else np.flatnonzero(shard == i)
                scores = model.value.score(s.codes[mine])
                if shard is not None:
                    forget(model)
                for j in range(k):
                    sums[:, j] += np.bincount(unit[mine], weights=scores[:, j], minlength=len(owner))
            return finish(sums, np.bincount(unit, minlength=len(owner)), owner, s)

        return map_texts(docs, [text], added, each, drop=drop, text_bytes=kn.SLICE_BYTES if len(held) == 1 else GATHERED_BYTES, gather=len(held) > 1)


def train(docs: DataFrame, text: str = "text", label: str = "lang", order: int = ORDER, max_grams: int = MAX_GRAMS) -> Scorer:
    """A scorer learned from every row with a label; rows without one are left out.

    A null text counts as empty; of an empty text a model learns that it ends.
    Very long texts are cut into grams like all others.  Repeated rows count as
    often as they come.  An empty table gives a scorer without labels.  Other
    columns are not looked at.
    """
    known = docs.where(F.col(f"`{label}`").isNotNull())
    return Scorer(materialize(kn.gram_counts(known, text, label, order)), order, max_grams)


def identify(docs: DataFrame, scorer: Scorer, text: str = "text", reject_at: float = 6.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, less the columns ``drop``, with lang_pred, score, cross_entropy and rejected.

    The language is the one of lowest cross-entropy per character; ``und`` where
    the text is null, has no letter, or nothing was learned.  ``score`` is its
    posterior share at equal priors, tempered to the square root of the length,
    since neighbouring characters repeat each other's evidence; 0 for ``und``.
    ``rejected`` says that the loss exceeds what the language's own training text
    shows by more than ``reject_at`` of its standard errors; the best language is
    still given.  Ties go to the first language in order.  Every row is judged by
    its text alone, whole at any length, so repeated rows get the same; an empty
    table gives none.  Columns with the added names, in any case, are replaced.
    """
    labels = scorer.labels
    mean, spread = scorer.stats()

    def decide(sums: np.ndarray, n: np.ndarray, owner: np.ndarray, stream: kn.Stream) -> list:
        rows = len(owner)
        if not labels:
            return [["und"] * rows, [0.0] * rows, [None] * rows, [True] * rows]
        n = np.maximum(n, 1).astype(np.float64)
        known = stream.letters
        loss = -sums / n[:, None]
        best = loss.argmin(1)
        lowest = loss[np.arange(rows), best]
        share = 1 / np.exp((lowest[:, None] - loss) * np.sqrt(n)[:, None]).sum(1)
        far = (lowest - mean[best]) / (spread[best] / np.sqrt(n)) > reject_at
        return [[labels[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0), pa.array(lowest, mask=~known), far | ~known]

    return scorer.apply(docs, text, "lang_pred string, score double, cross_entropy double, rejected boolean", decide, drop=drop)
