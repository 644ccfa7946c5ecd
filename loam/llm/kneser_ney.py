"""Interpolated Kneser-Ney character models, one per class, in sorted hash arrays.

A gram of ``order`` characters is one integer: each character is folded to
``60 // order`` bits (characters beyond that range share hashed slots) and the
slots are shifted together, so suffixes and contexts are masks and shifts.
Counting is distributed (:func:`gram_counts`).  A model of more grams than one
broadcast may hold is dealt into shards by a hash of the last characters of the
context: all that interpolation needs of the longer orders is then in one
shard, while discounts and the counts of the short orders are made over all
grams and given to every shard.  A position is scored wholly inside one shard,
so sums over shards are those of the one model.

Characters: letters and combining marks, in lower case; all else is a space,
and runs of spaces are one.  Code points below three quarters of the slots
(0xC00 of order 5, 0x6000 of order 4) have one slot each; those above share the
remaining quarter by hash, which tells scripts apart better than their letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_rows, slices, tidied

SLICE_BYTES = 1 << 20  # of text at a time
HELD_GRAMS = 1 << 20  # grams that a task gathers before it sums them up
PAD = 2  # marks what lies before a text
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose high bits are evenly spread."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_TABLES: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Code points that are letters."""
    if 0 not in _TABLES:
        _TABLES[0] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES[0]


def fold_table(bits: int) -> np.ndarray:
    """Code point to slot: letters and marks keep their (lower-case) place or share hashed slots, all else is a space."""
    if bits not in _TABLES:
        points = np.arange(0x110000, dtype=np.uint64)
        marks = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)
        kept = (1 << bits) - (1 << (bits - 2))
        shared = kept + (_mix(points) >> np.uint64(64 - (bits - 2))).astype(np.int64)
        slots = np.where(points < kept, points.astype(np.int64), shared)
        slots = np.where(letter_table() | marks, slots, 32)
        slots[PAD] = PAD
        _TABLES[bits] = slots
    return _TABLES[bits]


@dataclass
class Stream:
    """Grams of a batch of texts: code of each predicted character's gram, and the text it belongs to."""

    codes: np.ndarray
    doc: np.ndarray
    letters: np.ndarray  # per text: whether it has a letter


def stream(texts: list[str | None], order: int) -> Stream:
    bits = 60 // order
    gap = chr(PAD) * (order - 1)
    joined = gap + "".join(" " + (t or "").replace(chr(PAD), " ") + " " + gap for t in texts)
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = fold_table(bits)[points]
    space = slots == 32
    keep = np.ones(len(slots), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    slots, lettered = slots[keep], letter_table()[points[keep]]
    pad = slots == PAD
    starts = pad.copy()
    starts[1:] &= ~pad[:-1]
    doc = np.cumsum(starts) - 1
    code = np.zeros(len(slots), np.int64)
    for j in range(order):
        code[j:] |= slots[: len(slots) - j].astype(np.int64) << (bits * j)
    real = ~pad
    letters = np.zeros(len(texts), bool)
    letters[doc[lettered]] = True
    return Stream(code[real], doc[real], letters)


def gram_counts(rows: DataFrame, text: str, label: str, order: int) -> DataFrame:
    """Counts of all grams: (label, gram, n).  ``rows`` has columns text and label (string, not null).

    Each task counts its own distinct grams before anything is shuffled, and the
    shuffle is by gram, so no class and no text makes a hot task.
    """
    schema = "label string, gram long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merge(least: int) -> Iterator[pa.RecordBatch]:
            """Sum what is held, and give away what has ``least`` grams and more."""
            nonlocal waiting
            waiting = 0
            for k in sorted(held):
                grams, n, _ = _grouped(*(np.concatenate([x[i] for x in held[k]]) for i in (0, 1)))
                if len(grams) >= least:
                    del held[k]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["label", "gram", "n"])
                else:
                    held[k] = [(grams, n.astype(np.int64))]

        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            by: dict[str, list[str | None]] = {}
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                held.setdefault(k, []).append(np.unique(stream(texts, order).codes, return_counts=True))
                waiting += len(held[k][-1][0])
            if waiting > HELD_GRAMS:
                yield from merge(HELD_GRAMS)
        yield from merge(0)

    found = long_rows(rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))).mapInArrow(tidied(count), schema)
    return found.groupBy("label", "gram").agg(F.sum("n").alias("n"))


#: Buckets of contexts that shards are made of.
BUCKETS = 4093


def bucket_of(gram, order: int, depth: int):  # noqa: ANN001, ANN201
    """Bucket of grams (a column or an array) by the ``depth`` characters before the last."""
    bits = 60 // order
    if isinstance(gram, Column):
        return F.pmod(F.shiftright(gram, bits).bitwiseAND((1 << bits * depth) - 1), F.lit(BUCKETS)).cast("int")
    return (gram >> bits & ((1 << bits * depth) - 1)) % BUCKETS


class HashArray:
    """Keys sorted by a mixed hash, with a directory over the hash's leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        mixed = _mix(keys)
        self.by = np.argsort(mixed, kind="stable")
        self.hashes = mixed[self.by]
        self.shift = 64 - max(1, int(len(keys)).bit_length())
        heads = (self.hashes >> np.uint64(self.shift)).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << (64 - self.shift)) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max(initial=0))
        self.hashes = np.append(self.hashes, np.zeros(self.deep + 1, np.uint64))
        self.n = len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key in hash order, or -1."""
        mixed = _mix(keys)
        head = (mixed >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.first[head].astype(np.int64), self.first[head + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.deep):
            live = at < end
            if not live.all():
                left, at, end, mixed = left[live], at[live], end[live], mixed[live]
            if not len(left):
                break
            same = self.hashes[at] == mixed
            out[left[same]] = at[same]
            left, at, end, mixed = left[~same], at[~same] + 1, end[~same], mixed[~same]
        return out


@dataclass
class Model:
    """Log probabilities by order: ``grams[n]`` finds a row of ``logp[n]``, ``contexts[n]`` one of ``back[n]``."""

    order: int
    labels: list[str]
    grams: dict[int, HashArray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, HashArray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray | None = None
    mean: np.ndarray | None = None  # loss per character of a label's own training text, and its deviation
    deviation: np.ndarray | None = None
    weight: np.ndarray | None = None  # its characters

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character under each label: (grams, labels)."""
        bits = 60 // self.order
        out = np.zeros((len(codes), len(self.labels)), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            part = codes[left] & ((1 << (bits * n)) - 1)
            at = self.grams[n].find(part)
            hit = at >= 0
            out[left[hit]] += self.logp[n][at[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            if n > 1:
                at = self.contexts[n].find(part >> bits)
                seen = at >= 0
                out[left[seen]] += self.back[n][at[seen]]
        out[left] += self.floor
        return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums and numbers of values."""
    out, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return out, np.bincount(inverse, weights=values, minlength=len(out)), n


def _levels(grams: np.ndarray, n: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of each order: as counted at the top, numbers of distinct predecessors below."""
    bits, out = 60 // order, {order: (grams, n.astype(np.float64))}
    for k in range(order - 1, 0, -1):
        below = out[k + 1][0] & ((1 << (bits * k)) - 1)
        found, _, kinds = _grouped(below, np.ones(len(below)))
        out[k] = (found, kinds.astype(np.float64))
    return out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys, 0 where there are none; keys are sorted."""
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0.0)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def discounts(counts: DataFrame, order: int, shared_below: int = 0) -> dict[tuple[str | None, int], float]:
    """Discounts of {(label, order)} from order 2 up over all grams, whatever shards they are in; label None is all labels together."""
    level, pooled, found = counts.select("label", "gram", "n"), None, None
    if shared_below > 2:
        pooled = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("label"), "gram", "n")
    for at in (level, pooled):
        for n in range(order, 1, -1) if at is not None else ():
            if n < order:
                at = at.groupBy("label", F.col("gram").bitwiseAND((1 << 60 // order * n) - 1).alias("gram")).agg(F.count("*").alias("n"))
            part = at.groupBy("label").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).withColumn("order", F.lit(n))
            found = part if found is None else found.unionByName(part)
    return {(r["label"], r["order"]): _discount(r["once"], r["twice"]) for r in found.collect()}


def _interpolate(own: tuple[np.ndarray, np.ndarray], union: np.ndarray, contexts: np.ndarray, base: np.ndarray, bits: int, discount: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the grams ``union``, and log weights of what is below each context: 0 where it is not seen."""
    grams, c = own
    if discount is None:
        discount = _discount((c == 1).sum(), (c == 2).sum())
    heads, total, kinds = _grouped(grams >> bits, c)

    def weight(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = _at(heads, total, wanted)
        return t, np.divide(discount * _at(heads, kinds, wanted), t, out=np.ones(len(wanted)), where=t > 0)

    t, w = weight(union >> bits)
    p = np.divide(np.maximum(_at(grams, c, union) - discount, 0), t, out=np.zeros(len(union)), where=t > 0) + w * base
    return p, np.log(weight(contexts)[1])


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, shared_below: int = 0, given: dict[int, dict[str | None, tuple[np.ndarray, np.ndarray]]] | None = None, discounts: dict[tuple[str | None, int], float] | None = None) -> Model:
    """The model of {label: (distinct grams, counts)}.

    Orders under ``shared_below`` take their counts from all labels together:
    every label then backs off to the same distribution.  Where ``counts`` are
    one shard's, ``given`` has the grams and counts of the short orders by label,
    and under None of all labels together, and ``discounts`` those of
    :func:`discounts`, both over all shards.
    """
    bits, labels = 60 // order, sorted(counts)
    counts = {k: tuple(x[np.argsort(counts[k][0])] for x in counts[k]) for k in labels}
    none = np.zeros(0, np.int64)
    grams, n, _ = _grouped(np.concatenate([none, *(counts[k][0] for k in labels)]), np.concatenate([none, *(counts[k][1] for k in labels)]))
    pooled = _levels(grams, n, order)
    levels = {k: _levels(*counts[k], order) for k in labels}
    for level, of in (given or {}).items():
        pooled[level] = of[None]
        for k in labels:
            levels[k][level] = of[k]
    alphabet = len(pooled[1][0]) + 1
    model = Model(order, labels, floor=np.full(len(labels), -np.log(alphabet), np.float32))
    lower = np.full((len(pooled[1][0]), len(labels)), 1 / alphabet)
    for n in range(1, order + 1):
        union = pooled[n][0]
        contexts = np.unique(union >> bits)
        if n > 1:
            lower = lower[np.searchsorted(pooled[n - 1][0], union & ((1 << (bits * (n - 1))) - 1))]
        shared = n < shared_below
        steps = [_interpolate(pooled[n] if shared else levels[k][n], union, contexts, lower[:, j], bits, (discounts or {}).get((None if shared else k, n))) for j, k in enumerate(labels)]
        p, back = (np.stack([s[i] for s in steps], 1) if steps else np.zeros((len(x), 0)) for i, x in ((0, union), (1, contexts)))
        lower = p
        table = HashArray(union)
        model.grams[n], model.logp[n] = table, np.log(p)[table.by].astype(np.float32)
        if n > 1:
            table = HashArray(contexts)
            model.contexts[n], model.back[n] = table, back[table.by].astype(np.float32)
        elif len(back):
            model.floor = model.floor + back[0].astype(np.float32)
    top = {k: (grams, n) for k, (grams, n) in counts.items()}
    stats = []
    for j, k in enumerate(labels):
        grams, n = top[k]
        loss = -model.score(grams)[:, j].astype(np.float64) if len(grams) else np.zeros(1)
        w = n if len(grams) else np.ones(1)
        mean = np.average(loss, weights=w)
        stats.append((mean, np.sqrt(np.average((loss - mean) ** 2, weights=w)), float(np.sum(n))))
    model.mean, model.deviation = np.array([s[0] for s in stats]), np.array([s[1] for s in stats])
    model.weight = np.array([s[2] for s in stats])
    return model
