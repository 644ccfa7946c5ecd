"""Removal of repeated word windows over a log-structured fingerprint index.

A window of ``width`` words has as its fingerprint the smallest hash among its
``gram``-word grams, so equal windows have equal fingerprints, and neighbouring
windows mostly share one: about 7 % of the windows give one to the index.  The
index is a set of immutable runs (fp, n), one for each batch of documents, each
bucketed and sorted by fingerprint.  A new batch's run is merge-joined with the
runs of history, bucket by bucket, so that history is never shuffled; that names
the fingerprints that occur twice or more.  Runs are compacted into one, by the
same kind of join, once there are a few.

Windows whose fingerprint occurs once are unique.  The others are verified:
their whole word sequences are hashed to 64 bits more, sent to where their
fingerprint is dealt, and compared there.  What a task's rows have twice
themselves is sent once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, delete_folder, long_rows, map_texts, materialize, new_folder, passing, slices, tidied

WIDTH = 35
GRAM = 8
#: Batches that a table without history is dealt into.
BATCHES = 3
#: Runs that are compacted into one.
FAN_IN = 3
_B = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS, _INVERSE = both
    return _POWERS[:n], _INVERSE[:n]


def split_words(text: str | None) -> list[bytes]:
    """Words between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Rolling:
    """Hashes of all word sequences of any one length in a text."""

    def __init__(self, words: list[bytes]) -> None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter(map(digest, words), np.uint64, len(words))
        self.n = len(words)
        self.power, inverse = _powers(self.n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * inverse[: self.n], dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of words i .. i+k-1, for each i."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = (self.sums[k:] - self.sums[:-k]) * self.power[: self.n - k + 1]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))


def window_fingerprints(rolling: Rolling, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the smallest of them in each window."""
    grams, span = rolling.grams(gram), width - gram + 1
    low, have = grams, 1
    if len(grams) < span:
        return grams, grams[:0]
    while 2 * have <= span:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return grams, low


def fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(fp, n, row): fingerprints of each document's windows, with the number of gram places that have them.

    ``docs`` has columns row and text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for t in batch.column(0).to_pylist():
                grams, low = window_fingerprints(Rolling(split_words(t)), width, gram)
                if not len(low):
                    found.append((low, low))
                    continue
                chosen = np.unique(low[np.concatenate([[True], low[1:] != low[:-1]])])
                every = np.sort(grams)
                found.append((chosen, np.searchsorted(every, chosen, "right") - np.searchsorted(every, chosen)))
            sizes = np.array([len(x) for x, _ in found], np.int64)
            take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            fps = np.concatenate([f[0] for f in found]).astype(np.uint64).view(np.int64)
            n = np.concatenate([f[1] for f in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(n), batch.column(1).take(take)], names=["fp", "n", "row"])

    return long_rows(docs.select("text", "row")).mapInArrow(tidied(each), "fp long, n int, row long")


class FingerprintIndex:
    """Sorted immutable runs (fp, n), and the places (fp, n, row) they count, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.path = path or new_folder(spark, "index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: list[DataFrame] = []

    def _write(self, run: DataFrame) -> str:
        """A run as a bucketed table: equal fingerprints of all runs are in buckets of one number."""
        name = f"loam_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_folder(self.spark, f"{self.path}/{name}")

    def add(self, prints: DataFrame) -> DataFrame:
        """Add a batch's fingerprints (fp, n, row) as a run; gives those that occur twice or more by now: (fp, n)."""
        places = materialize(prints, f"{self.path}/places-{len(self.batches):05d}-{uuid.uuid4().hex[:8]}")
        run = self._write(places.groupBy("fp").agg(F.sum("n").alias("n")))
        hits = self.spark.table(run).hint("merge")
        for old in self.runs:
            held = self.spark.table(old).select("fp", F.col("n").alias("m")).hint("merge")
            hits = hits.join(held, "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        hits = materialize(hits.where("n > 1"))
        self.runs.append(run)
        self.batches.append(places)
        return self.compact(self.fan_in) and hits

    def compact(self, least: int = 2) -> FingerprintIndex:
        """One run in place of all, if there are ``least`` of them; readers of the old ones must be done."""
        if len(self.runs) >= max(2, least):
            whole = self.spark.table(self.runs[0]).hint("merge")
            for run in self.runs[1:]:
                more = self.spark.table(run).select("fp", F.col("n").alias("m")).hint("merge")
                whole = whole.join(more, "fp", "full").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            old, self.runs = self.runs, [self._write(whole)]
            self._forget(old)
        return self

    def table(self) -> DataFrame:
        """All runs merged: (fp, n)."""
        if not self.runs:
            return self.spark.createDataFrame([], "fp long, n long")
        return self.spark.table(self.compact().runs[0])

    def places(self) -> DataFrame:
        """(fp, n, row) of all batches."""
        out = self.spark.createDataFrame([], "fp long, n int, row long")
        for p in self.batches:
            out = out.unionByName(p)
        return out

    def drop(self) -> None:
        """Delete all files of the index."""
        self._forget(self.runs)
        self.runs, self.batches = [], []
        delete_folder(self.spark, self.path)


#: Bytes of the filter of documents that have a repeated fingerprint.
FILTER_BYTES = 4 << 20
#: Places of a fingerprint beyond which its windows are dealt out by their own hashes, into so many deals for each multiple of it.
HOT, DEALS = 50_000, 64
#: Windows that a task remembers to have found twice.
REMEMBERED = 1 << 20


def _runs(starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Ends of pieces of consecutive starts of one kind."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([(starts[1:] != starts[:-1] + 1) | (kinds[1:] != kinds[:-1]), [True]])) + 1


def _kind(fps: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashes * np.uint64(0x9E3779B97F4A7C15) + fps


def _twice(fps: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows (fp, hash) weigh two or more together, and which is the first of its kind."""
    order = np.argsort(_kind(fps, hashes), kind="stable")
    f, h = fps[order], hashes[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])]) if len(f) else np.zeros(0, bool)
    kind = np.cumsum(new) - 1
    n = np.bincount(kind, weights=weight[order])
    twice, first = np.zeros(len(f), bool), np.zeros(len(f), bool)
    twice[order], first[order] = n[kind] > 1, new
    return twice, first


def _windows(both: DataFrame, width: int, gram: int, marked: bool) -> DataFrame:
    """Windows with a repeated fingerprint, of documents (id, row, text, known, hot), as runs of consecutive starts.

    Columns: fp, deal, id, row, start, n, hashes, weight.  Runs of weight 0 are
    known to be repeated and have no hashes; those of negative weight count and
    need no mark.  ``marked`` False: no run of these documents needs one.  A task
    remembers what it has found twice and does not send it again.
    """
    kind = both.schema["id"].dataType.simpleString()
    names = ["fp", "deal", "id", "row", "start", "n", "hashes", "weight"]

    def of(text: str | None, known: np.ndarray, hot: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        rolling = Rolling(split_words(text))
        _, low = window_fingerprints(rolling, width, gram)
        known = np.sort(known)
        if not len(low) or not len(known):
            return (np.zeros(0, np.int64), low[:0], low[:0], np.zeros(0, np.int64))
        starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low)
        hashes, deal = rolling.grams(width)[starts], np.zeros(len(starts), np.int64)
        if len(hot):
            order = np.argsort(hot)
            at = np.minimum(np.searchsorted(hot[order], low[starts]), len(hot) - 1)
            mine = hot[order][at] == low[starts]
            deal[mine] = (hashes[mine] >> (np.uint64(64) - bits[order][at[mine]].astype(np.uint64))).astype(np.int64) + 1
        return starts, low[starts], hashes, deal

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = -1 - TaskContext.get().partitionId() % 997
        again = np.zeros(0, np.uint64)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)
            parts = [of(t, k.values.to_numpy().view(np.uint64), h.values.field("fp").to_numpy().view(np.uint64), h.values.field("bits").to_numpy()) for t, k, h in rows]
            if not parts:
                continue
            doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            start, fp, h, deal = (np.concatenate([p[i] for p in parts]) for i in range(4))
            twice, first = _twice(fp, h, np.ones(len(h)))
            kinds = _kind(fp, h)
            told = again[np.minimum(np.searchsorted(again, kinds), len(again) - 1)] == kinds if len(again) else np.zeros(len(h), bool)
            new = twice & first & ~told
            if len(again) < REMEMBERED:
                again = np.union1d(again, kinds[new])
            for pick, weight in ((~twice & ~told, 1), (new, -2), (twice | told, 0)):
                i = np.flatnonzero(pick)
                if not len(i) or not (weight or marked):
                    continue
                ends = _runs(start[i] + (doc[i] << 32), fp[i] ^ deal[i].astype(np.uint64))
                begins = np.concatenate([[0], ends[:-1]])
                where = i[begins]
                take = pa.array(doc[where])
                offsets = np.concatenate([[0], ends]) if weight else np.zeros(len(ends) + 1)
                values = h[i] if weight else h[:0]
                ids, keys = batch.column(3).take(take), batch.column(4).take(take)
                # What needs no comparison is dealt out by row and task.
                dealt = [pa.array(fp[where].view(np.int64)), pa.array(deal[where])] if weight else [keys, pa.array(np.full(len(ends), spread))]
                columns = [
                    *dealt, ids, keys, pa.array(start[where].astype(np.int32)), pa.array((ends - begins).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))), pa.array(np.full(len(ends), weight if marked else -abs(weight), np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return long_rows(both.select("text", "known", "hot", "id", "row")).mapInArrow(tidied(each), f"fp long, deal long, id {kind}, row long, start int, n int, hashes array<long>, weight int")


def _verified(windows: DataFrame) -> DataFrame:
    """(id, row, start, n): runs of repeated windows.  A fingerprint's windows (of one deal) meet in one task.

    What a task holds of a fingerprint is bounded by its distinct windows: as
    rows come, windows found twice are marked and shrink to one hash each.
    """
    kind = windows.schema["id"].dataType.simpleString()
    names = ["id", "row", "start", "n"]

    def solve(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Marks, and what of the rows later ones of their key need."""
        weight, start = rows.column("weight").to_numpy(), rows.column("start").to_numpy()
        sizes = rows.column("hashes").value_lengths().to_numpy()
        run = np.repeat(np.arange(rows.num_rows), sizes)
        h = rows.column("hashes").flatten().to_numpy().view(np.uint64)
        fps = rows.column("fp").to_numpy().view(np.uint64)
        twice, first = _twice(fps[run], h, np.abs(weight)[run])
        place = start[run] + np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run]
        i = np.flatnonzero(twice & (weight[run] > 0))
        ends = _runs(place[i] + (run[i] << 32), np.zeros(len(i)))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        known = np.flatnonzero(weight == 0)
        take = pa.array(np.concatenate([known, run[i][begins]]))
        starts, counts = np.concatenate([start[known], place[i][begins]]), np.concatenate([rows.column("n").to_numpy()[known], ends - begins])
        marks = pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("row").take(take), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))], names=names)
        left = np.flatnonzero(first | ~twice)
        take = pa.array(run[left])
        columns = {c: rows.column(c).take(take) for c in ("fp", "deal", "id", "row")}
        columns |= {"start": pa.array(place[left].astype(np.int32)), "n": pa.array(np.ones(len(left), np.int32))}
        columns |= {"hashes": pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32)), pa.array(h[left].view(np.int64))), "weight": pa.array(np.where(twice[left], -2, weight[run[left]]).astype(np.int32))}
        return marks, pa.RecordBatch.from_arrays([columns[c] for c in rows.schema.names], names=rows.schema.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most = 0, 1 << 16
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            fp, deal = rows.column("fp").to_numpy(), rows.column("deal").to_numpy()
            other = np.flatnonzero((fp != fp[-1]) | (deal != deal[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solve(rows.slice(0, cut))[0]
            marks, rest = solve(rows.slice(cut))
            yield marks
            held, n = [rest], rest.num_rows
            most = max(1 << 16, 2 * n)
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])[0]

    return windows.repartition("fp", "deal").sortWithinPartitions("fp", "deal").mapInArrow(tidied(each), f"id {kind}, row long, start int, n int")


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, index: FingerprintIndex | None = None, history: DataFrame | None = None,
    hot: int = HOT, filter_bytes: int = FILTER_BYTES, batches: int = BATCHES,
) -> DataFrame:
    """``docs`` without the words that repeated windows cover: text (kept words, joined by a space), n_words, n_removed.

    A window counts as repeated if its words also start anywhere else in
    ``docs`` or, with an ``index`` of earlier batches, in ``history`` (their
    documents, with the same id and text columns).  Windows are judged on the
    texts as given.  Without an index ``docs`` goes through one of its own in
    ``batches`` parts, each merge-joined with the runs of those before; with one
    it is the next batch, and its run is added.

    Null and empty texts have no words; texts shorter than a window keep all;
    longer ones are read whole at any length.  Rows that repeat each other
    repeat each other's windows, so all their windowed words go, whether or not
    their ids are equal or null.  An empty table gives no rows.  Other columns
    pass through; those named n_words or n_removed, in any case, are replaced.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("row")
    keyed = lambda df: df.select(F.col(f"`{id}`").alias("id"), key, F.col(f"`{text}`").alias("text"))
    rows = keyed(docs)
    past = index.places() if index is not None else None
    held = index or FingerprintIndex(spark)
    hits, parts, before = None, 1 if index is not None else max(1, batches), len(held.batches)
    for i in range(parts):
        found = held.add(fingerprints(rows.where(F.pmod("row", F.lit(parts)) == i), width, gram))
        hits = found if hits is None else hits.unionByName(found)
    own = spark.createDataFrame([], "fp long, n int, row long")
    for p in held.batches[before:]:
        own = own.unionByName(p)
    repeated = materialize(hits.groupBy("fp").agg(F.max("n").alias("places")))
    bits = F.ceil(F.log2(F.col("places") / hot * DEALS)).cast("int")

    def known(prints: DataFrame) -> DataFrame:
        """(key, known, hot): repeated fingerprints of each row, and those of them with very many places."""
        sets = F.collect_set("fp").alias("known"), F.collect_set(F.when(F.col("places") > hot, F.struct("fp", bits.alias("bits")))).alias("hot")
        return prints.select("fp", "row").join(repeated, "fp").groupBy(F.col("row").alias("key")).agg(*sets)

    def candidates(of: DataFrame, fps: DataFrame, maybe: KeyFilter, marked: bool) -> DataFrame:
        both = passing(of, maybe, True).join(fps, F.col("row") == F.col("key")).select("id", "row", "text", "known", "hot")
        return _windows(both, width, gram, marked)

    mine = materialize(known(own))
    maybe = KeyFilter.of(mine.select("key"), filter_bytes)
    windows = candidates(rows, mine, maybe, True)
    if history is not None and past is not None:
        theirs = materialize(known(past))
        windows = windows.unionByName(candidates(keyed(history), theirs, KeyFilter.of(theirs.select("key"), filter_bytes), False))
    runs = F.collect_list(F.struct("start", "n")).alias("__runs")
    marks = materialize(_verified(windows).distinct())
    if index is None:
        held.drop()
    marks = marks.groupBy(F.col("id").alias("__id"), F.col("row").alias("__key")).agg(runs)
    whole = docs.select(F.struct("*").alias("all"), key)
    inner = [F.col(f"all.`{c}`").alias(c) for c in docs.columns]
    clean = passing(whole, maybe, False).select(*inner, F.lit(None).cast("array<struct<start:int,n:int>>").alias("__runs"))
    rest = passing(whole, maybe, True).select(*inner, F.col("row").alias("__row"))
    joined = rest.join(marks, (F.col("__row") == F.col("__key")) & F.col(f"`{id}`").eqNullSafe(F.col("__id")), "left").drop("__id", "__key", "__row")

    def cut(batch: pa.RecordBatch) -> list:
        texts, sizes, gone = [], [], []
        for t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = split_words(t)
            sizes.append(len(words))
            if runs:
                cover = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    cover[r["start"]] += 1
                    cover[r["start"] + r["n"] + width - 1] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            gone.append(sizes[-1] - len(words))
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return [texts, sizes, gone]

    return map_texts(clean.unionByName(joined), [text, "__runs"], f"`{text}` string, n_words long, n_removed long", cut, drop=("__runs",))
