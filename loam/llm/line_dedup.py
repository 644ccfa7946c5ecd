"""Line dedup over sharded cuckoo filters that exact reference counts back.

The exact table counts, for each line key, the documents that hold it.  Filters
by shard hold the keys that have reached the threshold; inserting or deleting
documents moves keys in and out of them, so dedup can be undone.  Documents are
filtered in one map, group of filters by group: a line whose key no filter knows
stays, without a shuffle.  The few keys that a filter takes for others are found
in the exact table first and spared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo
from .common import GATHERED_BYTES, TEXT_BYTES, forget, gathered, long_rows, map_texts, materialize, slices, tidied

#: Bound of one broadcast: filters of about 12 million lines that are to go.  More filters make more broadcasts, which tasks read in turns.
MAX_FILTER_BYTES = 64 << 20
KEYS_PER_SHARD = 1 << 16
_SPACES = b"\x20\t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """16 bytes of BLAKE2b over the line without outer white space, A-Z lower-cased; none for an empty key."""
    line = line.strip(_SPACES).lower()
    return hashlib.blake2b(line, digest_size=16).digest() if line else b""


def _keys(text: str | None) -> list[bytes]:
    return [line_key(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n): number of documents, which are rows, with each non-empty line key.  Batches are counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(set(_keys(t)))
            seen.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    return long_rows(docs.select(F.col(f"`{text}`").alias("t"))).mapInArrow(tidied(count), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class LineIndex:
    """Reference counts and filters of the documents so far.  Every change gives a new index; the old one stays valid.

    Every row is a document, so repeated rows count as often as they come,
    whatever their ids.  Null and empty texts, and lines of white space, have no
    keys.  Texts are read whole at any length; a line of any length has one key.
    An empty table changes nothing.  Other columns are not looked at.
    """

    def __init__(self, spark: SparkSession, threshold: int = 10, max_filter_bytes: int = MAX_FILTER_BYTES) -> None:
        self.spark, self.threshold, self.max_filter_bytes = spark, threshold, max_filter_bytes
        self.counts = spark.createDataFrame([], "key binary, n long")
        self.filters = spark.createDataFrame([], "shard int, payload binary")
        self.shards = 0

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(line_counts(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Undo ``insert`` of the same documents."""
        return self._changed(line_counts(docs, text).select("key", (-F.col("n")).alias("n")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        out = LineIndex(self.spark, self.threshold, self.max_filter_bytes)
        both = self.counts.withColumn("old", F.col("n")).unionByName(delta.withColumn("old", F.lit(0).cast("long"))) if self.shards else delta.withColumn("old", F.lit(0).cast("long"))
        merged = materialize(both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("old").alias("old")))
        out.counts = merged.where("n > 0").select("key", "n")
        frequent = merged.where(F.col("n") >= self.threshold).count()
        out.shards = max(1, self.shards, 1 << (max(0, frequent // KEYS_PER_SHARD)).bit_length())
        if out.shards == self.shards:
            out.filters = self._moved(merged)
        else:
            out.filters = self._built(merged.where(F.col("n") >= self.threshold), out.shards)
        out.filters = materialize(out.filters)
        return out

    def _built(self, keys: DataFrame, shards: int) -> DataFrame:
        def build(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            first, second = _halves(list(pdf["key"]))
            table = cuckoo.build(first.tolist(), second.tolist()).table
            return pd.DataFrame({"shard": [int(cuckoo.shard_of(first[:1], shards)[0])], "payload": [table.tobytes()]})

        return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, payload binary")

    def _moved(self, merged: DataFrame) -> DataFrame:
        """Filters after the keys that crossed the threshold went in or out; a filter that is too full is built anew."""
        shards, threshold = self.shards, self.threshold
        up = (F.col("n") >= threshold) & (F.col("old") < threshold)
        down = (F.col("n") < threshold) & (F.col("old") >= threshold)
        moves = merged.where(up | down).select(_shard(shards).alias("shard"), "key", up.alias("up"))
        kept = merged.where((F.col("n") >= threshold)).select(_shard(shards).alias("shard"), "key", F.lit(None).cast("boolean").alias("up"))
        touched = moves.select("shard").distinct()
        rows = moves.unionByName(kept.join(touched, "shard", "left_semi"))

        def move(key, pdf, old):  # noqa: ANN001, ANN202
            import pandas as pd

            if pdf.empty:
                return old[["shard", "payload"]]
            change, now = pdf[pdf["up"].notna()], pdf[pdf["up"].isna()]
            table = np.frombuffer(old["payload"].iloc[0], np.uint32).reshape(-1, cuckoo.SLOTS).copy() if len(old) else np.zeros((2, cuckoo.SLOTS), np.uint32)
            held = cuckoo.CuckooFilter(len(table))
            held.table = table
            fine = True
            for k, is_up in sorted(zip(change["key"], change["up"], strict=True), key=lambda x: x[1]):
                first, second = (int.from_bytes(k[i : i + 8], "little") for i in (0, 8))
                fine = fine and (held.insert(first, second) if is_up else held.delete(first, second))
            if not fine:
                first, second = _halves(list(now["key"])) if len(now) else (np.zeros(0, np.uint64),) * 2
                held = cuckoo.build(first.tolist(), second.tolist())
            return pd.DataFrame({"shard": [int(key[0])], "payload": [held.table.tobytes()]})

        return rows.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(move, "shard int, payload binary")

    def _broadcast(self) -> list[Broadcast]:
        """The filters in groups of at most ``max_filter_bytes``, or one filter; the driver holds one group at a time."""
        sizes = self.filters.select("shard", F.length("payload").alias("n")).orderBy("shard").collect()  # one row a filter
        groups, held = [[]], 0
        for r in sizes:
            if groups[-1] and held + r["n"] > self.max_filter_bytes:
                groups, held = [*groups, []], 0
            groups[-1].append(r["shard"])
            held += r["n"]
        out = []
        for g in groups:
            tables = {r["shard"]: np.frombuffer(r["payload"], np.uint32).reshape(-1, cuckoo.SLOTS) for r in self.filters.where(F.col("shard").isin(g)).collect()}
            out.append(self.spark.sparkContext.broadcast(cuckoo.ShardedFilter(max(1, self.shards), tables)))
        return out

    def strip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` without the lines whose key is in ``threshold`` documents or more of those inserted: text, n_lines, n_dropped.

        ``docs`` may be others than those inserted.  A null text is one empty
        line, and comes out as an empty text.  Lines with an empty key stay.  An
        empty table gives no rows.  Other columns pass through; those named
        n_lines or n_dropped, in any case, are replaced.
        """
        held = self._broadcast()

        def known(keys: list[bytes]) -> np.ndarray:
            out = np.zeros(len(keys), bool)
            for group in held if keys else ():
                out |= group.value.contains(*_halves(keys))
                if len(held) > 1:
                    forget(group)
            return out

        size = GATHERED_BYTES if len(held) > 1 else TEXT_BYTES

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in (gathered(batches, size) if len(held) > 1 else batches) for part in slices(whole, size)):
                keys = sorted({k for t in batch.column(0).to_pylist() for k in _keys(t) if k})
                yield pa.RecordBatch.from_arrays([pa.array([k for k, x in zip(keys, known(keys).tolist(), strict=True) if x], pa.binary())], names=["key"])

        # Keys that a filter takes for frequent ones: about 1 in 10^9 of the distinct ones.
        told = long_rows(docs.select(F.col(f"`{text}`").alias("t"))).mapInArrow(tidied(hits), "key binary").distinct()
        false = told.join(self.counts.where(F.col("n") >= self.threshold), "key", "left_anti")
        spared = self.spark.sparkContext.broadcast({bytes(r["key"]) for r in false.collect()})

        def strip(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            lines = [t.split("\n") for t in texts]
            keys = [_keys(t) for t in texts]
            gone = iter(known([k for ks in keys for k in ks if k]).tolist())
            kept = [[x for x, k in zip(xs, ks, strict=True) if not (k and next(gone) and k not in spared.value)] for xs, ks in zip(lines, keys, strict=True)]
            return [["\n".join(x) for x in kept], [len(x) for x in lines], [len(x) - len(y) for x, y in zip(lines, kept, strict=True)]]

        return map_texts(docs, [text], f"`{text}` string, n_lines long, n_dropped long", strip, text_bytes=size, gather=len(held) > 1)


def _shard(shards: int):  # noqa: ANN202
    """Shard of a binary key, as ``cuckoo.shard_of`` has it: bits 40 to 63 of its first half, little-endian."""
    number = F.conv(F.concat(F.hex(F.substring(F.col("key"), 8, 1)), F.hex(F.substring(F.col("key"), 7, 1)), F.hex(F.substring(F.col("key"), 6, 1))), 16, 10)
    return F.pmod(number.cast("long"), F.lit(shards)).cast("int")
