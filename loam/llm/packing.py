"""Best-fit packing of tokenized documents into sequences of fixed length.

Each partition packs its own pieces with a bounded number of open bins, kept in
a bitset keyed by free space.  Bins that the partition leaves with room are
packed together afterwards, by groups of partitions, then groups of groups,
until one group is left; only their fill levels move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_rows, materialize, tidied
from .tokens import BATCH, encoder

OPEN_BINS = 4096
WINDOW = 8192  # pieces that are put in order of length at a time
FAN_IN = 32  # partitions whose open bins are packed together


class BestFit:
    """At most ``limit`` open bins of ``size``; a full bin closes, and the fullest one when there are too many."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit, self.made, self.n = size, limit, 0, 0
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.closed: list[int] = []

    def _take(self, room: int) -> int:
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.n -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin, and the place in it, of a piece of 0 < length <= size."""
        fits = self.free >> length
        if fits:
            room = (fits & -fits).bit_length() - 1 + length
            found = self._take(room)
        else:
            room, found = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            if self.n >= self.limit:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            self.bins[left].append(found)
            self.free |= 1 << left
            self.n += 1
        else:
            self.closed.append(found)
        return found, self.size - room

    def open_bins(self) -> set[int]:
        return {b for held in self.bins for b in held}


def pieces_of(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else pieces of ``size`` behind a first one of the rest."""
    first = n if n <= size else n % size or size
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text", with_ids: bool = False, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents and their places: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document is its text's ids and then ``end_id``; a null text is an empty
    one, which leaves the end id alone.  Longer ones than a sequence are cut,
    whatever their length.  Repeated rows are packed once each, with or without
    ids; among bins of equal room any may be chosen.  ``with_ids`` adds the ids as
    little-endian unsigned 32-bit integers.  Other columns are left out, so their
    names cannot clash.  No documents: no rows.

    Pieces are put in order of length ``WINDOW`` at a time before they are
    placed; a bin that is still open at a partition's end goes on to
    :func:`merge`, so that partitions do not leave room behind.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("bin", "long").add("offset", "long").add("open", "boolean")
    schema = schema.add("ids", "binary") if with_ids else schema

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, mine = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        fit, encode = BestFit(size, open_bins), encoder(tokenizer).encode
        waiting: list[tuple] = []
        placed: dict[int, list[tuple]] = {}

        def flush(bins: list[int] | set[int], is_open: bool) -> Iterator[pa.RecordBatch]:
            rows = [(*row, mine + b, offset, is_open, *ids) for b in bins for (*row, ids, offset) in placed.pop(b)]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096], strict=True), arrow, strict=True)], schema=arrow)

        def place() -> None:
            for row in sorted(waiting, key=lambda r: -r[3]):
                b, offset = fit.place(row[3])
                placed.setdefault(b, []).append((*row, offset))
            waiting.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = batch.slice(i, BATCH)
                for key, raw in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    raw += end_id.to_bytes(4, "little")
                    for k, (start, length) in enumerate(pieces_of(len(raw) // 4, size)):
                        part = raw[4 * start : 4 * (start + length)]
                        waiting.append((key, k, start, length, zlib.crc32(part), (part,) if with_ids else ()))
                if len(waiting) >= WINDOW:
                    place()
                    yield from flush(fit.closed, False)
                    fit.closed.clear()
        place()
        roomy = fit.open_bins()
        yield from flush([b for b in placed if b not in roomy], False)
        yield from flush(roomy, True)

    first = materialize(long_rows(docs.select(F.col(f"`{id}`").alias("k"), F.col(f"`{text}`").alias("t"))).mapInArrow(tidied(phase1), schema))
    shut = first.where(~F.col("open")).withColumnRenamed("bin", "sequence_id").drop("open")
    left = first.where("open")
    places = merge(left.groupBy("bin").agg(F.sum("length").alias("fill")), size, open_bins)
    moved = left.join(places, "bin").withColumn("offset", F.col("offset") + F.col("base"))
    columns = [F.col(f"`{c}`") for c in (id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))]
    return shut.select(columns).unionByName(moved.select(columns))


def merge(bins: DataFrame, size: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Places of part-filled bins (bin, fill) in common ones: (bin, sequence_id, base).

    A round packs the bins of ``FAN_IN`` partitions in one task; what it leaves
    open goes to the next round, with groups ``FAN_IN`` times as large.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        out: list[tuple] = []
        for g in sorted({r[0] for r in rows}):
            fit, made = BestFit(size, open_bins), {}
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
            for _, b, fill in mine:
                into, base = fit.place(fill)
                out.append([b, made.setdefault(into, b), base, into])
            roomy = fit.open_bins()
            for row in out[-len(mine) :]:
                row[3] = row[3] in roomy
        names = ["bin", "sequence_id", "base", "roomy"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.bool_() if i == 3 else pa.int64()) for i in range(4)], names=names)

    def round_(bins: DataFrame, span: int) -> DataFrame:
        g = F.shiftright("bin", 32 + span)
        return materialize(bins.select(g.cast("long").alias("g"), "bin", "fill").repartition("g").mapInArrow(group, "bin long, sequence_id long, base long, roomy boolean"))

    bins = materialize(bins)
    most = bins.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    span = (FAN_IN - 1).bit_length()
    found = round_(bins, span)
    fills = found.join(bins, "bin")
    while most >> span:
        span += (FAN_IN - 1).bit_length()
        again = fills.where("roomy").groupBy(F.col("sequence_id").alias("bin")).agg(F.max(F.col("base") + F.col("fill")).alias("fill"))
        step = round_(again, span)
        grown = step.join(again, "bin").select(F.col("bin").alias("old"), F.col("sequence_id").alias("new"), F.col("base").alias("more"), F.col("roomy").alias("still"))
        found = materialize(
            found.join(grown, F.col("sequence_id") == F.col("old"), "left").select(
                "bin", F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"), F.coalesce("still", F.lit(False)).alias("roomy")
            )
        )
        fills = found.join(bins, "bin")
    return found.select("bin", "sequence_id", "base")
