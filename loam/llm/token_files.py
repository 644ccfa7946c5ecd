"""Token ids in Simple-8b files: 64-bit words of a 4-bit selector and 60 bits of ids.

A file is a Spark-written table of chunks, so that writes commit whole and can
be retried anywhere.  A chunk's payload is::

    magic "LS8B"  u32 documents  u64 ids  u32 blocks
    u32 ids of each document            (documents)
    u64 offset in words of each block   (blocks + 1)
    u64 words

Every block has ``BLOCK`` ids (the last one fewer) and starts a new word, so
that blocks can be decoded alone.  Selectors say how many ids of how many bits
a word holds; ids of over 30 bits are escapes with a word of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_rows, tidied
from .tokens import BATCH, encoder

#: (ids in a word, bits of each) by selector; selector 0 is the escape.
SELECTORS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
BLOCK = 1 << 12
TOGETHER = BLOCK << 7  # ids whose blocks are encoded together
CHUNK = 1 << 20  # ids after which a chunk ends
HEAD = struct.Struct("<4sIQI")
_WIDTH = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def encode_blocks(ids: np.ndarray) -> list[np.ndarray]:
    """Words of each block of ids.  From its start on, each word takes the most ids that fit; blocks advance together."""
    n, pad = len(ids), int(COUNTS.max())
    lanes = -(-n // BLOCK)
    grid = np.zeros((lanes, BLOCK + pad), np.uint32)
    full = n // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    flat = np.concatenate([grid.ravel(), np.zeros(pad, np.uint32)])
    width = _WIDTH[flat & 0xFFFF]
    if (high := flat >> 16).any():
        width = np.where(high > 0, 16 + _WIDTH[high], width)
    n, widest = grid.size, {1: width}  # of 1, 2, 4 ... ids from each on
    best = np.zeros(n, np.uint8)
    for s, (count, bits) in enumerate(SELECTORS[1:], 1):
        half = 1 << (count.bit_length() - 1)
        if half not in widest:
            w = widest[half // 2]
            widest[half] = np.maximum(w[: -(half // 2)], w[half // 2 :])
        w = widest[half]
        fits = np.maximum(w[:n], w[count - half : count - half + n]) <= bits
        np.maximum(best, fits.view(np.uint8) * np.uint8(s), out=best)
    sizes = np.full(lanes, BLOCK)
    sizes[full:] = len(ids) - full * BLOCK
    at = np.arange(lanes) * grid.shape[1]
    ends, steps = at + sizes, []
    step = COUNTS[best]
    while len(at):
        steps.append(at)
        at = at + step[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    at = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    selector = best[at]
    words = selector.astype("<u8") << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            taken = flat[at[mine][:, None] + np.arange(count)].astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(taken << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return np.split(words, np.searchsorted(at, np.arange(1, lanes) * grid.shape[1])) if lanes else []


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive blocks, whose words begin at ``offsets``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    ends = np.cumsum(count)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.concatenate([[0], ends])[offsets[:-1]]
    at = ends - count - before[block] + block * BLOCK  # what a block's last word has in excess is overwritten or cut
    out = np.zeros(n + BLOCK + int(COUNTS.max()), np.uint32)
    last = np.zeros(len(words), bool)
    last[offsets[1:] - 1] = True
    for pick in (last, ~last):
        for s, (c, bits) in enumerate(SELECTORS):
            mine = np.flatnonzero((selector == s) & pick)
            if len(mine):
                spread = np.arange(c)
                out[at[mine][:, None] + spread] = (words[mine][:, None] >> (spread.astype(np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    return out[:n]


def encode_chunk(documents: list[bytes]) -> bytes:
    """Payload of documents, each its ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    blocks = [b for i in range(0, len(ids), TOGETHER) for b in encode_blocks(ids[i : i + TOGETHER])]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    sizes = np.array([len(d) // 4 for d in documents], "<u4")
    return b"".join([HEAD.pack(b"LS8B", len(documents), len(ids), len(blocks)), sizes.tobytes(), offsets.tobytes(), *(b.tobytes() for b in blocks)])


def decode_chunk(payload: bytes) -> list[np.ndarray]:
    """Ids of each document."""
    magic, n_docs, n_ids, n_blocks = HEAD.unpack_from(payload)
    if magic != b"LS8B":
        raise ValueError("not a token chunk")
    at = HEAD.size
    sizes = np.frombuffer(payload, "<u4", n_docs, at)
    at += sizes.nbytes
    offsets = np.frombuffer(payload, "<u8", n_blocks + 1, at).astype(np.int64)
    at += offsets.nbytes
    words = np.frombuffer(payload, "<u8", int(offsets[-1]), at)
    ids = decode_blocks(words, offsets, n_ids)
    return np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]) if n_docs else []


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, ascending by id, as token files under ``path``.

    A null text is an empty one, which leaves the end id alone; a text of any
    length is one document.  Null ids come first; rows with the same id are
    ordered by a hash of their text, and rows that repeat each other are written
    as often as they come.  An empty table gives files without documents.  Other
    columns are left out, so their names cannot clash.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType().add("shard", "long").add("chunk", "integer").add("local_start", "long").add("n_ids", "long").add("doc_ids", T.ArrayType(kind)).add("payload", "binary")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encode = to_arrow_schema(schema), encoder(tokenizer).encode
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        raws: list[bytes] = []
        held, end = 0, end_id.to_bytes(4, "little")

        def chunk() -> pa.RecordBatch:
            nonlocal number, start, held
            row = [[shard], [number], [start], [held], [list(keys)], [encode_chunk(raws)]]
            number, start, held = number + 1, start + held, 0
            keys.clear()
            raws.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    raws.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= CHUNK:
                        yield chunk()
        if keys:
            yield chunk()

    rows = docs.select(F.col(f"`{id}`").alias("k"), F.col(f"`{text}`").alias("t"))
    order = ["k", F.xxhash64("t")]
    long_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(chunks), schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of token files: (id, start, n_tokens, ids_crc32[, ids array<long>]).

    ``start`` counts the ids of all documents before.  Totals by shard, one
    number for each partition of the writer, go through the driver.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for r in totals:
        before[r["shard"]], total = total, total + r["n"]
    kind = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField(id, kind)]).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    schema = schema.add("ids", T.ArrayType(T.LongType())) if with_ids else schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for shard, local, keys, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_chunk(payload)
                sizes = np.array([len(x) for x in ids], np.int64)
                columns = [keys, before[shard] + local + np.cumsum(sizes) - sizes, sizes, [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
                columns += [[x.astype(np.int64) for x in ids]] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return table.select("shard", "local_start", "doc_ids", "payload").mapInArrow(tidied(decode), schema)
