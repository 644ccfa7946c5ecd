"""What the training-data operators share: shared-folder tables, row-wise Arrow maps, linked components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Where none is set, a temporary one on a local master, as in tests; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, deleted when the driver ends if not before."""
    path = f"{shared_folder(spark)}/loam-{name}-{uuid.uuid4().hex}"
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: one computation, no lineage, safe from lost executors.

    Without a ``path`` its files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def text_key(text_column: str) -> Column:
    """Key of a text by content; a null text is an empty one."""
    return F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))


Columns = list[list | pa.Array]

#: Bytes of texts that a map works on at a time; one longer text is worked on alone.
TEXT_BYTES = 4 << 20


#: Bytes of texts that pass several broadcast parts together, each part read once for all of them.
GATHERED_BYTES = 16 << 20


def forget(held: Broadcast) -> None:
    """Let a worker's copy of a broadcast value go; its next use reads it from the executor's disk again."""
    if getattr(held, "_path", None):
        held.__dict__.pop("_value", None)


#: Rows of texts that go to Python workers at a time; Spark's own default suits short rows.
ROWS_AT_A_TIME = 2000


def long_rows(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand texts over in small batches, unless it does already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_AT_A_TIME:
        conf.set(key, str(ROWS_AT_A_TIME))
    return df


def _trim() -> None:
    """Give memory that is free back to the machine: a worker idles between tasks with all it has kept."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving memory back after each batch and at its end."""

    def inner(batches: Batches) -> Batches:
        def watched() -> Batches:
            for batch in batches:
                yield batch
                del batch
                _trim()

        yield from run(watched())
        _trim()

    return inner


def slices(batch: pa.RecordBatch, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``size`` bytes in the first column, if it has texts, or else the whole."""
    if not pa.types.is_string(batch.schema.types[0]) and not pa.types.is_large_string(batch.schema.types[0]):
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def gathered(batches: Batches, size: int = TEXT_BYTES) -> Batches:
    """Batches put together until the first column, which is text, has ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


def map_texts(docs: DataFrame, inputs: Sequence[str], added: T.StructType | str, each: Callable[[pa.RecordBatch], Columns], drop: Sequence[str] = (), text_bytes: int = TEXT_BYTES, gather: bool = False) -> DataFrame:
    """Rows of ``docs`` with further columns, worked out by ``each`` from Arrow batches of ``inputs``.

    A call has at most ``text_bytes`` of the first input, if that is text; with
    ``gather`` batches are put together until they have about as much.  All
    other columns pass through.  A column whose name (in any case) is that
    of an added one is replaced by it.
    """
    added = T.StructType.fromDDL(added) if isinstance(added, str) else added
    new = {f.name.lower() for f in added}
    rest = [f for f in docs.schema if f.name.lower() not in new and f.name not in drop]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rest] + list(added))
    wanted = [F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]
    passed = [F.col(f"`{f.name}`").alias(f"__out{i}") for i, f in enumerate(rest)]
    k, names = len(inputs), schema.names
    types = T.StructType(list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(types)]
        for batch in (part for whole in (gathered(batches, text_bytes) if gather else batches) for part in slices(whole, text_bytes)):
            made = each(pa.RecordBatch.from_arrays(batch.columns[:k], names=list(inputs)))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[k:], *made], names=names)

    return long_rows(docs.select(*wanted, *passed)).mapInArrow(tidied(run), schema)


class KeyFilter:
    """A Bloom filter of fixed size over 64-bit keys: a key that it does not have is in no table it was made of.

    It only spares rows a shuffle.  With very many keys all rows pass, and
    results are the same.
    """

    PAGE = 8192

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        h = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            return [(((h * np.uint64(m)) >> np.uint64(20)) % np.uint64(size)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    @staticmethod
    def of(keys: DataFrame, size_bytes: int) -> KeyFilter:
        size, page = size_bytes * 8, KeyFilter.PAGE
        if keys.count() > size // 2:
            return KeyFilter(np.full(size_bytes, 255, np.uint8))  # too many keys to tell any apart

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size, bool)
            for batch in batches:
                for p in KeyFilter.places(batch.column(0).to_numpy(), size):
                    bits[p] = True
            packed = np.packbits(bits).reshape(-1, page)
            used = np.flatnonzero(packed.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["page", "bits"])

        def join(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            both = np.zeros(page, np.uint8)
            for b in pdf["bits"]:
                both |= np.frombuffer(b, np.uint8)
            return pd.DataFrame({"page": pdf["page"][:1], "bits": [both.tobytes()]})

        pages = keys.repartition(32).mapInArrow(mark, "page long, bits binary").groupBy("page").applyInPandas(join, "page long, bits binary")
        bits = np.zeros(size_bytes, np.uint8)
        for r in pages.collect():  # size_bytes in all
            bits[r["page"] * page : (r["page"] + 1) * page] = np.frombuffer(r["bits"], np.uint8)
        return KeyFilter(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys, len(self.bits) * 8):
            out &= (self.bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def passing(rows: DataFrame, maybe: KeyFilter, inside: bool, key: str = "row") -> DataFrame:
    """Rows whose key the filter has, or has not."""
    held = rows.sparkSession.sparkContext.broadcast(maybe)

    @F.pandas_udf(T.BooleanType())
    def has(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(held.value.has(keys.to_numpy()))

    test = has(key)
    return rows.where(test if inside else ~test)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the smallest node that can be reached.

    Alternating large-star and small-star steps on tables; each step is written
    to the shared folder.  Minima are combined before they are shuffled, and the
    joins that follow have unique right sides, so Spark may split a hub's rows.
    """
    spark, paths = edges.sparkSession, []

    def stored(df: DataFrame) -> DataFrame:
        paths.append(new_folder(spark, "links"))
        return materialize(df, paths[-1])

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        while len(paths) > 1:  # what only earlier rounds read
            delete_folder(spark, paths.pop(0))
        if state[0] == 0 or state == last:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
