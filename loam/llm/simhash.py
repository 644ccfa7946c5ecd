"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie.  Node pairs are
traversed together, level by level, with the bits that differ so far; a pair is
pruned once they exceed the budget.  The join is distributed by the pigeonhole
principle: of ``budget + 1`` blocks of bits one must agree, so each task has the
tries of its block values.  The fingerprints of a block value that has very many
are dealt again by the same principle, over the bits that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, materialize, tidied

#: Fingerprints of a trie beyond which they are dealt again, so many times at most.
CELL, LEVELS = 50_000, 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned SimHash of the text's word shingles; 0 if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with simhash (long, two's complement), less the columns ``drop``.  A null text has no words."""

    def each(batch: pa.RecordBatch) -> list:
        return [np.array([fingerprint(t, width) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)]

    return map_texts(docs, [text], "simhash long", each, drop)


def trie_pairs(values: np.ndarray, groups: np.ndarray, bits: int, budget: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the same group whose values differ in at most ``budget`` bits.

    ``values`` are sorted within ``groups`` and distinct there.  A node is an interval of sorted
    values with a common prefix; pairs of nodes descend together from bit ``bits - 1`` down.
    """
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), bits - 1)]
    while stack:
        a, b, c, d, err, bit = stack.pop()
        if len(a) > chunk:
            half = len(a) // 2
            stack += [tuple(x[s] for x in (a, b, c, d, err)) + (bit,) for s in (slice(half), slice(half, None))]
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            real = i != j
            i, j = i[real], j[real]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a, b, c, d, err = (x[~single] for x in (a, b, c, d, err))
        if not len(a) or bit < 0:
            continue
        one = np.uint64(1 << bit)
        same = a == c
        m, k = _split(values, a, b, one), _split(values, c, d, one)
        parts = [(a, m, c, k, err), (m, b, k, d, err), (a, m, k, d, err + 1), (m[~same], b[~same], c[~same], k[~same], err[~same] + 1)]
        a, b, c, d, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (b > a) & (d > c) & (err <= budget) & ~((a == c) & (b - a == 1))
        stack.append((a[live], b[live], c[live], d[live], err[live], bit - 1))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, one: np.uint64) -> np.ndarray:
    """First place of each sorted interval, whose higher bits agree, at which the bit is set."""
    lo, end = lo.copy(), hi.copy()
    while (open_ := lo < end).any():
        mid = (lo + end) // 2
        has = (values[np.minimum(mid, len(values) - 1)] & one) > 0
        end = np.where(open_ & has, mid, end)
        lo = np.where(open_ & ~has, mid + 1, lo)
    return lo


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n nodes is linked to; pairs are merged as they come.

    Only roots are re-pointed: a member follows its root, so what earlier pairs linked stays linked.
    """
    root = np.arange(n)
    for i, j in pairs:
        while True:
            u, v = root[i], root[j]
            before = root.copy()
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while True:
                next_ = root[root]
                if (next_ == root).all():
                    break
                root = next_
            if (root == before).all():
                break
    return root


def _deal(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """Rows (path, rest, simhash) once for each block of the ``width`` bits of rest: the path grows by the block, rest loses it."""
    sizes = [width // blocks + (i < width % blocks) for i in range(blocks)]
    out, low = [], 0
    for i, size in enumerate(sizes):
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << size) - 1)
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low) if low + size < 64 else F.lit(0).cast("long")
        path = F.xxhash64("path", F.lit(i), value)
        out.append(F.struct(path.alias("path"), above.bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1)).alias("rest")))
        low += size
    return rows.select("simhash", F.explode(F.array(*out)).alias("x")).select("x.path", "x.rest", "simhash")


def links(prints: DataFrame, budget: int = 2, cell: int = CELL) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column simhash) that join the same ones as all pairs within ``budget`` bits.

    A task gives a spanning forest of the pairs it finds: no pair is lost to
    the components, and a dense group gives no more links than it has members.
    Paths of blocks are hashed; should two of them meet, their fingerprints are
    compared in vain.
    """
    blocks, width, parts = budget + 1, 64, []
    rows = prints.select(F.lit(0).cast("long").alias("path"), F.col("simhash").alias("rest"), "simhash")
    for level in range(LEVELS):
        rows = materialize(_deal(rows, width, blocks))
        counts = materialize(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        hot, last = counts.where(F.col("n") > cell).select("path"), level == LEVELS - 1 or width < 4 * blocks
        parts.append(rows.join(counts.where(F.lit(last) | (F.col("n") <= cell)).select("path"), "path").select("path", "simhash"))
        if last or hot.isEmpty():
            break
        rows, width = rows.join(hot, "path"), width - width // blocks - 1
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def solve(path: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[True], path[1:] != path[:-1]]))
            root = _forest(len(value), trie_pairs(value, group, 64, budget))
            moved = np.flatnonzero(root != np.arange(len(value)))
            return pa.RecordBatch.from_arrays([pa.array(value[moved].view(np.int64)), pa.array(value[root[moved]].view(np.int64))], names=["u", "v"])

        n, most = 0, 1 << 20
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n < most:
                continue
            path, value = (np.concatenate(x) for x in zip(*held, strict=True))
            other = np.flatnonzero(path != path[-1])  # the last path may go on in the next batch
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solve(path[:cut], value[:cut])
            held, n = [(path[cut:], value[cut:])], len(path) - cut
            most = max(1 << 20, 2 * n)
        if n:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    # Fingerprints are compared as unsigned bits: flipping the top one makes Spark's order that of the trie.
    order = F.col("simhash").bitwiseXOR(F.lit(-(1 << 63)))
    return dealt.repartition("path").sortWithinPartitions("path", order).mapInArrow(tidied(join), "u long, v long")


def classes(prints: DataFrame, budget: int = 2, cell: int = CELL) -> DataFrame:
    """(simhash, n, component_id) of rows (id, simhash): each fingerprint's rows, and the smallest id of its class.

    ``id`` may be of any type that has an order, a struct too.
    """
    leaves = materialize(prints.groupBy("simhash").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    linked = components(links(leaves.select("simhash"), budget, cell))
    own = leaves.join(linked, leaves["simhash"] == linked["node"], "left").select("simhash", "first", "n", F.coalesce("root", "simhash").alias("root"))
    own = materialize(own)
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(own.join(least, "root").select("simhash", "n", "component_id"))


def cluster(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2, cell: int = CELL) -> DataFrame:
    """(id, simhash, component_id): component_id is the smallest id whose fingerprint can be reached by links.

    Fingerprints link if they differ in at most ``budget`` bits; texts without
    a word have fingerprint 0 and link like any other: null and empty texts are
    near-duplicates of each other.  Texts are read whole at any length.  Null ids
    are never the smallest unless all are null.  Repeated rows each come out, in
    the same class; an empty table gives no rows.  Other columns are left out, so
    their names cannot clash.  One row for each row of ``docs``.
    """
    prints = materialize(fingerprints(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", width, ("text",)))
    found = classes(prints, budget, cell)
    # Fingerprints of over 1/1000 of all rows are 1000 at most: they are broadcast, so that no task gets a hot one's rows.
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") * 1000 > total)
    near = prints.join(F.broadcast(hot.select("simhash")), "simhash", "left_anti")
    common = prints.join(F.broadcast(hot.select("simhash", "component_id")), "simhash")
    rest = near.join(found.select("simhash", "component_id"), "simhash")
    return common.select("id", "simhash", "component_id").unionByName(rest.select("id", "simhash", "component_id")).withColumnRenamed("id", id)
