"""Near-duplicates in order of arrival: banded Hamming join and the greedy choice as a fix-point."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved


def bands(hash_: Column, blocks: int, keep: int, bits: int = 64) -> Column:
    """array<struct<band, value>>: the bits of every ``keep`` of ``blocks`` parts.

    Hashes that differ in at most ``blocks - keep`` bits agree in one of them.
    """
    sizes = [bits // blocks + (i < bits % blocks) for i in range(blocks)]
    lows = [sum(sizes[:i]) for i in range(blocks)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), keep)):
        value = F.lit(0).cast("long")
        for i in chosen:
            value = F.shiftleft(value, sizes[i]).bitwiseOR(F.shiftrightunsigned(hash_, lows[i]).bitwiseAND((1 << sizes[i]) - 1))
        out.append(F.struct(F.lit(n).alias("band"), value.alias("value")))
    return F.array(*out)


def banding(n: int, most: int, bits: int = 64) -> tuple[int, int]:
    """(blocks, keep) for n hashes: keys long enough that about 16 random hashes share one, in as few bands as that takes."""
    for extra in range(1, 5):
        if extra * bits // (most + extra) >= max(1, n).bit_length() - 4 or most + extra == bits:
            return most + extra, extra
    return most + 4, 4


def hamming_pairs(rows: DataFrame, most: int = 3, bits: int = 64, key: str = "id", hash_: str = "simhash") -> DataFrame:
    """(a, b): keys a < b whose hashes differ in at most ``most`` bits; hashes of 0 are left out.

    The join is of distinct hashes, so that many equal ones meet once; equal
    hashes pair each member with the first one only.  The more hashes there are,
    the longer are the keys that they are joined by.
    """
    live = rows.where(F.col(hash_) != 0).select(F.col(key).alias("k"), F.col(hash_).alias("h"))
    leaves = saved(live.groupBy("h").agg(F.min("k").alias("first")))
    blocks, keep = banding(leaves.count(), most, bits)
    x = leaves.select("h", "first", F.explode(bands(F.col("h"), blocks, keep, bits)).alias("b")).select("h", "first", "b.band", "b.value")
    y = x.select(F.col("h").alias("h2"), F.col("first").alias("first2"), "band", "value")
    near = x.join(y, ["band", "value"]).where((F.col("first") < F.col("first2")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= most))
    apart = near.select(F.col("first").alias("a"), F.col("first2").alias("b")).distinct()
    same = live.join(leaves, "h").where("first < k").select(F.col("first").alias("a"), F.col("k").alias("b"))
    return apart.unionByName(same)


def greedy_kept(rows: DataFrame, most: int = 3, key: str = "id", hash_: str = "simhash") -> DataFrame:
    """Keys that stay if rows come in order of key and each is dropped that is near one that has stayed.

    A row whose earlier neighbours are all dropped stays; one with an earlier
    neighbour that stays is dropped; the others wait for the next round.  Equal
    hashes are all dropped but the first one, whatever happens to it, for what
    drops it drops them.  Every round is written down.
    """
    live = rows.where(F.col(hash_) != 0).select(F.col(key).alias("k"), F.col(hash_).alias("h"))
    leaves = live.groupBy("h").agg(F.min("k").alias("k"))
    edges = saved(hamming_pairs(leaves.withColumnRenamed("k", "id").withColumnRenamed("h", "simhash"), most))
    later = edges.select(F.col("b").alias("k")).distinct()
    kept = leaves.select("k").join(later, "k", "left_anti")
    open_ = saved(later)
    kept = saved(kept)
    while not open_.isEmpty():
        dropped = saved(edges.join(kept.select(F.col("k").alias("a")), "a", "left_semi").select(F.col("b").alias("k")).distinct())
        open_ = open_.join(dropped, "k", "left_anti")
        edges = edges.join(dropped.select(F.col("k").alias("a")), "a", "left_anti").join(dropped.select(F.col("k").alias("b")), "b", "left_anti")
        waiting = edges.join(kept.select(F.col("k").alias("a")), "a", "left_anti").select(F.col("b").alias("k")).distinct()
        stay = saved(open_.join(waiting, "k", "left_anti"))
        kept = saved(kept.unionByName(stay))
        open_, edges = saved(open_.join(stay, "k", "left_anti")), saved(edges)
    zero = rows.where(F.col(hash_) == 0).select(F.col(key).alias("k"))
    return kept.unionByName(zero).withColumnRenamed("k", key)
