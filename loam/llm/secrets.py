"""Secret scans with built-in functions only, weighed by who owns copies of a candidate.

Three base patterns give spans.  Further candidates are long tokens that mix
digits and both cases.  Each candidate's hash is counted over the corpus by
distinct repositories and owners: what many owners hold is a widely copied
example, what few hold looks live, and such tokens are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_rules import let

#: Patterns of the base kinds, in order (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # maximal runs of 32 and more: the same spans as all runs, less the short ones
LIVE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "live"]
#: A candidate of more owners than this, or of more repositories, is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
#: Matches of a text that are folded together.
BLOCK = 256


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches whose ``group`` has ``least`` characters.

    The text between matches and the matches themselves give their places, in
    code points.  Texts without a match, which are most, are told by one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    # arrays_zip pads the matches by one, for the text behind the last.
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("whole"), values.alias("value")), lambda x: x["whole"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        row = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

    # A fold copies its array with each match, so matches are folded in blocks, whose own lengths then move them.
    begin = F.struct(F.lit(0).alias("at"), empty.alias("rows"))
    fold = lambda x: F.aggregate(x, begin, add)
    blocks = lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: fold(F.slice(x, i, BLOCK)))

    def moved(folded: Column) -> Column:
        before = F.aggregate(folded, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        shift = lambda rows, by: F.transform(rows, lambda r: F.struct((r["start"] + by).alias("start"), r["kind"].alias("kind"), (r["end"] + by).alias("end"), r["value"].alias("value")))
        return let(before, lambda starts: F.flatten(F.transform(folded, lambda b, i: shift(b["rows"], F.get(starts, i)))))

    rows = let(steps, lambda x: F.when(F.size(x) <= BLOCK, fold(x)["rows"]).otherwise(let(blocks(x), moved)))
    return F.when(text.rlike(pattern), rows).otherwise(empty)


def _spell(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", repository: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row for each row of ``docs``: (id, base, added, n_copied).

    ``base`` and ``added`` are arrays of (start, kind, end, value), by start and
    then kind, in code points, end exclusive.  ``added`` has the long tokens
    outside base spans that at most ``max_owners`` owners hold, in at most
    ``max_repositories`` repositories; ``n_copied`` counts the candidates, base
    ones included, that more hold.  The owner is the repository's name up to a
    slash; a null repository is one of its own, as is an empty one.

    A null text is empty and has no spans.  Texts are read whole at any length
    and number of matches.  Spans of two kinds at one place are all given, in the
    order of KINDS.  Repeated rows, with null ids or not, each come out, and
    count as one holder.  An empty table gives no rows.  Other columns are left
    out, so their names cannot clash.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_matches(t, 0, ASSIGN, 1, 8), _matches(t, 1, ACCESS, 0, 16), _matches(t, 2, HEX, 0, 32)))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    live = F.filter(_matches(t, 3, LIVE, 0, 20), lambda s: mixed(s["value"]))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.md5(t_of(text)), F.col(f"`{id}`")).alias("row"), F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit("")).alias("repository"), F.col(f"`{text}`").alias("text"))
    rows = materialize(rows.select("id", "row", "repository", base.alias("base"), live.alias("live")))
    apart = F.filter("live", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    some = rows.where((F.size("base") > 0) | (F.size("live") > 0)).select("id", "row", "repository", "base", apart.alias("live"))
    each = some.select("id", "row", "repository", F.explode(F.concat("base", "live")).alias("s")).select("id", "row", "repository", "s", F.sha2("s.value", 256).alias("hash"))
    owner = F.substring_index("repository", "/", 1).alias("owner")
    held = each.groupBy("hash", "repository").agg(F.count("*").alias("n")).groupBy("hash", owner).agg(F.count("*").alias("repositories")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    # Hashes are unique in ``held``, so Spark may split the rows of a very common one among tasks.
    weighed = each.join(held, "hash")
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    back = weighed.groupBy("id", "row").agg(
        F.array_sort(F.collect_set(F.when((F.col("s.kind") == 3) & ~copied, F.col("s")))).alias("added"),
        F.count_distinct(F.when(copied, F.col("s"))).alias("n_copied"),
    )
    back = back.select(F.col("id").alias("__id"), F.col("row").alias("__row"), "added", "n_copied")
    joined = some.join(back, (F.col("row") == F.col("__row")) & F.col("id").eqNullSafe(F.col("__id"))).select("id", "base", "added", "n_copied")
    none = rows.where((F.size("base") == 0) & (F.size("live") == 0)).select("id", "base", F.col("base").alias("added"), F.lit(0).cast("long").alias("n_copied"))
    return joined.unionByName(none).withColumnRenamed("id", id)


def t_of(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans spelled as kind:start:end."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.withColumns(
        {"n_assign": n(0), "n_access": n(1), "n_hex": n(2), "base_sha256": F.sha2(_spell(F.col("base")), 256), "spans": _spell(F.array_sort(F.concat("base", "added")))}
    )
