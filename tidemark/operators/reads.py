"""Reads over a mutation log or over runs: pure functions from DataFrame to DataFrame.

Input rows have k, seq, tomb, v.  The snapshot filter comes before the reduction,
the tombstone filter after it; key filters commute with it and are pushed to the
scan.  The reduction is max_by over (tomb, v), with partial aggregation before
the shuffle, so a hot key sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bounds import in_bounds, text_prefix_end


def newest(rows: DataFrame, snapshot: int | None = None, *by: str, tier: str | None = None) -> DataFrame:
    """The newest visible version of each key (per `by` columns), tombstones included; equal seq goes to the higher `tier`."""
    seen = rows if snapshot is None else rows.where(F.col("seq") <= snapshot)
    order = F.struct("seq", tier) if tier else F.col("seq")
    best = seen.groupBy(*by, "k").agg(F.max_by(F.struct("seq", "tomb", "v"), order).alias("x"))
    return best.select(*by, "k", "x.*")


def live(rows: DataFrame, snapshot: int | None = None) -> DataFrame:
    return newest(rows, snapshot).where(~F.col("tomb")).select("k", "v", "seq")


def scan(rows: DataFrame, start=None, end=None, snapshot: int | None = None) -> DataFrame:
    """Live rows with start <= k < end in byte order."""
    return live(rows.where(in_bounds(F.col("k"), start, end)), snapshot).orderBy("k")


def scan_prefix(rows: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return live(rows.where(F.col("k").startswith(prefix)), snapshot).orderBy("k")


def scan_prefix_as_range(rows: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return scan(rows, prefix or None, text_prefix_end(prefix), snapshot)


def get(rows: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    return live(rows.where(F.col("k") == F.lit(key)), snapshot)


def multi_get(rows: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live rows of the keys in column k of `keys`, reduced after a semi join, so other keys are never shuffled twice."""
    return live(rows.join(keys.select("k").distinct(), "k", "left_semi"), snapshot)


#: Sequence numbers (or times) of one key that a task sorts together; with unique numbers no more rows of it either.
SPAN = 1 << 20


def history(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Every version, numbered from the newest.

    A key's versions are numbered within ranges of `span` sequence numbers, and
    counts of its newer ranges are added, so a hot key is spread over tasks."""
    ranged = rows.withColumn("__range", F.floor(F.col("seq") / span))
    newer = Window.partitionBy("k").orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("k", "__range").agg(F.count("*").alias("__n"))
    before = counts.select("k", "__range", F.coalesce(F.sum("__n").over(newer), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("k", "__range").orderBy(F.desc("seq")))
    numbered = ranged.withColumn("version", within).join(before, ["k", "__range"])
    return numbered.select(*rows.columns, (F.col("version") + F.col("__before")).alias("version"))


def merge_stream(*sources: DataFrame) -> DataFrame:
    """All versions of all sources by key, newest first; nothing is dropped."""
    merged = sources[0].withColumn("source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        merged = merged.unionByName(s.withColumn("source", F.lit(i)))
    return merged.orderBy("k", F.desc("seq"), "source")


def as_of(probes: DataFrame, rows: DataFrame, at: str, span: int = SPAN) -> DataFrame:
    """Each probe (k, `at`) with the newest version of its key at that time, by windows and without a range join.

    Time is cut into ranges of `span`.  The newest version before each range, found
    from one row a key and range, enters it as one more version, so that a task
    sorts one range of a hot key."""
    names = [c for c in probes.columns if c not in ("k", at)]
    version = "struct<seq:bigint,tomb:boolean,v:string>"
    asked = probes.select("k", F.col(at).cast("bigint").alias("__at"), F.lit(2).alias("__kind"), F.lit(None).cast(version).alias("__x"), F.struct(*names, at).alias("__p"))
    no_probe = F.lit(None).cast(asked.schema["__p"].dataType).alias("__p")
    versions = rows.select("k", F.col("seq").alias("__at"), F.lit(1).alias("__kind"), F.struct("seq", "tomb", "v").cast(version).alias("__x"), no_probe)
    number = F.floor(F.col("__at") / span).alias("__range")
    newest_of = versions.groupBy("k", number).agg(F.max_by("__x", "__at").alias("__x"))
    ranges = newest_of.unionByName(asked.select("k", number, "__x").distinct()).groupBy("k", "__range").agg(F.max("__x").alias("__x"))
    earlier = Window.partitionBy("k").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("k", "__range", (F.col("__range") * span).alias("__at"), F.lit(0).alias("__kind"), F.last("__x", True).over(earlier).alias("__x"), no_probe)
    rows_of_all = asked.unionByName(versions).withColumn("__range", F.floor(F.col("__at") / span)).unionByName(carried.where("__x is not null"))
    upto = Window.partitionBy("k", "__range").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows_of_all.withColumn("__x", F.last("__x", True).over(upto)).where("__kind = 2")
    return joined.select("k", F.col(f"__p.{at}").alias(at), *[F.col(f"__p.{c}").alias(c) for c in names], "__x.seq", "__x.tomb", "__x.v")


def tiered(rows: DataFrame, snapshot: int) -> DataFrame:
    """What a store that keeps one version for each key and run shows at a snapshot: reduced by run first."""
    return live(newest(rows, None, "run"), snapshot)


def first_write(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.min_by(F.struct("seq", "v"), "seq").alias("x")).select("k", "x.*")


def entry_bytes() -> Column:
    return F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))


def upsert_bytes(rows: DataFrame) -> DataFrame:
    return newest(rows).agg(F.sum(entry_bytes()).alias("bytes"))
