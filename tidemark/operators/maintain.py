"""Flush, compaction, zone maps and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bounds import file_overlaps, ranges_overlap
from tidemark.operators.reads import entry_bytes, newest

ENTRY_OVERHEAD = 16


def assign_runs(log: DataFrame, rows_a_run: int) -> DataFrame:
    return log.withColumn("run", F.floor((F.col("seq") - 1) / rows_a_run).cast("bigint"))


def flush(log: DataFrame) -> DataFrame:
    """Level-0 runs: the newest version of each key in each run, tombstones included."""
    return newest(log, None, "run")


def file_meta(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*(by or ("run",))).agg(F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.count("*").alias("rows"), F.sum(entry_bytes() + ENTRY_OVERHEAD).alias("bytes"))


def compact_l0(runs: DataFrame) -> DataFrame:
    """All level-0 runs into one: the newest version of each key; tombstones stay, deeper levels may need them."""
    return newest(runs)


def overlapping(meta: DataFrame, picked: DataFrame) -> DataFrame:
    """Runs of `meta` whose key range meets that of a picked run."""
    p = picked.select(F.col("min_k").alias("lo"), F.col("max_k").alias("hi"))
    return meta.join(p, ranges_overlap(meta["min_k"], meta["max_k"], p["lo"], p["hi"]), "left_semi")


def compact_level(source: DataFrame, target: DataFrame, deeper: DataFrame, oldest_snapshot: int | None = None) -> DataFrame:
    """Merge source and overlapping target rows; a tombstone goes if no deeper run has its key and no open snapshot can see past it.

    An output without rows is committed as such: the inputs go all the same."""
    merged = newest(source.withColumn("tier", F.lit(1)).unionByName(target.withColumn("tier", F.lit(0))), tier="tier")
    held = deeper.select("k").distinct().withColumn("held", F.lit(True))
    needed = F.col("held").isNotNull() if oldest_snapshot is None else F.col("held").isNotNull() | (F.col("seq") > oldest_snapshot)
    return merged.join(held, "k", "left").where(~F.col("tomb") | needed).drop("held")


def level_pressure(meta: DataFrame, base: int) -> DataFrame:
    """Bytes of each level against base * 10**level, and whether it is due for compaction."""
    target = (F.lit(base) * F.pow(F.lit(10), F.col("level"))).cast("bigint")
    return meta.groupBy("level").agg(F.sum("bytes").alias("bytes")).withColumn("target", target).withColumn("due", F.col("bytes") > target)


def prune(meta: DataFrame, bounds: DataFrame) -> DataFrame:
    """Files that each [start, end) of `bounds` must read."""
    return bounds.join(meta, file_overlaps(meta["min_k"], meta["max_k"], bounds["start"], bounds["end"])).select("bound", "run")


def apply_edit(files: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """A version's files after an edit."""
    return files.unionByName(added).join(deleted.select("level", "run"), ["level", "run"], "left_anti")


def stall_state(immutables: Column, l0: Column, queue_full: Column | None = None, soft=(4, 8), hard=(8, 12)) -> tuple[Column, Column]:
    """(state, reason) of the write path: soft and hard limits of immutables and of level-0 files."""
    full = F.lit(False) if queue_full is None else queue_full
    cases = ((full, "stop", "queue_full"), (l0 >= hard[1], "stop", "l0_pressure"), (immutables >= hard[0], "stop", "immutable_pressure"), (l0 >= soft[1], "slowdown", "l0_pressure"), (immutables >= soft[0], "slowdown", "immutable_pressure"))
    state = reason = None
    for when, s, r in cases:
        state = F.when(when, s) if state is None else state.when(when, s)
        reason = F.when(when, r) if reason is None else reason.when(when, r)
    return state.otherwise("normal"), reason.otherwise("none")


def restore_until(base: DataFrame, log: DataFrame, target) -> DataFrame:
    """Point-in-time restore: `log` (pos, ts, k, tomb, v) is cut before the first record with ts >= target, whatever its later times; base rows come first."""
    cut = log.where(F.col("ts") >= F.lit(target)).agg(F.min("pos").alias("cut"))
    kept = log.join(F.broadcast(cut), F.col("cut").isNull() | (F.col("pos") < F.col("cut"))).select("k", F.struct(F.lit(1).alias("tier"), "pos").alias("seq"), "tomb", "v")
    old = base.select("k", F.struct(F.lit(0).alias("tier"), F.lit(None).cast(log.schema["pos"].dataType).alias("pos")).alias("seq"), F.lit(False).alias("tomb"), "v")
    return newest(kept.unionByName(old)).where(~F.col("tomb")).select("k", "v")


def segment_order(name: Column) -> Column:
    """Number in wal-<number>; null for other names."""
    return F.regexp_extract(name, r"^wal-(\d{1,18})$", 1).try_cast("bigint")


def pending_bytes(meta: DataFrame) -> DataFrame:
    """Bytes of level 0, which wait for compaction."""
    return meta.where("level = 0").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))


def pick(meta: DataFrame, level: int) -> DataFrame:
    """Inputs of a compaction of `level`: its oldest run and the runs of the next level whose key range meets it."""
    source = meta.where(F.col("level") == level).orderBy("run").limit(1)  # one run, by definition
    target = overlapping(meta.where(F.col("level") == level + 1), source)
    return source.withColumn("role", F.lit("source")).unionByName(target.withColumn("role", F.lit("target")))


def rotate(log: DataFrame, most: int) -> DataFrame:
    """`log` with run: by the running size of its entries, a new run every `most` bytes.

    Sums are two-level: ranges of 4096 sequence numbers are summed first, so no task sees the whole log."""
    part = F.floor(F.col("seq") / 4096)
    parts = log.groupBy(part.alias("part")).agg(F.sum(entry_bytes()).alias("bytes"))
    before = parts.select("part", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.coalesce(F.sum(entry_bytes()).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = log.withColumn("part", part).withColumn("inside", upto).join(before, "part")
    return placed.withColumn("run", F.floor((F.col("before") + F.col("inside")) / most).cast("bigint")).drop("part", "inside", "before")
