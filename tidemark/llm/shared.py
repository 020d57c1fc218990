"""Session plumbing shared by the corpus operators: table access, cut points in the shared folder, connected components."""

from __future__ import annotations

import contextlib
import functools
import gc
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # bounds what a Python worker holds of long texts
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local session, whose executors are the driver, gets a private one where none is named; elsewhere that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidemark.shared.dir", "")
    if not known:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.shared.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Paths of the tables that each open scratch() owns, one stack a thread; the first entry belongs to no scope and waits for sweep()."""

    def __init__(self):
        self.stack: list[list[str]] = [[]]


_SCOPES = _Scopes()


def own(path: str, outer: bool = False) -> str:
    """Have a path of the shared folder deleted at the end of the innermost scope, or with `outer` at that of the scope around it."""
    stack = _SCOPES.stack
    stack[max(0, len(stack) - 1 - outer)].append(path)
    return path


def cut(df: DataFrame, name: str, outer: bool = False, seen: Observation | None = None, *counted: Column) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation.

    Inside scratch() the table is deleted at the scope's end, or with `outer` at that of the scope around it; outside, by sweep().
    `seen` observes the aggregates `counted` while the table is written."""
    path = own(fresh_path(df.sparkSession, name), outer)
    (df.observe(seen, *counted) if seen else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries: Spark deletes them once the driver's garbage collector finds their plans unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables behind the results that this thread has got so far outside of any scratch(); those results can't be read any more."""
    paths = _SCOPES.stack[0]
    delete(spark, paths)
    paths.clear()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside are deleted on leaving, and what their queries shuffled may go with the next garbage collection."""
    _SCOPES.stack.append([])
    try:
        yield
    finally:
        delete(spark, _SCOPES.stack.pop())
        release(spark)


def scratched(f):
    """Run a function of a DataFrame inside scratch()."""

    @functools.wraps(f)
    def run(df, *args, **options):
        with scratch(df.sparkSession):
            return f(df, *args, **options)

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it from being a column of `df`, in any case."""
    known, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        found.append(name)
    return found


HOT_KEYS = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of `left` with `right`, which has one row a key and tells in `count` how many of the `total` rows of left (or more) have it.

    Keys with more than total / HOT_KEYS rows, of which there can be no more than
    HOT_KEYS, are broadcast and their rows of left stay where they are; the others
    are shuffled, and none of them makes up more than that share of a task."""
    hot = F.col(count) * HOT_KEYS > F.lit(total)
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.hint("merge").join(right.where(~hot), keys))


def held_out(column, modulus: int):
    """crc32 of the id's decimal text modulo `modulus`, as the contracts define folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


@scratched
def components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(id, component) for each end of undirected `edges` (a, b), component being the smallest id reachable.

    Alternates the large-star and small-star contractions.  A round is one job that
    writes its edges to the shared folder; a count and a checksum, observed as they
    are written, tell when they no longer change.  Rows are joined by sort and merge
    at every size, so the driver never holds any.
    """
    size = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"))

    def kept(pairs: DataFrame, outer: bool) -> tuple[DataFrame, dict]:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        ordered = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        return cut(ordered, name, outer, seen, *size), seen.get

    known, state = kept(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), True)
    for _ in range(rounds):
        if not state["n"]:
            break
        both = known.union(known.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.hint("merge").join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.hint("merge").join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before = state
        known, state = kept(small, True)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = known.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return known.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
