"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is queued in a shuffled order, twice, and its virtual
finish time is the source's cumulative words so far divided by the source's
target.  Served in the order of finish times until the total budget is spent,
each source gets its target within one document.

Both running sums are two-level, so no source and no range of finish times needs
one task: rows fall into about sqrt(n) ranges, ranges are summed first, and a
window runs only inside a range.  The global order needs one more step: the
range that holds the budget's end is sorted, and the row found there (a single
row, the only one that reaches the driver) divides taken from left documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, cut, scratched, unused

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # budget over all words, as a fraction
REPEATS = 2  # a document is taken so many times at most
HASH_SPAN = 1 << 52


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, rank, target.

    Sources by code point, null last, weigh 3, 1, 2, repeating.  Targets share the
    budget by weight and stop at REPEATS times the source's size; the excess goes
    to the others by weight: the water level is the first, by capacity over
    weight, that leaves its source below its capacity."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.expr(f"cast((rank - 1) % {len(WEIGHTS)} + 1 as int)")))
    fill = Window.orderBy(F.expr(f"{REPEATS} * source_size / w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighed.withColumn("full", F.coalesce(F.sum(F.expr(f"{REPEATS} * source_size")).over(before), F.lit(0)))
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(everything) * SHARE[0] / SHARE[1])
        .withColumn("level", F.expr("(budget - full) / rest"))
        .withColumn("turn", F.row_number().over(fill))
        .withColumn("water", F.min(F.expr(f"if({REPEATS} * source_size > level * w, struct(turn, level), null)")).over(everything)["level"])
    )
    capped = F.expr(f"if(water is null or {REPEATS} * source_size <= water * w, {REPEATS}D * source_size, water * w)")
    return level.select("source", "source_size", "n", "rank", capped.alias("target"))


def shuffled(doc_id, text) -> Column:
    """A 52-bit position drawn from the id alone, or from the text of a row without id, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), 1, 13), 16, 10).cast("long")


def copies_taken() -> list[str]:
    return [f"taken_{k}" for k in range(REPEATS)]


@scratched
def serve(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, source, v (the shuffled position) and, for each copy k of a row, taken_k: the words that the mix takes of it."""
    spark = docs.sparkSession
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), shuffled("doc_id", "text").alias("v")), "sizes")
    aims = cut(targets(sizes), "targets")
    budget = aims.agg(F.sum("source_size")).first()[0]
    budget = (budget or 0) * SHARE[0] // SHARE[1]
    aims = aims.withColumnRenamed("source", "s")
    placed = (
        sizes.join(aims, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("part", F.floor(F.col("v") * F.ceil(F.sqrt("n")) / F.lit(HASH_SPAN)))
    )
    inside = Window.partitionBy("rank", "part").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("rank", "part").agg(F.sum("size").alias("words")).select("rank", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    queued = cut(
        placed.withColumn("run", F.sum("size").over(inside))
        .join(offsets, ["rank", "part"])
        .select("doc_id", "source", "size", "source_size", "target", "rank", "v", (F.col("offset") + F.col("run")).alias("cum")),
        "queued",
        outer=True,
    )

    def finish(copy: int) -> Column:
        return F.expr(f"({copy} * source_size + cum) / target")

    served = queued.where("size > 0 and target > 0").select("size", "rank", "v", "doc_id", F.explode(F.array(*[F.struct(finish(k).alias("finish"), F.lit(k).alias("copy")) for k in range(REPEATS)])).alias("x")).select("size", "rank", "v", "doc_id", "x.*")
    ranges = max(1, int(queued.count() ** 0.5))
    binned = served.withColumn("bin", F.floor(F.col("finish") * ranges))
    totals = binned.groupBy("bin").agg(F.sum("size").alias("words"))
    running = totals.withColumn("upto", F.sum("words").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    crossing = running.where(F.col("upto") >= budget).orderBy("bin").select("bin", (F.col("upto") - F.col("words")).alias("base")).first()
    if crossing is None or budget == 0:
        return queued.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "source", "v", *[F.lit(0).cast("long").alias(c) for c in copies_taken()])
    order = Window.orderBy("finish", "rank", "v", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        binned.where(F.col("bin") == crossing["bin"])
        .withColumn("at", F.sum("size").over(order) + crossing["base"])
        .where(F.col("at") >= budget)
        .orderBy("at", "finish")
        .first()
    )
    key = ("finish", "rank", "v", "doc_id", "copy")
    types = dict(binned.dtypes)
    edge = F.struct(*[F.lit(last[k]).cast(types[k]).alias(k) for k in key])
    partial = budget - (last["at"] - last["size"])

    def share(k: int) -> Column:
        own = F.struct(finish(k).alias("finish"), "rank", "v", "doc_id", F.lit(k).alias("copy"))
        return F.when((F.col("size") == 0) | (F.col("target") == 0), 0).when(own < edge, F.col("size")).when(own == edge, F.lit(partial)).otherwise(0)

    return queued.select("doc_id", "size", "source_size", "target", "source", "v", *[share(k).cast("long").alias(c) for k, c in enumerate(copies_taken())])


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row for each input row.

    A null text has size 0; a null source is a source of its own, the last.  Empty
    documents are never taken.  Repeated rows queue one after another.  The last
    document served is cut to the budget's end.
    """
    return serve(docs).select("doc_id", "size", "source_size", "target", sum(map(F.col, copies_taken()), F.lit(0)).cast("long").alias("taken"), "source")


BROADCAST_SOURCES = 10_000


def position(v: Column, doc_id: Column, size: Column) -> Column:
    """Place of a row in its source's queue."""
    return F.struct(v.alias("v"), doc_id.cast("long").alias("doc_id"), size.alias("size"))


@scratched
def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the mix takes, all columns, with mix_taken (with underscores behind it where `docs` has that name): the words taken, repeats counted.

    What the mix takes of a source is, for each copy, a prefix of its queue.  So one
    row a source tells it for all documents, and their texts are filtered where
    they are read.  Rows that tie at a prefix's end share its words evenly,
    rounded up; a single row there has just what mix() gives.
    """
    served = serve(docs).withColumn("at", position(F.col("v"), F.col("doc_id"), F.col("size")))
    copies = range(REPEATS)
    ends = served.groupBy("source").agg(*[F.min(F.when(F.col(f"taken_{k}") < F.col("size"), F.col("at"))).alias(f"end_{k}") for k in copies])
    ends = cut(ends.withColumnRenamed("source", "s"), "ends")
    few = ends.count() <= BROADCAST_SOURCES
    ends = F.broadcast(ends) if few else ends
    tied = served.join(ends, F.col("source").eqNullSafe(F.col("s")))
    shares = [F.ceil(F.avg(F.when(F.col("at") == F.col(f"end_{k}"), F.col(f"taken_{k}")))).cast("long").alias(f"part_{k}") for k in copies]
    bounds = cut(tied.groupBy("s").agg(*[F.first(f"end_{k}").alias(f"end_{k}") for k in copies], *shares), "bounds", outer=True)
    size, at = word_count(docs["text"]), position(shuffled("doc_id", "text"), F.col("doc_id"), word_count(F.col("text")))
    size_name, at_name, taken_name = unused(docs, "size", "at", "mix_taken")
    own = docs.withColumns({size_name: size, at_name: at})
    joined = own.join(F.broadcast(bounds) if few else bounds, own["source"].cast("string").eqNullSafe(bounds["s"]))

    def words(k: int) -> Column:
        end = bounds[f"end_{k}"]
        return F.when(end.isNull() | (own[at_name] < end), own[size_name]).when(own[at_name] == end, bounds[f"part_{k}"]).otherwise(0)

    taken = sum(map(words, copies), F.lit(0)).cast("long").alias(taken_name)
    return joined.select(*[own[c] for c in docs.columns], taken).where(F.col(taken_name) > 0)


ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT AS v FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS w FROM by_source
), filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS full_before,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest, sum(source_size) OVER () * 3 / 2.0::DOUBLE AS budget
  FROM weighed WINDOW before AS (ORDER BY 2 * source_size / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (budget - full_before::DOUBLE) / rest::DOUBLE AS level, row_number() OVER (ORDER BY 2 * source_size / w::DOUBLE, rank) AS turn FROM filled
), watered AS (
  SELECT *, (SELECT level FROM leveled WHERE 2 * source_size > level * w ORDER BY turn LIMIT 1) AS water FROM leveled
), aims AS (
  SELECT source, source_size, rank, CASE WHEN water IS NULL OR 2 * source_size <= water * w THEN 2.0::DOUBLE * source_size ELSE water * w END AS target FROM watered
), placed AS (
  SELECT doc_id, size, s.source, source_size, target, rank, v
  FROM sizes s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), queued AS (
  SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM placed
), served AS (
  SELECT *, (copy * source_size + cum)::DOUBLE / target AS finish FROM queued, (VALUES (0), (1)) AS c(copy) WHERE size > 0 AND target > 0
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, v, doc_id, copy ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM served
), given AS (
  SELECT doc_id, sum(greatest(0, least(size, (SELECT sum(size) * 3 // 2 FROM sizes)::BIGINT - (upto - size))))::BIGINT AS taken FROM ordered GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source FROM queued q LEFT JOIN given g ON q.doc_id = g.doc_id
"""
