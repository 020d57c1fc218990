"""Small storage algorithms as set operations: deadlock cycles, page and block layouts, fragments, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bounds import common_prefix_length, varint_size
from tidemark.sources.scratch import written

#: Block size and fragment header of the framed log.
BLOCK, FRAME_HEADER = 32768, 7
ROOM = BLOCK - FRAME_HEADER


def cycles(edges: DataFrame) -> DataFrame:
    """(victim, length) of each cycle of a wait-for graph where everybody waits for one owner: the victim is the greatest id.

    Pointer doubling: after as many steps as there are nodes everybody left stands
    on a cycle; the cycle's maximum spreads by doubling too.  A graph of n nodes
    takes log2(n) rounds of one join each, and each round is written out, so the
    next one's plan starts from a table."""
    jump = written(edges.select(F.col("waiter").alias("x"), F.col("owner").alias("y"), F.col("owner").alias("m")), "jump")
    for _ in range(max(1, jump.count().bit_length())):
        far = jump.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("m").alias("n"))
        jump = written(jump.join(far, "y").select("x", F.col("z").alias("y"), F.greatest("m", "n").alias("m")), "jump")
    on_cycle = jump.select(F.col("y").alias("x")).distinct()
    return jump.join(on_cycle, "x").groupBy(F.col("m").alias("victim")).agg(F.count("*").alias("length"))


def acquire(requests: DataFrame, owners: DataFrame, waiting: DataFrame) -> DataFrame:
    """requests (txn, k) with outcome: granted, reentrant, deadlock (the request would close a cycle whose greatest id is the requester) or blocked, and the victim of that cycle.

    owners: (k, owner), one row a lock; waiting: (waiter, owner), one edge a waiter,
    without cycles.  A requester does not wait yet, so it is on the chain of an
    owner's waiting only as its end.  Chains are followed by doubling, log2(n) rounds.
    Requests are judged each by itself against that state."""
    jump = written(waiting.select(F.col("waiter").alias("x"), F.col("owner").alias("y"), F.greatest("waiter", "owner").alias("m")), "chain")
    for _ in range(jump.count().bit_length()):
        far = jump.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("m").alias("n"))
        jump = written(jump.join(far, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.greatest("m", "n").alias("m")), "chain")
    asked = requests.join(owners, "k", "left").select("txn", "k", "owner")
    ends = asked.join(jump.select(F.col("x").alias("owner"), F.col("y").alias("last"), F.col("m").alias("top")), "owner", "left")
    victim = F.when((F.coalesce("last", "owner") == F.col("txn")) & (F.col("owner") != F.col("txn")), F.greatest("top", "txn"))
    outcome = F.when(F.col("owner").isNull(), "granted").when(F.col("owner") == F.col("txn"), "reentrant").when(victim == F.col("txn"), "deadlock").otherwise("blocked")
    return ends.select("txn", "k", outcome.alias("outcome"), victim.alias("victim"))


def fragments(rows: DataFrame, log: str, order: str, size: str) -> DataFrame:
    """Fragments of the records that each `log` is appended of, in `order`: position in the log, fragment number, type and length; empty records have none.

    Where a record starts depends on all before it, so each log is one ordered fold
    of two numbers a record, streamed over sorted rows; fragments follow by arithmetic."""
    kind = {c: t for c, t in rows.dtypes}

    def place(batches):
        import pyarrow as pa

        now, at = None, 0
        for batch in batches:
            starts = []
            for name, _, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name != now:
                    now, at = name, 0
                left = BLOCK - at % BLOCK
                at += left if left < FRAME_HEADER and n else 0
                starts.append(at)
                if n:
                    first = min(n, BLOCK - at % BLOCK - FRAME_HEADER)
                    rest = n - first
                    at += FRAME_HEADER + first + (rest + (-(-rest // ROOM)) * FRAME_HEADER if rest else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], [log, order, size, "at"])

    ordered = rows.select(log, order, size).repartition(log).sortWithinPartitions(log, order)
    placed = ordered.mapInArrow(place, ", ".join(f"{c} {kind[c]}" for c in (log, order, size)) + ", at bigint").where(F.col(size) > 0)
    first = F.least(F.col(size), BLOCK - F.col("at") % BLOCK - FRAME_HEADER).cast("bigint")
    placed = placed.withColumn("head", first).withColumn("pieces", (1 + F.ceil((F.col(size) - F.col("head")) / ROOM)).cast("int"))
    out = placed.withColumn("fragment", F.explode(F.expr("sequence(0, pieces - 1)")))
    kinds = F.when(F.col("pieces") == 1, "full").when(F.col("fragment") == 0, "first").when(F.col("fragment") == F.col("pieces") - 1, "last").otherwise("middle")
    length = F.when(F.col("fragment") == 0, F.col("head")).otherwise(F.least(F.lit(ROOM), F.col(size) - F.col("head") - (F.col("fragment") - 1) * ROOM)).cast("bigint")
    position = F.when(F.col("fragment") == 0, F.col("at")).otherwise(F.col("at") + F.col("head") + FRAME_HEADER + (F.col("fragment") - 1).cast("bigint") * BLOCK)
    return out.select(log, order, "fragment", position.alias("position"), kinds.alias("kind"), length.alias("length"))


def prefix_blocks(rows: DataFrame, restart: int = 16) -> DataFrame:
    """Shared and encoded lengths of sorted keys in each block, sharing reset every `restart` entries."""
    w = Window.partitionBy("block").orderBy("k")
    placed = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("k").over(w))
    shared = F.when(F.col("i") % restart == 0, 0).otherwise(common_prefix_length(F.col("k"), F.col("before")))
    out = placed.withColumn("shared", shared.cast("int")).withColumn("unshared", F.octet_length("k") - F.col("shared"))
    size = varint_size(F.col("shared")) + varint_size(F.col("unshared")) + varint_size(F.octet_length("v")) + F.col("unshared") + F.octet_length("v")
    suffix = F.substring(F.col("k").cast("binary"), F.col("shared") + 1, F.col("unshared"))
    return out.withColumn("encoded", size).select("block", "k", "i", "shared", "unshared", "encoded", suffix.alias("suffix"))


def prefix_decode(entries: DataFrame, restart: int = 16) -> DataFrame:
    """(block, i, k) of encoded entries (block, i, shared, suffix): keys are rebuilt from one restart to the next, `restart` entries at most together."""
    runs = entries.groupBy("block", F.floor(F.col("i") / restart).alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", "shared", "suffix"))).alias("x"))
    none = F.array().cast("array<struct<i:bigint,k:binary>>")

    def add(done, x):
        before = F.coalesce(F.get(done, F.size(done) - 1)["k"], F.lit(b""))
        return F.array_append(done, F.struct(x["i"].cast("bigint").alias("i"), F.concat(F.substring(before, F.lit(1), x["shared"]), x["suffix"]).alias("k")))

    return runs.select("block", F.explode(F.aggregate("x", none, add)).alias("x")).select("block", "x.*")


def slotted(rows: DataFrame, block_size: int = 8192, header: int = 32) -> DataFrame:
    """Offset of each entry of a slotted page and whether it still fits above the slots that grow down from the end."""
    w = Window.partitionBy("block").orderBy("k")
    size = F.octet_length("k") + F.octet_length("v") + 4
    placed = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("offset", header + F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.select("block", "k", "i", F.col("offset").cast("bigint"), (F.col("offset") + size <= block_size - 2 * (F.col("i") + 1)).alias("fits"))


def bloom_parameters(n: Column, bits_a_key: int = 10) -> tuple[Column, Column]:
    """(bits, probes) of a filter for n keys."""
    return F.greatest(F.lit(64), n * bits_a_key).cast("bigint"), F.least(F.greatest(F.round(F.lit(bits_a_key) * F.ln(F.lit(2.0))), F.lit(1)), F.lit(12)).cast("bigint")


def bloom_bits(keys: DataFrame, bits: int, probes: int, *by: str) -> DataFrame:
    """by, bucket, map: the set bits of a filter for the keys in column k, in bitmaps of 4 KB; (bit, k) pairs are reduced before the shuffle."""
    at = keys.select(*by, F.explode(bloom_places(F.col("k"), bits, probes)).alias("p"))
    return at.groupBy(*by, F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))


def bloom_places(k: Column, bits: int, probes: int) -> Column:
    """The places of a key: the halves of its md5 hash, the second one times the probe's number."""
    half = lambda at: F.conv(F.substring(F.md5(k.cast("binary")), at, 8), 16, 10).cast("bigint")
    return F.array(*[(half(1) + F.lit(i) * half(9)) % bits for i in range(probes)])


def may_contain(keys: DataFrame, filter_: DataFrame, bits: int, probes: int) -> DataFrame:
    """keys with may: whether all places of k are set; keys that are in the filter always may.

    The filter is joined by bitmap, so it may be larger than any one worker."""
    asked = keys.select("k").distinct().select("k", F.explode(bloom_places(F.col("k"), bits, probes)).alias("p"))
    asked = asked.withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("bit", F.bitmap_bit_position("p"))
    met = asked.join(filter_, "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    found = met.groupBy("k").agg(F.bool_and(hit).alias("may"))
    return keys.join(found, "k")


def guarded_probe(keys: DataFrame, table: DataFrame, filter_: DataFrame, bits: int, probes: int) -> DataFrame:
    """Reads of `table` (k, ...) for the keys that the filter lets pass, and how many passed: (asked, passed, found)."""
    seen = may_contain(keys, filter_, bits, probes).join(table.select("k").distinct().withColumn("there", F.lit(True)), "k", "left")
    return seen.agg(F.count("*").alias("asked"), F.count_if("may").alias("passed"), F.count_if(F.col("may") & F.col("there")).alias("found"))


def tower_height(k: Column, most: int = 8) -> Column:
    """Height of a key's tower: 1, and one more with probability 1/4 each, from the zero bit pairs that end its hash."""
    h = F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("bigint")
    out = F.lit(1)
    for i in range(1, most):
        out = F.when(h.bitwiseAND(F.lit((1 << 2 * i) - 1)) == 0, i + 1).otherwise(out)
    return out.cast("int")


def stripe(k: Column, stripes: int) -> Column:
    """Which of the stripes guards a key."""
    return (F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("bigint") % stripes).cast("int")


def cache_slots(keys: DataFrame, capacity: int) -> DataFrame:
    """(k, home, slot, full): where a cache of `capacity` slots without eviction puts the keys (k, seq), first come first served, by linear probing.

    A key that finds no slot is full.  The table has `capacity` entries at most, so
    its fold is of the first `capacity` keys; all others are full."""
    first = keys.groupBy("k").agg(F.min("seq").alias("seq"))
    home = F.conv(F.substring(F.md5(F.col("k").cast("binary")), 1, 8), 16, 10).cast("bigint") % capacity
    placed = first.select("k", "seq", home.cast("int").alias("home"))
    held = placed.orderBy("seq").limit(capacity)  # the cache's size, a feature
    ordered = held.agg(F.array_sort(F.collect_list(F.struct("seq", "k", "home"))).alias("x"))

    def put(done, x):
        taken = F.transform(done, lambda e: e["slot"])
        free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(capacity - 1)), lambda i: ((x["home"] + i) % capacity).cast("int")), lambda s: ~F.array_contains(taken, s))
        return F.array_append(done, F.struct(x["k"].alias("k"), free[0].alias("slot")))

    slots = ordered.select(F.explode(F.aggregate("x", F.array().cast("array<struct<k:string,slot:int>>"), put)).alias("e")).select("e.*")
    return placed.select("k", "home").join(slots, "k", "left").withColumn("full", F.col("slot").isNull())


def level_candidate(keys: DataFrame, meta: DataFrame) -> DataFrame:
    """(k, level, run): for each key the first run of each level whose range covers it.

    Levels below the first do not overlap, so a key has one candidate there: keys and
    lower bounds are sorted together and the last bound before a key is carried on."""
    bounds = meta.select("level", F.col("min_k").alias("k"), F.lit(0).alias("kind"), F.struct("run", "max_k").alias("x"))
    asked = keys.select("k").distinct().join(F.broadcast(meta.select("level").distinct())).select("level", "k", F.lit(1).alias("kind"), F.lit(None).cast("struct<run:bigint,max_k:string>").alias("x"))
    along = Window.partitionBy("level").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = bounds.unionByName(asked).withColumn("x", F.last("x", True).over(along)).where("kind = 1 and x is not null and k <= x.max_k")
    return found.select("k", "level", F.col("x.run").alias("run"))


def reference_counts(accesses: DataFrame) -> DataFrame:
    """Acquired, released and open references of each key; open ones that never close are leaks."""
    return accesses.groupBy("k").agg(F.count_if(F.col("acquire")).alias("acquired"), F.count_if(~F.col("acquire")).alias("released")).withColumn("refs", F.col("acquired") - F.col("released")).withColumn("leak", F.col("refs") != 0)


def hand_off(waiting: DataFrame) -> DataFrame:
    """First-in, first-out hand-off of each key's lock: who follows whom."""
    return waiting.withColumn("successor", F.lead("txn").over(Window.partitionBy("k").orderBy("seq")))


#: Class of each error name; all others are fatal.
ERROR_CLASSES = {"WriteStall": "busy", "LockHeld": "busy", "CorruptedWalRecord": "corruption", "UnsupportedFormat": "corruption", "KeyNotFound": "not_found", "EngineClosed": "retryable"}


def error_class(name: Column) -> Column:
    out = None
    for error, kind in ERROR_CLASSES.items():
        out = F.when(name == error, kind) if out is None else out.when(name == error, kind)
    return out.otherwise("fatal")
