"""Latency histograms, counters and the token bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds in microseconds, and what the overflow bucket reports.
BOUNDS = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 50000, 100000)
OVERFLOW = 200000


def bucket(us: Column) -> Column:
    """The upper bound of an observation's bucket."""
    out = None
    for b in BOUNDS:
        out = F.when(us <= b, b) if out is None else out.when(us <= b, b)
    return out.otherwise(OVERFLOW)


def percentiles(rows: DataFrame, by: str, us: str, shares=(("p50", 50), ("p95", 95), ("p99", 99))) -> DataFrame:
    """Bucket bounds at which the cumulative count reaches each share; counts are reduced to buckets before the shuffle."""
    counts = rows.groupBy(by, bucket(F.col(us)).alias("bound")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    upto = F.sum("n").over(w.orderBy("bound").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy(by).agg(F.sum("n").alias("n"), *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bound"))).cast("bigint").alias(name) for name, share in shares])


def token_bucket(rows: DataFrame, by: str, at: str, cost: str, rate: int, burst: int, unit: int = 1) -> DataFrame:
    """Waiting of each key's requests: `burst` tokens at first, `rate` for each `unit` of time, a short request empties the bucket and waits for the rest.

    tokens (left) and short (missing in all) are in parts of 1/unit token, so that
    refills over short gaps are exact.  The state after a request depends on all
    before it: each key is one ordered fold over sorted rows, which are streamed, so
    a hot key takes time but no memory."""
    kind = dict(rows.dtypes)[by]

    def fold(batches):
        import pyarrow as pa

        key, tokens, last, short, limited, begun = None, 0, 0, 0, 0, False
        for batch in batches:
            out = []
            for k, t, _, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or k != key:
                    if begun:
                        out.append((key, tokens, short, limited))
                    key, tokens, last, short, limited, begun = k, burst * unit, t, 0, 0, True
                tokens = min(burst * unit, tokens + (t - last) * rate)
                missing = max(0, c * unit - tokens)
                tokens, last, short, limited = max(0, tokens - c * unit), t, short + missing, limited + (missing > 0)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [by, "tokens", "short", "limited"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, tokens, short, limited)], [by, "tokens", "short", "limited"])

    ordered = rows.select(by, F.col(at).cast("bigint").alias("at"), "n", F.col(cost).cast("bigint").alias("cost")).repartition(by).sortWithinPartitions(by, "at", "n")
    return ordered.mapInArrow(fold, f"{by} {kind}, tokens bigint, short bigint, limited bigint")


def latency_properties(rows: DataFrame, by: str = "op", us: str = "us") -> DataFrame:
    """name, value of engine.metrics.latency.<op>.<p50|p95|p99>_us for put, delete, get and scan; 0 for an operation that did not happen."""
    found = percentiles(rows.where(F.col(by).isin(*LATENCY_OPS)), by, us)
    names = rows.sparkSession.createDataFrame([(o, p) for o in LATENCY_OPS for p in ("p50", "p95", "p99")], "op string, p string")
    long = found.select(F.col(by).alias("op"), F.explode(F.create_map(*[x for p in ("p50", "p95", "p99") for x in (F.lit(p), F.col(p))])).alias("p", "value"))
    name = F.concat(F.lit("engine.metrics.latency."), "op", F.lit("."), "p", F.lit("_us"))
    return F.broadcast(names).join(long, ["op", "p"], "left").select(name.alias("name"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


def percentile_of(ns: list[int], share: int) -> int:
    """The bucket bound, in microseconds, at which the cumulative count of the observations reaches the share; 0 without any."""
    counts = [0] * (len(BOUNDS) + 1)
    for x in ns:
        counts[next((i for i, b in enumerate(BOUNDS) if x // 1000 <= b), len(BOUNDS))] += 1
    due, upto = max(1, -(-len(ns) * share // 100)), 0
    for bound, n in zip((*BOUNDS, OVERFLOW), counts, strict=True):
        upto += n
        if ns and upto >= due:
            return bound
    return 0


def stall_of(immutables: int, l0: int, config, queue_full: bool = False) -> tuple[str, str]:
    """maintain.stall_state for Python numbers."""
    cases = ((queue_full, "stop", "queue_full"), (l0 >= config.stop_l0_files, "stop", "l0_pressure"), (immutables >= config.stop_immutable_count, "stop", "immutable_pressure"), (l0 >= config.slowdown_l0_files, "slowdown", "l0_pressure"), (immutables >= config.slowdown_immutable_count, "slowdown", "immutable_pressure"))
    return next(((state, reason) for when, state, reason in cases if when), ("normal", "none"))


#: The support tier of each system on 64-bit Intel and ARM machines; other machines are experimental there, other systems unsupported.
TIERS = {"linux": "tier1", "macos": "tier1", "freebsd": "tier2"}


def platform() -> dict[str, int | str]:
    """What the driver's machine is and can."""
    import platform as here
    import struct

    os = {"darwin": "macos"}.get(here.system().lower(), here.system().lower())
    arch = {"amd64": "x86_64", "arm64": "aarch64"}.get(here.machine().lower(), here.machine().lower())
    bits = struct.calcsize("P") * 8
    tier = TIERS.get(os, "unsupported") if arch in ("x86_64", "aarch64") or os not in TIERS else "experimental"
    return {
        "platform.os": os, "platform.arch": arch, "platform.tier": tier, "platform.pointer_bits": bits, "platform.supported": int(os in TIERS and bits >= 64),
        "platform.checkpoint_atomic_noreplace": int(os == "linux"), "platform.checkpoint_portable_reservation": int(os != "linux"), "platform.direct_io_path": int(os in ("linux", "macos")),
    }


LATENCY_OPS = ("put", "delete", "get", "scan")


def average_write_us(total_ns: Column, writes: Column) -> Column:
    """Mean write latency: whole nanoseconds a write, then whole microseconds; 0 without writes."""
    return F.when(writes == 0, 0).otherwise(F.floor(F.floor(total_ns / writes) / 1000)).cast("bigint")


def properties(log: DataFrame) -> DataFrame:
    """name, value rows of a store's counters and gauges over its log (k, seq, tomb, v)."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    totals = log.agg(
        F.count_if(~F.col("tomb")).alias("put.count"), F.count_if("tomb").alias("delete.count"), F.sum(size + 15).alias("wal.bytes"), (F.max("seq") + 1).alias("next_sequence"),
        F.expr("if(count(*) = 0, 0, sum(octet_length(k) + coalesce(octet_length(v), 0)) div count(*))").alias("write.avg_bytes"),
    )
    names = totals.columns
    return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("bigint").alias("value")) for n in names])).alias("x")).select("x.*")
