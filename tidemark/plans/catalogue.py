"""The engine's queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bounds, codec
from tidemark.functions.bounds import text_prefix_end
from tidemark.operators import algos, maintain, metrics, reads
from tidemark.sources import framed_log
from tidemark.sources.scratch import fresh
from tidemark.sources.store import Config, Store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# The demonstration log: a mutation for each event, errors being tombstones.

MUT = """mutlog AS (
  SELECT concat('user:', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS k, event_id + 1 AS seq, ts, event_type = 'error' AS tomb,
         CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '|', props) END AS v FROM events)"""
NEW = """newest AS (SELECT k, seq, tomb, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM mutlog) WHERE r = 1)"""
RUNS = """runs AS (SELECT k, seq, tomb, v, run FROM (SELECT *, (seq - 1) // 1000 AS run, row_number() OVER (PARTITION BY k, (seq - 1) // 1000 ORDER BY seq DESC) AS r FROM mutlog) WHERE r = 1)"""
META = """meta AS (SELECT run, min(k) AS min_k, max(k) AS max_k, count(*) AS rows, CAST(sum(strlen(k) + coalesce(strlen(v), 0) + 16) AS BIGINT) AS bytes FROM runs GROUP BY run)"""
STORE = "WITH " + ", ".join((MUT, NEW)) + " "
TIERS = "WITH " + ", ".join((MUT, RUNS)) + " "
FILES = "WITH " + ", ".join((MUT, RUNS, META)) + " "
RUN_ROWS = 1000
RESTORE_TO = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mutlog(spark, sf) -> DataFrame:
    tomb = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        "ts",
        tomb.alias("tomb"),
        F.when(~tomb, F.concat("event_type", F.lit("|"), "props")).alias("v"),
    )


def runs(spark, sf) -> DataFrame:
    return maintain.flush(maintain.assign_runs(mutlog(spark, sf), RUN_ROWS))


def wide(spark, sf) -> DataFrame:
    """Orders as entries of pages of 1000 keys."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("k"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("v"), F.floor(F.col("o_orderkey") / 1000).alias("block")
    )


WIDE = """wide AS (SELECT concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS k, concat_ws('|', o_orderstatus, o_orderpriority) AS v, o_orderkey // 1000 AS block FROM orders)"""


# Reads


@query(STORE + "SELECT k, v, seq FROM newest WHERE NOT tomb")
def kv_full_scan(spark, sf):
    return reads.scan(mutlog(spark, sf))


@query(STORE + "SELECT k, v, seq FROM newest WHERE NOT tomb AND k >= 'user:000010' AND k < 'user:000020'")
def kv_range_scan(spark, sf):
    return reads.scan(mutlog(spark, sf), "user:000010", "user:000020")


@query(STORE + "SELECT k, v, seq FROM newest WHERE NOT tomb AND starts_with(k, 'user:00001')")
def kv_prefix_scan(spark, sf):
    return reads.scan_prefix(mutlog(spark, sf), "user:00001")


@query(SQL["kv_prefix_scan"])
def kv_prefix_as_range(spark, sf):
    return reads.scan(mutlog(spark, sf), "user:00001", text_prefix_end("user:00001"))


@query(f"WITH {MUT}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM mutlog WHERE seq <= 5000) WHERE r = 1) SELECT k, v, seq FROM newest WHERE NOT tomb")
def kv_snapshot_scan(spark, sf):
    return reads.scan(mutlog(spark, sf), snapshot=5000)


@query(TIERS + "SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM runs WHERE seq <= 5500) WHERE r = 1 AND NOT tomb")
def kv_tiered_snapshot(spark, sf):
    return reads.tiered(maintain.assign_runs(mutlog(spark, sf), RUN_ROWS), 5500)


@query(STORE + "SELECT k, v, seq FROM newest WHERE NOT tomb AND k = 'user:000004'")
def kv_get(spark, sf):
    return reads.get(mutlog(spark, sf), "user:000004")


@query(STORE + "SELECT k, v, seq FROM newest WHERE NOT tomb AND k IN (SELECT concat('user:', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer WHERE c_mktsegment = 'BUILDING')")
def kv_multi_get(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))
    return reads.multi_get(mutlog(spark, sf), keys)


@query(f"WITH {MUT} SELECT k, seq, tomb, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS version FROM mutlog")
def kv_history(spark, sf):
    return reads.history(mutlog(spark, sf).drop("ts")).select("k", "seq", "tomb", "v", F.col("version").cast("bigint"))


@query(f"WITH {MUT} SELECT k, seq, tomb, v, CAST(seq % 2 AS INTEGER) AS source FROM mutlog")
def kv_merge_stream(spark, sf):
    log = mutlog(spark, sf).drop("ts")
    return reads.merge_stream(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))


@query(
    f"""WITH {MUT}, probes AS (SELECT concat('user:', lpad(CAST(o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR), 6, '0')) AS k, o_orderkey, o_orderkey % (SELECT count(*) FROM events) AS t FROM orders)
    SELECT p.k, p.t, p.o_orderkey, m.seq, m.tomb, m.v FROM probes p ASOF LEFT JOIN mutlog m ON p.k = m.k AND p.t >= m.seq"""
)
def kv_asof_join(spark, sf):
    events = table(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))
    orders = table(spark, sf, "orders").join(F.broadcast(events))  # one row
    probes = orders.select(F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % F.col("users")).cast("string"), 6, "0")).alias("k"), "o_orderkey", (F.col("o_orderkey") % F.col("n")).alias("t"))
    return reads.as_of(probes, mutlog(spark, sf), "t")


@query(STORE + "SELECT split_part(v, '|', 1) AS kind, count(*) AS n, max(seq) AS newest FROM newest WHERE NOT tomb GROUP BY 1")
def kv_agg_over_scan(spark, sf):
    return reads.live(mutlog(spark, sf)).groupBy(F.split_part("v", F.lit("|"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.max("seq").alias("newest"))


@query(f"WITH {MUT} SELECT k, min(seq) AS seq, arg_min(struct_pack(v := v), seq).v AS v FROM mutlog GROUP BY k")
def kv_first_write(spark, sf):
    return reads.first_write(mutlog(spark, sf))


@query(STORE + "SELECT CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) AS bytes FROM newest")
def kv_upsert_bytes(spark, sf):
    return reads.upsert_bytes(mutlog(spark, sf))


# Writes and maintenance


@query(
    f"""WITH {MUT} SELECT batch, k, seq, tomb, v, ops FROM (SELECT *, (seq - 1) // 3 AS batch, count(*) OVER (PARTITION BY (seq - 1) // 3) AS ops,
    row_number() OVER (PARTITION BY (seq - 1) // 3, k ORDER BY seq DESC) AS r FROM mutlog) WHERE r = 1"""
)
def kv_write_batch(spark, sf):
    log = mutlog(spark, sf).withColumn("batch", F.floor((F.col("seq") - 1) / 3))
    best = log.groupBy("batch", "k").agg(F.max_by(F.struct("seq", "tomb", "v"), "seq").alias("x"), F.count("*").alias("c"))
    return best.select("batch", "k", "x.*", F.sum("c").over(Window.partitionBy("batch")).alias("ops"))


@query(FILES + "SELECT run, min_k, max_k, rows, bytes FROM meta")
def kv_flush_l0_meta(spark, sf):
    return maintain.file_meta(runs(spark, sf))


@query(TIERS + "SELECT k, seq, tomb, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM runs) WHERE r = 1")
def kv_compact_l0(spark, sf):
    return maintain.compact_l0(runs(spark, sf))


@query(
    TIERS
    + """, merged AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM runs WHERE run >= 2)
    SELECT k, seq, tomb, v FROM merged WHERE r = 1 AND (NOT tomb OR k IN (SELECT k FROM runs WHERE run < 2 AND k < 'user:000100'))"""
)
def kv_compact_level_gc(spark, sf):
    r = runs(spark, sf)
    return maintain.compact_level(r.where("run >= 5").drop("run"), r.where("run between 2 and 4").drop("run"), r.where("run < 2 and k < 'user:000100'"))


@query(
    FILES
    + """, leveled AS (SELECT CASE WHEN run < 3 THEN 0 WHEN run < 6 THEN 1 ELSE 2 END AS level, bytes FROM meta)
    SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(4096 * pow(10, level) AS BIGINT) AS target, sum(bytes) > 4096 * pow(10, level) AS due FROM leveled GROUP BY level"""
)
def kv_level_pressure(spark, sf):
    meta = maintain.file_meta(runs(spark, sf)).withColumn("level", F.expr("case when run < 3 then 0 when run < 6 then 1 else 2 end"))
    return maintain.level_pressure(meta, 4096)


CUT_RUNS = "run AS id, k FROM runs WHERE k < concat('user:', lpad(CAST(12 * run + 20 AS VARCHAR), 6, '0'))"


@query(
    TIERS
    + f""", meta AS (SELECT id AS run, min(k) AS min_k, max(k) AS max_k FROM (SELECT {CUT_RUNS}) GROUP BY id),
    bounds(bound, s, e) AS (VALUES (1, 'user:000100', 'user:000110'), (2, 'user:000050', NULL), (3, NULL, 'user:000001'))
    SELECT bound, run FROM bounds, meta WHERE (e IS NULL OR e > min_k) AND (s IS NULL OR s <= max_k)"""
)
def kv_file_prune(spark, sf):
    kept = runs(spark, sf).where(F.col("k") < F.concat(F.lit("user:"), F.lpad((12 * F.col("run") + 20).cast("string"), 6, "0")))
    ranges = spark.createDataFrame([(1, "user:000100", "user:000110"), (2, "user:000050", None), (3, None, "user:000001")], "bound int, start string, end string")
    return maintain.prune(maintain.file_meta(kept), ranges)


@query(FILES + "SELECT CAST(0 AS INTEGER) AS level, run, rows FROM meta WHERE run % 4 <> 1 UNION ALL SELECT 1, max(run) + 1, CAST(sum(rows) AS BIGINT) FROM meta WHERE run % 4 = 1 HAVING count(*) > 0")
def kv_version_edit(spark, sf):
    files = maintain.file_meta(runs(spark, sf)).select(F.lit(0).alias("level"), "run", "rows")
    gone = files.where("run % 4 = 1")
    added = gone.agg((F.max("run") + 1).alias("run"), F.sum("rows").alias("rows")).where("run is not null").select(F.lit(1).alias("level"), "run", "rows")
    return maintain.apply_edit(files, added, gone)


@query(
    TIERS
    + """, live AS (SELECT run, tomb, k, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM runs)
    SELECT (SELECT count(*) FROM runs WHERE NOT tomb AND run = (SELECT max(run) FROM runs)) AS memory_keys, (SELECT count(*) FROM live WHERE r = 1 AND NOT tomb) AS keys, (SELECT max(seq) + 1 FROM runs) AS next_sequence"""
)
def kv_stats(spark, sf):
    r = runs(spark, sf)
    last = r.groupBy("run").agg(F.count_if(~F.col("tomb")).alias("c")).agg(F.max_by("c", "run").alias("memory_keys"))
    return last.join(reads.newest(r).agg(F.count_if(~F.col("tomb")).alias("keys"), (F.max("seq") + 1).alias("next_sequence")))  # one row each


@query(
    """SELECT i AS immutables, l AS l0, CASE WHEN l >= 12 OR i >= 8 THEN 'stop' WHEN l >= 8 OR i >= 4 THEN 'slowdown' ELSE 'normal' END AS state,
    CASE WHEN l >= 12 THEN 'l0_pressure' WHEN i >= 8 THEN 'immutable_pressure' WHEN l >= 8 THEN 'l0_pressure' WHEN i >= 4 THEN 'immutable_pressure' ELSE 'none' END AS reason
    FROM range(10) a(i), range(15) b(l)"""
)
def kv_stall_state(spark, sf):
    grid = spark.range(10).select(F.col("id").alias("immutables"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(14).cast("bigint"))).alias("l0"))
    state, reason = maintain.stall_state(F.col("immutables"), F.col("l0"))
    return grid.select("immutables", "l0", state.alias("state"), reason.alias("reason"))


@query(
    f"""WITH {MUT}, kept AS (SELECT * FROM mutlog WHERE seq < coalesce((SELECT min(seq) FROM mutlog WHERE ts >= TIMESTAMP '{RESTORE_TO}'), 9000000000)),
    base AS (SELECT concat('user:', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS k, -1 AS seq, false AS tomb, c_mktsegment AS v FROM customer),
    ranked AS (SELECT k, v, tomb, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM (SELECT k, seq, tomb, v FROM kept UNION ALL SELECT k, seq, tomb, v FROM base))
    SELECT k, v FROM ranked WHERE r = 1 AND NOT tomb"""
)
def kv_pitr_restore(spark, sf):
    base = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"), F.col("c_mktsegment").alias("v"))
    return maintain.restore_until(base, mutlog(spark, sf).withColumnRenamed("seq", "pos"), F.to_timestamp(F.lit(RESTORE_TO)))


# Metrics

_CASE = "CASE " + " ".join(f"WHEN us <= {b} THEN {b}" for b in metrics.BOUNDS) + f" ELSE {metrics.OVERFLOW} END"


@query(
    f"""WITH seen AS (SELECT event_type, CAST(floor(value * 400) AS BIGINT) AS us FROM events), c AS (SELECT event_type, {_CASE} AS bound, count(*) AS n FROM seen GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM c)
    SELECT event_type, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'CAST(min(CASE WHEN upto * 100 >= total * {p} THEN bound END) AS BIGINT) AS p{p}' for p in (50, 95, 99))} FROM u GROUP BY event_type"""
)
def kv_latency_percentiles(spark, sf):
    seen = table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 400).alias("us"))
    return metrics.percentiles(seen, "event_type", "us")


@query(
    """WITH RECURSIVE seen AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CAST(floor(value * 100) AS BIGINT) * 2000 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f(user_id, i, t, tokens, short, limited) AS (
      SELECT user_id, 1, t, greatest(40000000 - cost, 0), greatest(cost - 40000000, 0), CAST(cost > 40000000 AS BIGINT) FROM seen WHERE i = 1
      UNION ALL
      SELECT s.user_id, s.i, s.t, greatest(least(40000000, tokens + s.t - f.t) - cost, 0), short + greatest(cost - least(40000000, tokens + s.t - f.t), 0),
             limited + CAST(cost > least(40000000, tokens + s.t - f.t) AS BIGINT)
      FROM f JOIN seen s ON s.user_id = f.user_id AND s.i = f.i + 1)
    SELECT user_id, CAST(arg_max(tokens, i) AS BIGINT) AS tokens, CAST(max(short) AS BIGINT) AS short, CAST(max(limited) AS BIGINT) AS limited FROM f GROUP BY user_id"""
)
def kv_token_bucket(spark, sf):
    seen = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("n"), F.floor(F.col("value") * 100).alias("cost"))
    return metrics.token_bucket(seen, "user_id", "t", "cost", 1, 20000, 2000)


@query(
    f"""WITH {MUT}, t AS (SELECT count(*) FILTER (NOT tomb) AS a, count(*) FILTER (tomb) AS b, sum(strlen(k) + coalesce(strlen(v), 0) + 15) AS c, max(seq) + 1 AS d, sum(strlen(k) + coalesce(strlen(v), 0)) // count(*) AS e FROM mutlog)
    SELECT 'put.count' AS name, CAST(a AS BIGINT) AS value FROM t UNION ALL SELECT 'delete.count', b FROM t UNION ALL SELECT 'wal.bytes', CAST(c AS BIGINT) FROM t UNION ALL SELECT 'next_sequence', d FROM t UNION ALL SELECT 'write.avg_bytes', CAST(e AS BIGINT) FROM t"""
)
def kv_metrics(spark, sf):
    return metrics.properties(mutlog(spark, sf))


# Storage algorithms


@query(
    """WITH RECURSIVE n AS (SELECT count(DISTINCT user_id) AS n FROM events), edges AS (SELECT DISTINCT user_id AS waiter, (user_id * user_id + 1) % n AS owner FROM events, n),
    walk(start, node, depth) AS (SELECT waiter, owner, 1 FROM edges UNION ALL SELECT start, owner, depth + 1 FROM walk JOIN edges ON waiter = node WHERE node <> start AND depth <= (SELECT n FROM n))
    SELECT DISTINCT victim, length FROM (SELECT start, max(node) AS victim, count(*) AS length FROM walk GROUP BY start HAVING bool_or(node = start))"""
)
def kv_deadlock_cycles(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    n = users.count()
    return algos.cycles(users.select(F.col("user_id").alias("waiter"), ((F.col("user_id") * F.col("user_id") + 1) % n).alias("owner")))


_START = "f.fin + CASE WHEN 32768 - f.fin % 32768 < 7 THEN 32768 - f.fin % 32768 ELSE 0 END"
_FIRST = "least(size, 32768 - pos0 % 32768 - 7)"


@query(
    f"""WITH RECURSIVE d AS (SELECT coalesce(lang, '') AS log, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS i FROM documents WHERE strlen(text) > 0),
    f(log, doc_id, size, i, pos0, fin) AS (
      SELECT log, doc_id, size, i, pos0, CAST(pos0 + 7 + {_FIRST} + (size - {_FIRST}) + CAST(ceil((size - {_FIRST}) / 32761.0) AS BIGINT) * 7 AS BIGINT) FROM (SELECT *, CAST(0 AS BIGINT) AS pos0 FROM d WHERE i = 1)
      UNION ALL
      SELECT log, doc_id, size, i, pos0, CAST(pos0 + 7 + {_FIRST} + (size - {_FIRST}) + CAST(ceil((size - {_FIRST}) / 32761.0) AS BIGINT) * 7 AS BIGINT)
      FROM (SELECT d.*, CAST({_START} AS BIGINT) AS pos0 FROM f JOIN d ON d.log = f.log AND d.i = f.i + 1)),
    g AS (SELECT *, {_FIRST} AS head, CAST(1 + ceil((size - {_FIRST}) / 32761.0) AS INTEGER) AS p FROM f), h AS (SELECT *, unnest(range(p)) AS j FROM g)
    SELECT log, doc_id, CAST(j AS INTEGER) AS fragment, CAST(CASE WHEN j = 0 THEN pos0 ELSE pos0 + head + 7 + (j - 1) * 32768 END AS BIGINT) AS position,
      CASE WHEN p = 1 THEN 'full' WHEN j = 0 THEN 'first' WHEN j = p - 1 THEN 'last' ELSE 'middle' END AS kind, CAST(CASE WHEN j = 0 THEN head ELSE least(32761, size - head - (j - 1) * 32761) END AS BIGINT) AS length FROM h"""
)
def kv_wal_fragments(spark, sf):
    """A log of the documents of each language."""
    records = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("")).alias("log"), "doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return algos.fragments(records, "log", "doc_id", "size")


ODD = f"{WIDE}, odd AS (SELECT translate(k, '789', 'éè€') AS k, v, block FROM wide)"
SHARED = f"""{ODD}, p AS (SELECT *, hex(k) AS h, row_number() OVER w - 1 AS i, hex(lag(k) OVER w) AS before FROM odd WINDOW w AS (PARTITION BY block ORDER BY k)),
    s AS (SELECT *, CASE WHEN i % 16 = 0 THEN 0 ELSE len(list_filter(range(1, strlen(k) + 1), lambda j: substr(h, 1, 2 * j) = substr(before, 1, 2 * j) AND 2 * j <= len(before))) END AS shared FROM p)"""


def odd(spark, sf) -> DataFrame:
    """The orders' keys with letters of two and three bytes, some of which begin with the same byte."""
    return wide(spark, sf).withColumn("k", F.translate("k", "789", "éè€"))


@query(
    f"""WITH {SHARED} SELECT block, k, CAST(i AS BIGINT) AS i, CAST(shared AS INTEGER) AS shared, CAST(strlen(k) - shared AS INTEGER) AS unshared, CAST(3 + strlen(k) - shared + strlen(v) AS INTEGER) AS encoded,
    substr(h, 2 * shared + 1) AS suffix FROM s"""
)
def kv_prefix_block(spark, sf):
    out = algos.prefix_blocks(odd(spark, sf))
    return out.select("block", "k", F.col("i").cast("bigint"), "shared", F.col("unshared").cast("int"), F.col("encoded").cast("int"), F.hex("suffix").alias("suffix"))


@query(f"WITH {ODD} SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY k) - 1 AS BIGINT) AS i, k FROM odd")
def kv_prefix_decode(spark, sf):
    return algos.prefix_decode(algos.prefix_blocks(odd(spark, sf))).select("block", "i", F.col("k").cast("string").alias("k"))


@query(
    """WITH n AS (SELECT DISTINCT o_orderkey * o_orderkey * 129 + o_orderkey % 200 AS x FROM orders), s AS (SELECT x, CAST(greatest(ceil(length(bin(x)) / 7.0), 1) AS INTEGER) AS size FROM n)
    SELECT x, size, array_to_string(list_transform(range(size), lambda i: printf('%02X', ((x >> CAST(7 * i AS INTEGER)) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), '') AS bytes, x AS back FROM s"""
)
def kv_varint(spark, sf):
    n = table(spark, sf, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 129 + F.col("o_orderkey") % 200).alias("x")).distinct()
    packed = n.withColumn("b", bounds.varint(F.col("x")))
    return packed.select("x", bounds.varint_size(F.col("x")).alias("size"), F.hex("b").alias("bytes"), bounds.varint_value(F.col("b")).alias("back"))


@query(
    """WITH m AS (SELECT DISTINCT o_custkey AS n, md5(CAST(o_custkey AS VARCHAR)) AS m FROM orders) SELECT n, CAST(('0x' || substr(m, 13, 2) || substr(m, 11, 2) || substr(m, 9, 2) || substr(m, 7, 2)) AS BIGINT) AS u32,
    CAST(('0x' || substr(m, 3, 2) || substr(m, 1, 2)) AS BIGINT) AS u16, CAST(NULL AS BIGINT) AS beyond FROM m"""
)
def kv_le_integer(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("n")).distinct().withColumn("b", F.unhex(F.md5(F.col("n").cast("string").cast("binary"))))
    return m.select("n", bounds.integer(F.col("b"), F.lit(3), 4).alias("u32"), bounds.integer(F.col("b"), F.lit(0), 2).alias("u16"), bounds.integer(F.col("b"), F.lit(14), 4).alias("beyond"))


@query("SELECT * FROM (VALUES ('', 0), ('313233343536373839', 3808858755), ('" + "00" * 32 + "', 2324772522), ('" + "FF" * 32 + "', 1655221059), ('" + bytes(range(32)).hex().upper() + "', 1188919630)) t(bytes, crc)")
def kv_crc32c(spark, sf):
    """Published check values."""

    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.crc32c(bytes.fromhex(x)) for x in batch.column(0).to_pylist()], pa.int64())], ["bytes", "crc"])

    vectors = ["", "313233343536373839", "00" * 32, "FF" * 32, bytes(range(32)).hex().upper()]
    return spark.createDataFrame([(v,) for v in vectors], "bytes string").mapInArrow(sums, "bytes string, crc bigint")


@query(
    f"""WITH {WIDE}, p AS (SELECT *, row_number() OVER w - 1 AS i, 32 + coalesce(sum(strlen(k) + strlen(v) + 4) OVER (PARTITION BY block ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM wide WINDOW w AS (PARTITION BY block ORDER BY k))
    SELECT block, k, CAST(i AS BIGINT) AS i, CAST(o AS BIGINT) AS "offset", o + strlen(k) + strlen(v) + 4 <= 8192 - 2 * (i + 1) AS fits FROM p"""
)
def kv_slotted_layout(spark, sf):
    return algos.slotted(wide(spark, sf)).withColumn("i", F.col("i").cast("bigint"))


@query(f"WITH {WIDE}, p AS (SELECT block, k, row_number() OVER (PARTITION BY block ORDER BY k) - 1 AS i FROM wide) SELECT block, k, CAST(i AS BIGINT) AS i FROM p WHERE ends_with(k, '025')")
def kv_page_rank(spark, sf):
    ranked = wide(spark, sf).withColumn("i", (F.row_number().over(Window.partitionBy("block").orderBy("k")) - 1).cast("bigint"))
    return ranked.where(F.col("k").endswith("025")).select("block", "k", "i")


@query(FILES + "SELECT run, rows, CAST(greatest(64, rows * 10) AS BIGINT) AS bits, CAST(least(greatest(round(10 * ln(2)), 1), 12) AS BIGINT) AS probes FROM meta")
def kv_bloom_params(spark, sf):
    bits, probes = algos.bloom_parameters(F.col("rows"))
    return maintain.file_meta(runs(spark, sf)).select("run", "rows", bits.alias("bits"), probes.alias("probes"))


@query(
    """SELECT user_id AS k, count(*) FILTER (event_type IN ('click', 'view')) AS acquired, count(*) FILTER (event_type NOT IN ('click', 'view')) AS released,
    count(*) FILTER (event_type IN ('click', 'view')) - count(*) FILTER (event_type NOT IN ('click', 'view')) AS refs,
    count(*) FILTER (event_type IN ('click', 'view')) <> count(*) FILTER (event_type NOT IN ('click', 'view')) AS leak FROM events GROUP BY user_id"""
)
def kv_cache_refs(spark, sf):
    return algos.reference_counts(table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_type").isin("click", "view").alias("acquire")))


@query("SELECT user_id AS k, event_id AS txn, ts AS seq, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS successor FROM events WHERE event_type = 'purchase'")
def kv_lock_queue(spark, sf):
    waiting = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("event_id").alias("txn"), F.struct("ts", "event_id").alias("seq"))
    return algos.hand_off(waiting).select("k", "txn", "seq.ts", "successor").withColumnRenamed("ts", "seq")


@query(
    """SELECT name, CASE WHEN name IN ('WriteStall', 'LockHeld') THEN 'busy' WHEN name IN ('CorruptedWalRecord', 'UnsupportedFormat') THEN 'corruption' WHEN name = 'KeyNotFound' THEN 'not_found' WHEN name = 'EngineClosed' THEN 'retryable' ELSE 'fatal' END AS kind
    FROM (VALUES ('WriteStall'), ('LockHeld'), ('CorruptedWalRecord'), ('UnsupportedFormat'), ('KeyNotFound'), ('EngineClosed'), ('InvalidConfig')) t(name)"""
)
def kv_error_class(spark, sf):
    names = [*algos.ERROR_CLASSES, "InvalidConfig"]
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("kind", algos.error_class(F.col("name")))


@query(STORE + "SELECT to_json(struct_pack(k := k, v := v)) AS json FROM newest WHERE NOT tomb")
def kv_json_rows(spark, sf):
    return reads.live(mutlog(spark, sf)).select(F.to_json(F.struct("k", "v")).alias("json"))


@query(
    f"""WITH {MUT}, broken AS (SELECT CASE WHEN seq % 97 = 0 THEN seq - 1 ELSE seq END AS seq, CASE WHEN seq % 101 = 0 THEN '' ELSE k END AS k, tomb, CASE WHEN seq % 89 = 0 THEN 'ghost' ELSE v END AS v FROM mutlog WHERE seq % 103 <> 0),
    s AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq) AS before, count(*) OVER (PARTITION BY seq) AS same FROM broken)
    SELECT rule, n FROM (SELECT 'rows' AS rule, count(*) AS n FROM s UNION ALL SELECT 'empty_key', count(*) FROM s WHERE k = '' UNION ALL SELECT 'tombstone_with_value', count(*) FROM s WHERE tomb AND v IS NOT NULL
    UNION ALL SELECT 'repeated_seq', count(*) FROM s WHERE same > 1 UNION ALL SELECT 'missing_seq', max(seq) - count(DISTINCT seq) FROM s)"""
)
def kv_doctor(spark, sf):
    log = mutlog(spark, sf).where("seq % 103 <> 0")
    broken = log.select(F.expr("if(seq % 97 = 0, seq - 1, seq)").alias("seq"), F.expr("if(seq % 101 = 0, '', k)").alias("k"), "tomb", F.expr("if(seq % 89 = 0, 'ghost', v)").alias("v"))
    by_seq = broken.groupBy("seq").agg(F.count("*").alias("c"), F.count_if(F.col("k") == "").alias("e"), F.count_if(F.expr("tomb and v is not null")).alias("g"))
    totals = by_seq.agg(F.sum("c").alias("rows"), F.sum("e").alias("empty_key"), F.sum("g").alias("tombstone_with_value"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated_seq"), (F.max("seq") - F.count("*")).alias("missing_seq"))
    return totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("bigint").alias("n")) for c in totals.columns])).alias("x")).select("x.*")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def kv_typed_roundtrip(spark, sf):
    """Typed rows to (k, v) and back."""
    fields = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double"
    names = [x.split()[0] for x in fields.split(", ")]
    stored = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("k"), F.to_json(F.struct(*names)).alias("v"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(False).alias("tomb"))
    return reads.live(stored).select(F.from_json("v", fields).alias("x")).select("x.*")


_HASH = "CAST(('0x' || substr(md5(k), {0}, 8)) AS BIGINT)"
PROBED = f"""places AS (SELECT k, unnest(list_transform(range(7), lambda i: ({_HASH.format(1)} + i * {_HASH.format(9)}) % 2048)) AS p FROM (SELECT DISTINCT k FROM newest WHERE NOT tomb)),
    asked AS (SELECT concat('user:', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS k FROM customer),
    probed AS (SELECT k, unnest(list_transform(range(7), lambda i: ({_HASH.format(1)} + i * {_HASH.format(9)}) % 2048)) AS p FROM asked),
    may AS (SELECT k, bool_and(p IN (SELECT p FROM places)) AS may FROM probed GROUP BY k)"""


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))


@query(STORE.rstrip() + ", " + PROBED + " SELECT k, may FROM may")
def kv_bloom_probe(spark, sf):
    """Customers whose key may be among the live keys, by a filter of 2048 bits and 7 probes."""
    return algos.may_contain(customers(spark, sf), algos.bloom_bits(reads.live(mutlog(spark, sf)), 2048, 7), 2048, 7)


@query(STORE.rstrip() + ", " + PROBED + " SELECT count(*) AS asked, count(*) FILTER (may) AS passed, count(*) FILTER (may AND k IN (SELECT k FROM newest WHERE NOT tomb)) AS found FROM may")
def kv_guarded_probe(spark, sf):
    alive = reads.live(mutlog(spark, sf))
    return algos.guarded_probe(customers(spark, sf), alive, algos.bloom_bits(alive, 2048, 7), 2048, 7)


@query(
    f"""WITH {MUT}, h AS (SELECT DISTINCT k, {_HASH.format(1)} AS h FROM mutlog) SELECT k,
    CAST(CASE WHEN h % 16384 = 0 THEN 8 WHEN h % 4096 = 0 THEN 7 WHEN h % 1024 = 0 THEN 6 WHEN h % 256 = 0 THEN 5 WHEN h % 64 = 0 THEN 4 WHEN h % 16 = 0 THEN 3 WHEN h % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS height, CAST(h % 16 AS INTEGER) AS stripe FROM h"""
)
def kv_key_hashes(spark, sf):
    return mutlog(spark, sf).select("k").distinct().select("k", algos.tower_height(F.col("k")).alias("height"), algos.stripe(F.col("k"), 16).alias("stripe"))


@query(
    f"""WITH RECURSIVE {MUT}, f AS (SELECT k, min(seq) AS seq, any_value({_HASH.format(1)} % 64) AS home FROM mutlog GROUP BY k), r AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM f),
    c(i, k, slot, used) AS (SELECT CAST(0 AS BIGINT), '', CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
      UNION ALL SELECT i, k, slot, list_append(used, slot) FROM (SELECT r.i, r.k, used, list_filter(list_transform(range(64), lambda j: (home + j) % 64), lambda x: NOT list_contains(used, x))[1] AS slot FROM c JOIN r ON r.i = c.i + 1 WHERE r.i <= 64))
    SELECT r.k, CAST(home AS INTEGER) AS home, CAST(slot AS INTEGER) AS slot, slot IS NULL AS full FROM r LEFT JOIN (SELECT * FROM c WHERE i > 0) c ON c.i = r.i"""
)
def kv_cache_slots(spark, sf):
    return algos.cache_slots(mutlog(spark, sf).select("k", "seq"), 64)


LEVELED = """leveled AS (SELECT 1 AS level, c_custkey // 50 AS run, concat('user:', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS k FROM customer WHERE c_custkey % 50 < 30
    UNION ALL SELECT 2, 1000 + c_custkey // 200, concat('user:', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer), meta AS (SELECT level, run, min(k) AS min_k, max(k) AS max_k FROM leveled GROUP BY ALL)"""


def leveled(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))
    first = c.where("c_custkey % 50 < 30").select(F.lit(1).alias("level"), F.expr("c_custkey div 50").alias("run"), "k")
    rows = first.unionByName(c.select(F.lit(2).alias("level"), F.expr("1000 + c_custkey div 200").alias("run"), "k"))
    return rows.groupBy("level", "run").agg(F.min("k").alias("min_k"), F.max("k").alias("max_k"))


@query(f"WITH {MUT}, {LEVELED} SELECT k, level, run FROM (SELECT DISTINCT k FROM mutlog) JOIN meta ON k BETWEEN min_k AND max_k")
def kv_level_candidate(spark, sf):
    return algos.level_candidate(mutlog(spark, sf).select("k"), leveled(spark, sf))


@query(
    f"WITH {MUT}, {LEVELED}, s AS (SELECT * FROM meta WHERE level = 1 ORDER BY run LIMIT 1) SELECT *, 'source' AS role FROM s UNION ALL SELECT m.*, 'target' FROM meta m, s WHERE m.level = 2 AND m.max_k >= s.min_k AND s.max_k >= m.min_k"
)
def kv_compaction_pick(spark, sf):
    return maintain.pick(leveled(spark, sf), 1)


@query(FILES + "SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM meta WHERE run % 3 = 0")
def kv_pending_bytes(spark, sf):
    return maintain.pending_bytes(maintain.file_meta(runs(spark, sf)).withColumn("level", F.expr("if(run % 3 = 0, 0, 1)")))


@query(f"WITH {MUT}, r AS (SELECT k, seq, CAST(coalesce(sum(strlen(k) + coalesce(strlen(v), 0)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 16384 AS run FROM mutlog) SELECT run, count(*) AS n, max(seq) AS last FROM r GROUP BY run")
def kv_rotation(spark, sf):
    return maintain.rotate(mutlog(spark, sf), 16384).groupBy("run").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


LOCKS = """u AS (SELECT DISTINCT user_id AS t FROM events), n AS (SELECT count(*) AS n FROM u), owners AS (SELECT t AS k, (t * 7 + 3) % n AS owner FROM u, n WHERE t % 5 <> 0),
    waiting AS (SELECT t AS waiter, t + 5 AS owner FROM u, n WHERE t % 4 <> 0 AND t + 5 < n), requests AS (SELECT DISTINCT t AS txn, (t * j + 2) % n AS k FROM u, n, range(1, 12) r(j) WHERE t % 4 = 0)"""


@query(
    f"""WITH RECURSIVE {LOCKS}, asked AS (SELECT txn, r.k, o.owner FROM requests r LEFT JOIN owners o ON o.k = r.k),
    walk(txn, k, node, top) AS (SELECT txn, k, owner, greatest(txn, owner) FROM asked WHERE owner <> txn UNION ALL SELECT txn, k, w.owner, greatest(top, w.owner) FROM walk JOIN waiting w ON w.waiter = node WHERE node <> txn),
    closed AS (SELECT txn, k, top FROM walk WHERE node = txn)
    SELECT a.txn, a.k, CASE WHEN a.owner IS NULL THEN 'granted' WHEN a.owner = a.txn THEN 'reentrant' WHEN top = a.txn THEN 'deadlock' ELSE 'blocked' END AS outcome, top AS victim FROM asked a LEFT JOIN closed c ON c.txn = a.txn AND c.k = a.k"""
)
def kv_lock_outcomes(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("t")).distinct().withColumn("n", F.lit(table(spark, sf, "events").agg(F.count_distinct("user_id")).first()[0]))
    owners = u.where("t % 5 <> 0").select(F.col("t").alias("k"), F.expr("(t * 7 + 3) % n").alias("owner"))
    waiting = u.where("t % 4 <> 0 and t + 5 < n").select(F.col("t").alias("waiter"), (F.col("t") + 5).alias("owner"))
    requests = u.where("t % 4 = 0").select(F.col("t").alias("txn"), F.explode(F.expr("transform(sequence(1, 11), j -> (t * j + 2) % n)")).alias("k")).distinct()
    return algos.acquire(requests, owners, waiting)


@query(STORE + "SELECT concat_ws(chr(9), CAST(seq AS VARCHAR), CASE WHEN tomb THEN '1' ELSE '0' END, k, coalesce(v, '')) AS value FROM newest")
def kv_text_rows(spark, sf):
    return framed_log.text_lines(reads.newest(mutlog(spark, sf)))


_OPS = "CASE event_type WHEN 'click' THEN 'put' WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'other' END"


@query(
    f"""WITH seen AS (SELECT {_OPS} AS op, CAST(floor(value * 400) AS BIGINT) AS us FROM events), c AS (SELECT op, {_CASE} AS bound, count(*) AS n FROM seen GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bound) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM c), names AS (SELECT * FROM (VALUES ('put'), ('delete'), ('get'), ('scan')) a(op), (VALUES (50), (95), (99)) b(p))
    SELECT concat('engine.metrics.latency.', op, '.p', p, '_us') AS name, CAST(coalesce((SELECT min(bound) FROM u WHERE u.op = names.op AND upto * 100 >= total * p), 0) AS BIGINT) AS value FROM names"""
)
def kv_latency_properties(spark, sf):
    return metrics.latency_properties(table(spark, sf, "events").select(F.expr(_OPS).alias("op"), F.floor(F.col("value") * 400).alias("us")))


@query("SELECT event_type, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE sum(CAST(floor(value * 100000) AS BIGINT)) // count(*) // 1000 END AS BIGINT) AS avg_us FROM events GROUP BY event_type")
def kv_write_latency(spark, sf):
    ns = table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 100000).alias("ns"))
    return ns.groupBy("event_type").agg(F.sum("ns").alias("total"), F.count("*").alias("n")).select("event_type", metrics.average_write_us(F.col("total"), F.col("n")).alias("avg_us"))


# The store: what is written to the shared folder and read back.

SMALL = Config(file_bytes=1 << 14, level_base_bytes=1 << 12)


def operations(log: DataFrame) -> DataFrame:
    return log.select(F.when(F.col("tomb"), "delete").otherwise("put").alias("op"), "k", "v", F.col("seq").alias("ord"))


def loaded(spark, sf, config: Config = SMALL, parts: int = 5) -> Store:
    """The demonstration log in a store, as so many batches; level 0 is compacted on the way, into files of 16 KB."""
    store, ops = Store.open(spark, fresh(spark, "store"), config), operations(mutlog(spark, sf))
    total = ops.count()
    for i in range(parts):
        store.write_batch(ops.where(F.floor((F.col("ord") - 1) * parts / total) == i))
    return store


@query(SQL["kv_full_scan"])
def kv_store_scan(spark, sf):
    return loaded(spark, sf).scan()


@query(SQL["kv_range_scan"])
def kv_store_range(spark, sf):
    return loaded(spark, sf).scan("user:000010", "user:000020")


@query(SQL["kv_multi_get"])
def kv_store_multi_get(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))
    return loaded(spark, sf).multi_get(keys)


@query(f"WITH {MUT}, half AS (SELECT * FROM mutlog WHERE seq <= (SELECT count(*) // 2 FROM events)), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM half) WHERE r = 1) SELECT k, v, seq FROM newest WHERE NOT tomb")
def kv_store_snapshot(spark, sf):
    """A held snapshot is read after later batches and compactions."""
    store, ops = Store.open(spark, fresh(spark, "store"), SMALL), operations(mutlog(spark, sf))
    half = ops.count() // 2
    store.write_batch(ops.where(F.col("ord") <= half))
    seq = store.hold_snapshot("half")
    for i in range(3):
        store.write_batch(ops.where((F.col("ord") > half) & (F.col("ord") % 3 == i)))
    store.compact(0)
    store.compact(1)
    return store.scan(snapshot=seq)


@query(SQL["kv_full_scan"])
def kv_store_checkpoint(spark, sf):
    copy = fresh(spark, "copy")
    loaded(spark, sf).checkpoint(copy)
    return Store.open(spark, copy, SMALL).scan()


@query(SQL["kv_full_scan"])
def kv_store_replay(spark, sf):
    """The log in framed files, read back and replayed."""
    folder_ = fresh(spark, "log")
    ops = operations(mutlog(spark, sf))
    framed_log.write_framed_log(ops.withColumnRenamed("ord", "seq"), folder_, 4).collect()  # a row a file
    versions = framed_log.replay(framed_log.read_framed_log(spark, folder_))
    return reads.live(versions).select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "seq")


@query(SQL["kv_pitr_restore"])
def kv_store_restore(spark, sf):
    """Archived segments restored over a base store of bytes."""
    log, folder_ = mutlog(spark, sf), fresh(spark, "archive")
    framed_log.archive(log.withColumnRenamed("seq", "pos").withColumn("ts", F.col("ts").cast("timestamp")), folder_, 3).collect()  # a row a segment
    base = Store.open(spark, fresh(spark, "base"), SMALL, binary=True)
    base.write_batch(table(spark, sf, "customer").select(F.lit("put").alias("op"), F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).cast("binary").alias("k"), F.col("c_mktsegment").cast("binary").alias("v"), F.col("c_custkey").alias("ord")))
    restored = Store.restore(spark, fresh(spark, "restored"), base, framed_log.read_timed_log(spark, folder_), F.to_timestamp(F.lit(RESTORE_TO)), SMALL)
    return restored.scan().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query("SELECT concat('nation:', n_name) AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' ELSE CAST(n_regionkey AS VARCHAR) END AS v, CASE WHEN n_nationkey % 5 = 0 THEN 25 + (SELECT count(*) FROM nation m WHERE m.n_nationkey % 5 = 0 AND m.n_nationkey <= n.n_nationkey) ELSE n_nationkey + 1 END AS seq FROM nation n WHERE n_nationkey % 7 <> 3")
def kv_store_small_writes(spark, sf):
    """Puts, overwrites and deletions of single keys, replayed from the log by another handle; a part of them was flushed."""
    rows = sorted(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())  # 25 rows
    store = Store.open(spark, fresh(spark, "store"))
    for r in rows:
        store.put(f"nation:{r.n_name}", str(r.n_regionkey))
    store.flush()
    store.write_batch([("put", f"nation:{r.n_name}", "changed") for r in rows if r.n_nationkey % 5 == 0])
    for r in rows:
        if r.n_nationkey % 7 == 3:
            store.delete(f"nation:{r.n_name}")
    store.close()
    return Store.open(spark, store.path).scan().select("k", "v", "seq")


@query(f"WITH {MUT}, t AS (SELECT count(*) AS n FROM mutlog) SELECT rule, CAST(CASE WHEN rule = 'rows' THEN n ELSE 0 END AS BIGINT) AS n FROM t, (VALUES ('rows'), ('null_key'), ('tombstone_with_value'), ('repeated_seq'), ('seq_beyond_manifest'), ('missing_file'), ('file_differs'), ('bad_log')) r(rule)")
def kv_store_doctor(spark, sf):
    found = loaded(spark, sf, Config(auto_compact=False)).doctor()
    return spark.createDataFrame(list(found.items()), "rule string, n bigint")


@query(STORE + "SELECT count(*) FILTER (NOT tomb) AS keys, CAST(0 AS BIGINT) AS memory_keys, CAST(5 AS BIGINT) AS l0_runs, (SELECT max(seq) + 1 FROM mutlog) AS next_sequence FROM newest")
def kv_store_stats(spark, sf):
    found = loaded(spark, sf, Config(auto_compact=False)).stats()
    return spark.createDataFrame([tuple(found[n] for n in ("keys", "memory_keys", "l0_runs", "next_sequence"))], "keys bigint, memory_keys bigint, l0_runs bigint, next_sequence bigint")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
