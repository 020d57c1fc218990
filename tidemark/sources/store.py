"""A versioned key-value store: immutable sorted Parquet files, manifest versions that name them, and a framed log of small writes.

A commit writes files first and then creates manifest/<version>.json, which fails
if another writer has created that version.  Small writes append one framed record
to the log and are kept in memory until they fill the memtable; open() replays the
log.  Large writes come as DataFrames and go straight to files.  A missing or
unreadable file fails the open; so does an unreadable newest manifest.

Keys and values are strings, or raw bytes in a store opened with binary=True; both
are ordered by their bytes.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.bounds import check_bounds, prefix_end, text_prefix_end
from tidemark.model import MAX_LEVELS, CommitConflict, Corruption, InvalidConfig, KeyNotFound, KeyTooLarge, StoreClosed, UnknownProperty, WriteStall
from tidemark.operators import maintain, metrics, reads

LARGE_FILE = 128 << 20


@dataclass(frozen=True)
class Config:
    memtable_max_bytes: int = 64 * 1024
    max_key_size: int = 1024
    slowdown_l0_files: int = 8
    stop_l0_files: int = 12
    slowdown_immutable_count: int = 4
    stop_immutable_count: int = 8
    scheduler_queue_limit: int = 64
    compaction_trigger_l0_files: int = 4
    compaction_rate_bytes_per_sec: int = 8 * 1024 * 1024
    level_base_bytes: int = 256 << 20
    file_bytes: int = 128 << 20  # a run is split into files of about that size
    run_files: int = 64  # beyond so many files a run's are larger, up to 128 MB each
    auto_compact: bool = True

    def check(self) -> None:
        positive = (self.memtable_max_bytes, self.scheduler_queue_limit, self.compaction_rate_bytes_per_sec, self.file_bytes, self.run_files)
        if min(positive) <= 0 or self.slowdown_l0_files > self.stop_l0_files or self.slowdown_immutable_count > self.stop_immutable_count or not 0 < self.max_key_size < 1 << 16:
            raise InvalidConfig(f"{self}")


def check_path(path: str) -> None:
    if not path or ".." in path.split("/"):
        raise InvalidConfig(f"unsafe path {path!r}")


class Files:
    """The file system of a path, through the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> dict[str, int]:
        """Files below a folder, by name relative to the root, with the time of their last change in ms."""
        if not self.exists(folder):
            return {}
        base, found, listing = self.fs.makeQualified(self.path("")).toUri().getPath().rstrip("/") + "/", {}, self.fs.listFiles(self.path(folder), True)
        while listing.hasNext():
            status = listing.next()
            found[status.getPath().toUri().getPath().removeprefix(base)] = status.getModificationTime()
        return found

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Write a new file aside and give it its name, unless that is taken."""
        aside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        stream.write(bytearray(data))
        stream.close()
        never = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(self.path(aside)), self.fs.makeQualified(self.path(name)), never)
        except Py4JJavaError as why:
            self.fs.delete(self.path(aside), False)
            if "FileAlreadyExists" in str(why):
                raise CommitConflict(f"{name} was committed by another writer") from why
            raise


class Store:
    """Opened by Store.open(); a handle of one writer, or of any number of readers."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, config: Config):
        self.spark, self.path, self.manifest, self.config, self.closed = spark, path.rstrip("/"), manifest, config, False
        self.files = Files(spark, path)
        self.memory: list[tuple[int, str, bytes, bytes]] = []  # (seq, op, key, value) since the last flush, bounded by the memtable's size
        self.counts = dict.fromkeys(("put", "delete", "get", "hit", "miss", "scan", "wal", "flush", "compaction", "rate_limited", "sleep_ms", "stall", "stall_ms"), 0)
        self.latency = {op: [] for op in metrics.LATENCY_OPS}

    # Opening

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config(), binary: bool | None = None) -> Store:
        """Open or create a store; `binary` makes a new one hold bytes and must fit an old one."""
        config.check()
        check_path(path)
        files = Files(spark, path)
        if files.exists("CHECKPOINT_INCOMPLETE"):
            raise Corruption("incomplete checkpoint")
        versions = [int(n.removeprefix("manifest/")[:-5]) for n in files.names("manifest") if n.removeprefix("manifest/")[:-5].isdigit()]
        if versions:
            try:
                manifest = json.loads(files.read(f"manifest/{max(versions)}.json"))
            except ValueError as why:
                raise Corruption(f"manifest {max(versions)} is not readable") from why
            missing = {f["name"] for f in manifest["files"]} - files.names("data").keys()
            if missing:
                raise Corruption(f"{sorted(missing)[0]} is missing")
            if binary is not None and binary != manifest["binary"]:
                raise InvalidConfig(f"the store has binary={manifest['binary']}")
        else:
            manifest = {"version": 0, "binary": bool(binary), "next_sequence": 1, "next_run": 1, "files": [], "snapshots": {}, "horizon": 0, "streams": {}}
        store = cls(spark, path, manifest, config)
        store._replay()
        return store

    def _replay(self) -> None:
        """Take the log's records into memory, whose size bounds the log's."""
        for name in sorted(self.files.names("log")):
            if not name.endswith(".log") or int(name[4:-4]) < self.manifest["next_sequence"]:
                continue
            for record in codec.records(self.files.read(name)):
                for seq, op, k, v in codec.decode(record):
                    if seq != self.next_sequence:
                        raise Corruption(f"{name} has sequence {seq} where {self.next_sequence} is due")
                    self.memory.append((seq, "put" if op == codec.PUT else "delete", k, v))

    @property
    def next_sequence(self) -> int:
        return self.memory[-1][0] + 1 if self.memory else self.manifest["next_sequence"]

    def close(self) -> None:
        """Idempotent; what is in memory stays in the log and is replayed."""
        self.closed = True

    def _live(self) -> None:
        if self.closed:
            raise StoreClosed("store is closed")

    # Types

    def _bytes(self, x) -> bytes:
        return bytes(x) if self.manifest["binary"] else x.encode()

    def _type(self) -> str:
        return "binary" if self.manifest["binary"] else "string"

    def _schema(self) -> str:
        return f"k {self._type()}, seq bigint, tomb boolean, v {self._type()}"

    def _bound(self, text: str | None):
        return None if text is None else bytes.fromhex(text) if self.manifest["binary"] else bytes.fromhex(text).decode()

    # Commits

    def _commit(self, **changes) -> None:
        following = self.manifest | changes | {"version": self.manifest["version"] + 1}
        self.files.create(f"manifest/{following['version']}.json", json.dumps(following).encode())
        self.manifest = following

    def _pieces(self, size: int) -> int:
        """Files of a run of `size` bytes; each is a task and a row of the manifest, so small ones are not as many as the run is large."""
        return max(1, -(-size // max(self.config.file_bytes, min(-(-size // self.config.run_files), LARGE_FILE))))

    def _add(self, rows: DataFrame, level: int, run: int, pieces: int) -> list[dict]:
        """Write sorted files that do not overlap and describe each of them."""
        folder = f"data/level={level}/run={run}-{uuid.uuid4().hex[:8]}"
        sorted_ = rows.select("k", "seq", "tomb", "v").repartitionByRange(pieces, "k").sortWithinPartitions("k", "seq")
        sorted_.write.parquet(f"{self.path}/{folder}")
        about = self.spark.read.schema(self._schema()).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("name"))
        about = about.agg(F.hex(F.min("k").cast("binary")).alias("lo"), F.hex(F.max("k").cast("binary")).alias("hi"), F.count("*").alias("rows"), F.sum(reads.entry_bytes() + maintain.ENTRY_OVERHEAD).alias("bytes"), F.max("seq").alias("last"))
        return [{"name": f"{folder}/{r['name']}", "level": level, "run": run, "min_k": r.lo, "max_k": r.hi, "rows": r["rows"], "bytes": r["bytes"], "max_seq": r["last"]} for r in about.collect()]  # a row a file, as the manifest has

    def _frame(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*[f"{self.path}/{f['name']}" for f in files])

    def _in_memory(self) -> DataFrame:
        typed = (lambda x: bytearray(x)) if self.manifest["binary"] else (lambda x: x.decode())
        return self.spark.createDataFrame([(typed(k), seq, op == "delete", typed(v) if op == "put" else None) for seq, op, k, v in self.memory], self._schema())

    # Writes

    def _pressure(self) -> None:
        l0 = len({f["run"] for f in self.manifest["files"] if f["level"] == 0})
        if l0 >= self.config.stop_l0_files:
            self.counts["stall"] += 1
            raise WriteStall(f"{l0} runs wait for compaction")
        if l0 >= self.config.slowdown_l0_files:
            self.counts["stall"], self.counts["stall_ms"] = self.counts["stall"] + 1, self.counts["stall_ms"] + 1
            time.sleep(0.001)

    def write_batch(self, ops, stream: tuple[str, int] | None = None) -> None:
        """ops: a list of (op, key, value), or a DataFrame (op, k, v, ord); all are checked before any is written, and they commit as one.

        `stream` (query, batch) is committed with a DataFrame: a batch that it names already is not written again."""
        self._live()
        if stream and self.manifest["streams"].get(stream[0], -1) >= stream[1]:
            return
        self._pressure()
        if isinstance(ops, DataFrame):
            self._write_rows(ops, stream)
        elif ops:
            self._write_list(ops)

    def _write_list(self, ops) -> None:
        began, packed = time.perf_counter(), []
        if len(ops) > 65535:
            raise InvalidConfig("more than 65,535 operations; write a DataFrame instead")
        for op, k, v in ops:
            if op not in ("put", "delete") or k is None or (op == "put" and v is None):
                raise InvalidConfig(f"bad operation {op!r}")
            key = self._bytes(k)
            if len(key) > self.config.max_key_size:
                raise KeyTooLarge(f"key of {len(key)} bytes")
            packed.append((codec.PUT if op == "put" else codec.DELETE, key, self._bytes(v) if op == "put" else b""))
        base = self.next_sequence
        record = codec.encode(base, packed)
        self.files.create(f"log/{base:020d}.log", codec.frame([record]))
        self.counts["wal"] += len(record)
        self.memory += [(base + i, "put" if op == codec.PUT else "delete", k, v) for i, (op, k, v) in enumerate(packed)]
        for op, _, _ in ops:
            self.counts[op] += 1
        if len(ops) == 1:
            self.latency[ops[0][0]].append(int((time.perf_counter() - began) * 1e9))
        if self.memtable_bytes() >= self.config.memtable_max_bytes:
            self.flush()

    def _write_rows(self, ops: DataFrame, stream) -> None:
        self.flush()
        bad = ops.where(~F.col("op").isin("put", "delete") | F.col("k").isNull() | (F.octet_length("k") > self.config.max_key_size) | ((F.col("op") == "put") & F.col("v").isNull())).select("op", F.octet_length("k").alias("n")).head()
        if bad:
            raise KeyTooLarge(f"key of {bad['n']} bytes") if (bad["n"] or 0) > self.config.max_key_size else InvalidConfig(f"bad operation {bad}")
        # Rows are numbered where they are: ranges of `ord` are counted, and each row adds its place to what stands before its range.
        aside = f".staged-{uuid.uuid4().hex}"
        staged = ops.select("op", "k", "v", "ord").repartitionByRange("ord", "k").sortWithinPartitions("ord", "k", "op", "v")
        numbered = staged.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        numbered.write.parquet(f"{self.path}/{aside}")
        try:
            rows = self.spark.read.schema(numbered.schema).parquet(f"{self.path}/{aside}")
            before, starts = 0, []
            for r in sorted(rows.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
                starts.append((r["part"], before))
                before += r["n"]
            changes = {"streams": self.manifest["streams"] | {stream[0]: stream[1]}} if stream else {}
            if starts:
                base, offsets = self.manifest["next_sequence"], self.spark.createDataFrame(starts, "part int, start bigint")
                seq = (F.col("start") + F.col("i") + base).alias("seq")
                typed = rows.join(F.broadcast(offsets), "part").select(F.col("k").cast(self._type()), seq, (F.col("op") == "delete").alias("tomb"), F.when(F.col("op") == "put", F.col("v").cast(self._type())).alias("v"))
                run = self.manifest["next_run"]
                size = typed.agg(F.sum(reads.entry_bytes() + maintain.ENTRY_OVERHEAD)).first()[0]
                added = self._add(typed, 0, run, self._pieces(size))
                self._commit(files=self.manifest["files"] + added, next_sequence=base + before, next_run=run + 1, **changes)
            elif stream:
                self._commit(**changes)
        finally:
            self.files.delete(aside)
        self._after_flush()

    def put(self, key, value) -> None:
        self.write_batch([("put", key, value)])

    def delete(self, key) -> None:
        self.write_batch([("delete", key, None)])

    def memtable_bytes(self) -> int:
        """Bytes of the newest entries in memory; a tombstone keeps its key's."""
        return sum(len(k) + len(v) for k, v in {k: v for _, _, k, v in self.memory}.items())

    def flush(self) -> None:
        """Memory to a run of level 0; the log's records that it holds go."""
        if not self.memory:
            return
        run, following = self.manifest["next_run"], self.next_sequence
        self._commit(files=self.manifest["files"] + self._add(self._in_memory(), 0, run, 1), next_sequence=following, next_run=run + 1)
        self.memory = []
        self.counts["flush"] += 1
        for name in self.files.names("log"):
            if name.endswith(".log") and int(name[4:-4]) < following:
                self.files.delete(name)
        self._after_flush()

    def _after_flush(self) -> None:
        l0 = len({f["run"] for f in self.manifest["files"] if f["level"] == 0})
        if self.config.auto_compact and l0 >= self.config.compaction_trigger_l0_files:
            self.compact(0)
            while (due := self.due_level()) is not None:
                self.compact(due)

    def due_level(self) -> int | None:
        """The first level below level 0 that holds more than its target."""
        for level in range(1, MAX_LEVELS - 1):
            if sum(f["bytes"] for f in self.manifest["files"] if f["level"] == level) > self.config.level_base_bytes * 10**level:
                return level
        return None

    # Reads

    def snapshot(self) -> int:
        return self.next_sequence - 1

    def hold_snapshot(self, name: str) -> int:
        """A snapshot that compaction keeps readable until release_snapshot(name)."""
        self._live()
        self.flush()
        seq = self.snapshot()
        self._commit(snapshots=self.manifest["snapshots"] | {name: seq})
        return seq

    def release_snapshot(self, name: str) -> None:
        self._live()
        self._commit(snapshots={n: s for n, s in self.manifest["snapshots"].items() if n != name})

    def _readable(self, snapshot: int | None) -> None:
        if snapshot is not None and snapshot < self.manifest["horizon"] and snapshot not in self.manifest["snapshots"].values():
            raise InvalidConfig(f"snapshot {snapshot} was not held and is compacted away")

    def _overlapping(self, files: list[dict], start, end) -> list[dict]:
        return [f for f in files if (end is None or self._bound(f["min_k"]) < end) and (start is None or self._bound(f["max_k"]) >= start)]

    def rows(self, start=None, end=None) -> DataFrame:
        """All versions in the range, from the files whose zone map meets it and from memory."""
        self._live()
        check_bounds(start, end)
        stored = self._frame(self._overlapping(self.manifest["files"], start, end))
        return stored.unionByName(self._in_memory()) if self.memory else stored

    def scan(self, start=None, end=None, snapshot=None) -> DataFrame:
        self._readable(snapshot)
        began = time.perf_counter()
        found = reads.scan(self.rows(start, end), start, end, snapshot)
        self.counts["scan"] += 1
        self.latency["scan"].append(int((time.perf_counter() - began) * 1e9))
        return found

    def scan_prefix(self, prefix, snapshot=None) -> DataFrame:
        return self.scan(prefix or None, prefix_end(prefix) if self.manifest["binary"] else text_prefix_end(prefix), snapshot)

    def get(self, key, snapshot=None):
        self._readable(snapshot)
        began = time.perf_counter()
        zero = b"\0" if self.manifest["binary"] else "\0"
        found = reads.get(self.rows(key, key + zero), key, snapshot).head()
        self.counts["get"] += 1
        self.counts["miss" if found is None else "hit"] += 1
        self.latency["get"].append(int((time.perf_counter() - began) * 1e9))
        if found is None:
            raise KeyNotFound(key)
        return bytes(found["v"]) if self.manifest["binary"] else found["v"]

    def multi_get(self, keys: DataFrame, snapshot=None) -> DataFrame:
        """Live rows of the keys in column k of `keys`, from the files between the least and the greatest of them."""
        self._readable(snapshot)
        low, high = keys.agg(F.min("k"), F.max("k")).first()
        if low is None:
            return reads.live(self.rows().limit(0))
        low, high = (bytes(low), bytes(high)) if self.manifest["binary"] else (low, high)
        return reads.multi_get(self.rows(low, high + (b"\0" if self.manifest["binary"] else "\0")), keys, snapshot)

    # Maintenance

    def compact(self, level: int = 0) -> bool:
        """Merge files of a level with the overlapping ones of the next: all of level 0, of a deeper level the oldest run.

        Versions that a held snapshot sees stay, and so do all above the oldest held one; of others only the newest."""
        self._live()
        files = self.manifest["files"]
        level_files = [f for f in files if f["level"] == level]
        if not level_files or level + 1 >= MAX_LEVELS:
            return False
        source = level_files if level == 0 else [f for f in level_files if f["run"] == min(x["run"] for x in level_files)]
        low, high = min(self._bound(f["min_k"]) for f in source), max(self._bound(f["max_k"]) for f in source)
        meets = lambda f: self._bound(f["max_k"]) >= low and self._bound(f["min_k"]) <= high
        target = [f for f in files if f["level"] == level + 1 and meets(f)]
        low, high = min([low, *(self._bound(f["min_k"]) for f in target)]), max([high, *(self._bound(f["max_k"]) for f in target)])
        deeper = self._frame([f for f in files if f["level"] > level + 1 and meets(f)])
        gone, held = {f["name"] for f in source + target}, sorted(set(self.manifest["snapshots"].values()))
        size = sum(f["bytes"] for f in source + target)
        if held:
            every = self._frame(source + target)
            merged = every.where(F.col("seq") > held[0]).unionByName(reads.newest(every, held[0]).select("k", "seq", "tomb", "v"))
        else:
            merged = maintain.compact_level(self._frame(source), self._frame(target), deeper)
        run = self.manifest["next_run"]
        added = self._add(merged, level + 1, run, self._pieces(size))
        horizon = max(self.manifest["horizon"], held[0] if held else max(f["max_seq"] for f in source + target))
        self._commit(files=[f for f in files if f["name"] not in gone] + added, next_run=run + 1, horizon=horizon)
        self.counts["compaction"] += 1
        return True

    def vacuum(self, age_seconds: float = 3600.0) -> list[str]:
        """Delete files that the current version does not name and that are older than `age_seconds`: a younger one may be of a commit under way."""
        self._live()
        named, before = {f["name"] for f in self.manifest["files"]}, (time.time() - age_seconds) * 1000
        gone = [n for n, changed in self.files.names("data").items() if n.endswith(".parquet") and n not in named and changed <= before]
        for name in gone:
            self.files.delete(name)
        return gone

    def checkpoint(self, path: str) -> None:
        """Copy the current version, log included, to a new folder; the marker goes last, so a torn copy does not open."""
        self._live()
        check_path(path)
        copy = Files(self.spark, path)
        if copy.exists(""):
            raise InvalidConfig(f"{path} exists")
        copy.fs.mkdirs(copy.path(""))
        copy.fs.create(copy.path("CHECKPOINT_INCOMPLETE")).close()
        names = [f["name"] for f in self.manifest["files"]] + [n for n in self.files.names("log") if n.endswith(".log") and int(n[4:-4]) >= self.manifest["next_sequence"]]
        util = self.files.jvm.org.apache.hadoop.fs.FileUtil

        def move(name: str) -> None:
            copy.fs.mkdirs(copy.path(name.rpartition("/")[0]))
            util.copy(self.files.fs, self.files.path(name), copy.fs, copy.path(name), False, False, self.files.conf)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, names))
        copy.create("manifest/1.json", json.dumps(self.manifest | {"version": 1}).encode())
        copy.fs.create(copy.path("CHECKPOINT_COMPLETE")).close()
        copy.fs.delete(copy.path("CHECKPOINT_INCOMPLETE"), False)

    def doctor(self) -> dict[str, int]:
        """Counts of what breaks a rule: rows and files that are missing or differ from the manifest, log files that do not decode."""
        self._live()
        files, present = self.manifest["files"], self.files.names("data")
        there = [f for f in files if f["name"] in present]
        rows = self._frame(there)
        by_seq = rows.groupBy("seq").agg(F.count("*").alias("c"), F.count_if(F.col("k").isNull()).alias("e"), F.count_if(F.expr("tomb and v is not null")).alias("g"))
        found = by_seq.agg(F.sum("c"), F.sum("e"), F.sum("g"), F.count_if(F.col("c") > 1), F.count_if(F.col("seq") >= self.manifest["next_sequence"])).first()
        result = dict(zip(("rows", "null_key", "tombstone_with_value", "repeated_seq", "seq_beyond_manifest"), (x or 0 for x in found), strict=True))
        kept = {r["n"]: tuple(r)[1:] for r in rows.groupBy(F.col("_metadata.file_name").alias("n")).agg(F.hex(F.min("k").cast("binary")), F.hex(F.max("k").cast("binary")), F.count("*")).collect()} if there else {}
        differ = sum(kept.get(f["name"].rpartition("/")[2]) != (f["min_k"], f["max_k"], f["rows"]) for f in there)
        bad = 0
        for name in self.files.names("log"):
            try:
                for record in codec.records(self.files.read(name)) if name.endswith(".log") else ():
                    codec.decode(record)
            except Corruption:
                bad += 1
        return result | {"missing_file": len(files) - len(there), "file_differs": differ, "bad_log": bad}

    def stats(self) -> dict[str, int]:
        self._live()
        files = self.manifest["files"]
        newest = {k: op for _, op, k, _ in self.memory}
        return {
            "keys": reads.live(self.rows()).count(), "memory_keys": sum(op == "put" for op in newest.values()), "runs": len({f["run"] for f in files}), "files": len(files),
            "l0_runs": len({f["run"] for f in files if f["level"] == 0}), "bytes": sum(f["bytes"] for f in files), "next_sequence": self.next_sequence, "wal_size_bytes": self.counts["wal"],
        }

    def properties(self) -> dict[str, int | str]:
        """All named properties of this handle."""
        self._live()
        l0 = [f for f in self.manifest["files"] if f["level"] == 0]
        state = metrics.stall_of(0, len({f["run"] for f in l0}), self.config)
        writes = self.latency["put"] + self.latency["delete"]
        found = metrics.platform() | {
            "memtable.bytes": self.memtable_bytes(), "l0.files": len(l0), "pending_compaction_bytes": sum(f["bytes"] for f in l0), "compaction.rate_limit.bytes_per_sec": self.config.compaction_rate_bytes_per_sec,
            "cache.usage_bytes": 0, "stall.state": state[0], "stall.reason": state[1], "scheduler.flush_queue_depth": 0, "scheduler.compaction_queue_depth": 0,
        }
        names = {"put": "put.count", "delete": "delete.count", "get": "get.count", "hit": "get.hit.count", "miss": "get.miss.count", "scan": "scan.count", "wal": "wal.bytes", "flush": "flush.count", "compaction": "compaction.count", "rate_limited": "compaction.rate_limited.count", "sleep_ms": "compaction.rate_limit.sleep_ms", "stall": "stall.count", "stall_ms": "stall.duration_ms"}
        found |= {f"metrics.{name}": self.counts[c] for c, name in names.items()}
        found |= {"metrics.write_latency.max_us": max(writes, default=0) // 1000, "metrics.write_latency.avg_us": sum(writes) // len(writes) // 1000 if writes else 0}
        for op, seen in self.latency.items():
            found |= {f"metrics.latency.{op}.p{p}_us": metrics.percentile_of(seen, p) for p in (50, 95, 99)}
        return {f"engine.{name}": value for name, value in found.items()}

    def property(self, name: str) -> int | str:
        found = self.properties()
        if name not in found:
            raise UnknownProperty(name)
        return found[name]

    # Restoring

    @classmethod
    def restore(cls, spark: SparkSession, path: str, base: Store, log: DataFrame, target, config: Config = Config()) -> Store:
        """A new store at `path`: the live rows of `base` and the records of `log` (pos, ts, k, tomb, v) before the first one at or after `target`."""
        if Files(spark, path).exists("manifest"):
            raise InvalidConfig(f"{path} exists")
        store = cls.open(spark, path, config, base.manifest["binary"])
        found = maintain.restore_until(reads.live(base.rows()).select("k", "v"), log, target)
        aside = f".staged-{uuid.uuid4().hex}"
        try:  # written once, as write_batch reads its rows several times and a log is slow to decode
            found.write.parquet(f"{store.path}/{aside}")
            rows = spark.read.schema(found.schema).parquet(f"{store.path}/{aside}")
            store.write_batch(rows.select(F.lit("put").alias("op"), "k", "v", F.col("k").alias("ord")))
        finally:
            store.files.delete(aside)
        return store
