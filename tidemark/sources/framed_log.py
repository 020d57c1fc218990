"""Framed logs, time-stamped segments and tab-separated runs: readers on any file system that Spark reads, and sinks.

A file is read by one task, which hands it to Python in slices.  The sinks write from
their tasks through pyarrow, whose file systems are file, hdfs, s3 and gs; other schemes
are refused.  They begin a new file when one is full.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import codec
from tidemark.model import Corruption, InvalidConfig
from tidemark.operators.maintain import ENTRY_OVERHEAD, segment_order
from tidemark.operators.reads import entry_bytes

LOG = "path string, seq bigint, op string, k binary, v binary"
FRAGMENTS = "path string, position bigint, type int, length int"
TIMED = "path string, i bigint, us bigint, tomb boolean, k binary, v binary"
SINK_SCHEMES = ("file", "hdfs", "s3", "gs")
SLICE = 32 * codec.BLOCK  # what Python gets of a file at once
FILE_BYTES = 16 << 20  # a sink's file ends with the batch of rows that fills it
FILES_A_TASK = 1_000_000  # numbers that a sink's task has for its files
OUT_ROWS, OUT_BYTES = 10_000, 8 << 20


def _slices(spark: SparkSession, path: str) -> DataFrame:
    """(path, data): the files under `path`, each as consecutive rows of one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.octet_length("content") > 0)
    starts = F.sequence(F.lit(1), F.octet_length("content"), F.lit(SLICE))
    return files.select("path", F.explode(F.transform(starts, lambda i: F.substring("content", i, F.lit(SLICE)))).alias("data"))


def _decoded(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    """Rows of `schema`, a file's path and what `rows_of` makes of its slices, whatever the size of the file."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), target.types, strict=True)], schema=target)

        slices = ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
        held, size = [], 0
        for name, of_file in groupby(slices, key=lambda x: x[0]):
            for row in rows_of(data for _, data in of_file):
                held.append((name, *row))
                size += sum(len(x) for x in row if type(x) is bytes)
                if len(held) >= OUT_ROWS or size >= OUT_BYTES:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return _slices(spark, path).mapInArrow(decode, schema)


def read_framed_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, op, k, v) of the operations in the log files under `path`; a deletion has no value."""

    def rows(slices):
        for record in codec.records_of(slices):
            for seq, op, k, v in codec.decode(record):
                yield seq, "put" if op == codec.PUT else "delete", k, v if op == codec.PUT else None

    return _decoded(spark, path, rows, LOG)


def list_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, type, length) of each fragment, without a look at checksums."""

    def rows(slices):
        base = 0
        for data in slices:
            for at, kind, part in codec.fragments(data, check=False, base=base):
                yield at, kind, len(part)
            base += len(data)

    return _decoded(spark, path, rows, FRAGMENTS)


def replay(log: DataFrame) -> DataFrame:
    """A log's operations as versions (k, seq, tomb, v)."""
    return log.select("k", "seq", (F.col("op") == "delete").alias("tomb"), "v")


def read_timed_log(spark: SparkSession, path: str) -> DataFrame:
    """Segments of time-stamped records: (path, pos, ts, tomb, k, v), pos rising in the order of the segments' numbers and then of their records."""
    rows = _decoded(spark, path, lambda slices: ((i, *codec.decode_timed(r)) for i, r in enumerate(codec.records_of(slices))), TIMED)
    name = F.element_at(F.split("path", "/"), -1)
    number = F.coalesce(segment_order(name), F.lit((1 << 63) - 1))
    return rows.select("path", F.struct(number.alias("segment"), name.alias("name"), "i").alias("pos"), F.timestamp_micros("us").alias("ts"), "tomb", "k", "v")


def _sink(ordered: DataFrame, folder: str, name: str, record) -> DataFrame:
    """Files of about FILE_BYTES, numbered by partition and then in order, each written aside and moved into place, so that a task that runs again replaces its own; (path, records, bytes) of each."""
    scheme = folder.split("://")[0] if "://" in folder else "file"
    if scheme not in SINK_SCHEMES:
        raise InvalidConfig(f"can't write to {scheme}")
    target = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task, out, n, size, full = TaskContext.get(), None, 0, 0, 0
        store, root = fs.FileSystem.from_uri(target)
        aside = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}"
        place = lambda: f"{root}/{name.format(task.partitionId() * FILES_A_TASK + full)}"

        def moved():
            out.close()
            store.move(aside, place())
            return pa.RecordBatch.from_pydict({"path": [f"{target}/{place().rpartition('/')[2]}"], "records": [n], "bytes": [size]})

        for batch in batches:
            framed = codec.frame([record(row) for row in batch.to_pylist()], size)
            if out is None and framed:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(aside)
            if framed:
                out.write(framed)
            n, size = n + batch.num_rows, size + len(framed)
            if size >= FILE_BYTES:
                yield moved()
                out, n, size, full = None, 0, 0, full + 1
        if out is not None:
            yield moved()
            full += 1
        while store.get_file_info(place()).type != fs.FileType.NotFound:  # of an attempt that cut its rows elsewhere
            store.delete_file(place())
            full += 1

    return ordered.mapInArrow(write, "path string, records bigint, bytes bigint")


def _ranges(rows: DataFrame, least: int) -> int:
    """Ranges of about FILE_BYTES, so that tasks stay small when a log is large."""
    return max(least, -(-(rows.agg(F.sum(entry_bytes() + ENTRY_OVERHEAD)).first()[0] or 0) // FILE_BYTES))


def write_framed_log(rows: DataFrame, folder: str, files: int) -> DataFrame:
    """Append (seq, op, k, v) to `files` log files or more, which follow one another by sequence; runs when the result does."""
    ordered = rows.select("seq", "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v")).repartitionByRange(_ranges(rows, files), "seq").sortWithinPartitions("seq")
    return _sink(ordered, folder, "{:020d}.log", lambda r: codec.encode(r["seq"], [(codec.PUT if r["op"] == "put" else codec.DELETE, r["k"], r["v"] or b"")]))


def archive(rows: DataFrame, folder: str, segments: int) -> DataFrame:
    """Write (pos, ts, tomb, k, v) as `segments` segments wal-<number> or more, in the order of pos; runs when the result does."""
    ordered = rows.select("pos", F.unix_micros("ts").alias("us"), "tomb", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v")).repartitionByRange(_ranges(rows, segments), "pos").sortWithinPartitions("pos")
    return _sink(ordered, folder, "wal-{}", lambda r: codec.encode_timed(r["us"], r["tomb"], r["k"], r["v"] or b""))


def read_text_run(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """Rows of tab-separated run files; each begins with `<magic> <major> [<minor>] <level>`, and majors other than 1 or minors above 1 are refused."""
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"))
    fine = F.col("value").rlike(rf"^{magic} 1( [01])? \d+$")
    heads = lines.groupBy("file").agg(F.count_if(fine).alias("good"), F.count_if(F.col("value").startswith(magic) & ~fine).alias("other"))
    bad = heads.where("good <> 1 or other > 0").head()
    if bad or heads.isEmpty():
        raise Corruption(f"no supported header in {bad['file'] if bad else path}")
    parts = F.split("value", "\t", 4)
    body = lines.where(~F.col("value").startswith(magic) & (F.col("value") != ""))
    tomb = parts[1] == "1"
    return body.select(parts[2].alias("k"), parts[0].cast("bigint").alias("seq"), tomb.alias("tomb"), F.when(~tomb, parts[3]).alias("v"))


def text_lines(rows: DataFrame) -> DataFrame:
    """seq, tombstone, key and value as tab-separated lines, in the order of keys, as read_text_run reads them back."""
    value = F.concat_ws("\t", F.col("seq").cast("string"), F.when(F.col("tomb"), "1").otherwise("0"), "k", F.coalesce("v", F.lit("")))
    return rows.orderBy("k").select(value.alias("value"))


def write_text_run(rows: DataFrame, path: str, magic: str, level: int) -> None:
    """One run file a range of keys, each with its header."""
    lines = rows.repartitionByRange("k").sortWithinPartitions("k")

    def write(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            out = [] if begun else [f"{magic} 1 1 {level}"]
            begun = True
            out += [f"{r['seq']}\t{int(r['tomb'])}\t{r['k']}\t{r['v'] or ''}" for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"value": out})

    lines.select("seq", "tomb", "k", "v").mapInArrow(write, "value string").write.text(path)
