"""WARC archives: a writer with payload-digest revisits, and a salvage reader.

Each record is a gzip member of its own.  The reader checks members, version
lines, lengths and payload digests.  After a failed check it searches for the
next member or version line that parses, goes on from there, and reports the
bytes in between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, fresh_path

LEAST_DEDUPED = 100  # smaller payloads are always stored
ROLL_BYTES = 32 << 20  # an archive ends once it is so large
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_END = re.compile(rb"WARC/1\.[01]$")
URN = "urn:tidemark:page:"
CHUNK = 1 << 16


# Writing


def member(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def writer(folder: str):
    """mapInArrow function (page_id, url, payload, digest, refers_to) -> (path, records, bytes), a row for each archive written.

    Archives are named by partition, written aside and moved into place, so a task that runs again replaces its own files."""

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, out, records, size = task.partitionId(), 0, None, 0, 0

        def finish():
            out.close()
            name = f"{root}/part-{part:05d}-{number:05d}.warc.gz"
            store.move(aside, name)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    aside = f"{root}/.part-{part:05d}-{number:05d}-{task.taskAttemptId()}"
                    out, records, size = store.open_output_stream(aside), 0, 0
                packed = member(*row)
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= ROLL_BYTES:
                    yield finish()
                    out, number = None, number + 1
        if out is not None:
            yield finish()

    return write


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record for each row and return (path, records, bytes), one row for each archive.

    A null html is an empty payload.  Of records with equal payloads of
    LEAST_DEDUPED bytes or more, the smallest id is stored and the others revisit
    it; rows repeated under that id are all stored.  A row without an id can
    revisit but is never referred to.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_DEDUPED)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("digest", "first")
    refers = F.expr(f"if(octet_length(payload) >= {LEAST_DEDUPED} and (page_id is null or page_id <> first), first, null)")
    ready = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return cut(ready.mapInArrow(writer(fresh_path(pages.sparkSession, "warc")), "path string, records long, bytes long"), "archives")


# Salvage reading


def _headers(text: bytes) -> dict[str, str]:
    found = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def _runs_into_next(text: bytes) -> bool:
    """Whether headers were cut and go on with those of the record behind: a line ends as a version line does, and it is no header or the fields start over."""
    lines = text.split(b"\r\n")
    names = [line.partition(b":")[0].strip().lower() if b":" in line else None for line in lines]
    return any(names[i] is None or set(names[: i + 1]) & (set(names[i + 1 :]) - {None}) for i, line in enumerate(lines) if VERSION_END.search(line))


def parse_record(data: bytes, at: int) -> tuple[dict | str, int]:
    """The record at `at` and the offset behind it, or the reason why none is valid there."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line", at
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        return "headers do not end", at
    if _runs_into_next(data[version.end() : end]):
        return "headers cut short", at
    head = _headers(data[version.end() : end])
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        return "headers incomplete", at
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "length does not fit", at
    block = data[start:stop]
    split = block.find(b"\r\n\r\n")
    http, payload = (_headers(block[:split]), block[split + 4 :]) if block.startswith(b"HTTP/") and split >= 0 else ({}, block)
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    length = len(payload)
    if head["warc-type"] == "revisit":
        length = int(http.get("content-length", "0")) if http.get("content-length", "0").isdigit() else 0
    elif re.fullmatch("[0-9a-f]{64}", digest):
        if hashlib.sha256(payload).hexdigest() != digest:
            return "payload digest differs", at
    else:
        digest = hashlib.sha256(payload).hexdigest()
    return {"type": head["warc-type"], "id": head.get("warc-record-id", ""), "uri": head.get("warc-target-uri", ""), "refers_to": head.get("warc-refers-to"), "digest": digest, "length": length, "payload": payload}, stop + 4


def inflate(data, at: int) -> tuple[bytes | None, int]:
    """The member at `at` and the offset behind it; None if it is damaged."""
    unpacker, parts, to = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            chunk = data[to : to + CHUNK]
            if not chunk:
                return None, at
            parts.append(unpacker.decompress(chunk))
            to += len(chunk)
    except zlib.error:
        return None, at
    return b"".join(parts), to - len(unpacker.unused_data)


def records_in(data: bytes, base: int, whole: bool):
    """Records and gaps of uncompressed bytes; whole: all of them belong to one member, whose offset is `base`."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        record, to = parse_record(data, at)
        if isinstance(record, dict):
            if lost is not None:
                yield "gap", base if whole else base + lost, at - lost, reason
                lost = None
            yield "record", base if whole else base + at, to - at, record
            at = to
        else:
            if lost is None:
                lost, reason = at, record
            ahead = VERSION.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
    if lost is not None:
        yield "gap", base if whole else base + lost, len(data) - lost, reason


def salvage(data: bytes):
    """(kind, offset, length, record or reason) for all bytes of an archive: kind is "record" or "gap".

    Members and plain records are both tried wherever they may start, so an archive may be compressed, plain or mixed."""
    at, lost, reason = 0, None, ""
    magic = version = -1  # the next places of each behind `at`, once looked for
    while at < len(data):
        to, found = at, []
        if data.startswith(MAGIC, at):
            content, to = inflate(data, at)
            why = "member damaged"
            if content is not None:
                found = list(records_in(content, at, True))
                if lost is not None and not any(kind == "record" for kind, *_ in found):
                    found = []  # compressed data within what is lost
        else:
            record, to = parse_record(data, at)
            if isinstance(record, dict):
                found = [("record", at, to - at, record)]
            else:
                why = record
        if found:
            if lost is not None:
                yield "gap", lost, at - lost, reason
                lost = None
            yield from found
        elif to == at or lost is not None:
            if lost is None:
                lost, reason = at, why
            start = max(at + 1, to)
            if magic < start:
                magic = data.find(MAGIC, start)
                magic = magic if magic >= 0 else len(data)
            if version < start:
                ahead = VERSION.search(data, start)
                version = ahead.start() if ahead else len(data)
            to = min(magic, version)
        at = to
    if lost is not None:
        yield "gap", lost, len(data) - lost, reason


READ_SCHEMA = "path string, kind string, offset long, length long, reason string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long"


def reader(keep_payload: bool):
    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as stream:
                    data = stream.readall()
                rows = []
                for kind, offset, length, x in salvage(data):
                    ok = kind == "record"
                    row = (path, kind, offset, length, None if ok else x, *((x["type"], x["id"], x["uri"], x["refers_to"], x["digest"], x["length"]) if ok else (None,) * 6))
                    rows.append((*row, x["payload"] if ok else None) if keep_payload else row)
                    if len(rows) == 2000:
                        yield _batch(rows, keep_payload)
                        rows = []
                if rows:
                    yield _batch(rows, keep_payload)

    return read


def _batch(rows, keep_payload):
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")] + ["payload"] * keep_payload
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in READ_SCHEMA.split(", ")] + [pa.binary()] * keep_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(paths: DataFrame, keep_payload: bool = False) -> DataFrame:
    """All records and quarantined gaps of the archives named in column `path`, a task for each archive."""
    tasks = max(1, min(paths.count(), 20_000))
    return paths.select("path").repartition(tasks).mapInArrow(reader(keep_payload), READ_SCHEMA + ", payload binary" * keep_payload)


def digest_pages(pages: DataFrame) -> DataFrame:
    """Write `pages`, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = read_archives(archive_pages(pages)).where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{URN}(-?[0-9]+)>', 1) as bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""
