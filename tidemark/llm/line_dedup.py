"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words (A-Z lower-cased).  The edit unit is a word, the
bound one edit for lines of EDIT_WORDS words or more and none below.  Lines of
fewer than LEAST_WORDS words are never touched.

Two lines of one edit share a variant: both with the word at the edited place
deleted (replacement), or the longer with that word deleted and the shorter as it
is (insertion).  All variants within the bound are emitted as hashed keys that
also tell the place, so the earliest line of a key group stands for the group and
no pairs of a group are built.  Most lines have no such partner: by the
pigeonhole principle, partners share their first or last half, so only lines that
share a half with another text go into the join.  The edit distance of each found
pair is verified on the word sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import WORD, cut, hot_join, release, scratched, unused

LEAST_WORDS = 5
EDIT_WORDS = 8
U = np.uint64
HALF_KEYS = 4


class Rolling:
    """Hashes of any run of words in O(1): two independent polynomials over the word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.up, self.down = tk.powers_of(tk.BASE, n + 1).copy(), tk.powers_of(tk.BASE_INV, n + 1).copy()
        self.sums = []
        for salt in (U(0), U(0x6A09E667F3BCC909)):
            total = np.zeros(n + 1, dtype=U)
            np.cumsum(tk.mix(hashes ^ salt) * self.up[:n], out=total[1:])
            self.sums.append(total)

    def run(self, begin, end, which: int = 0):
        return (self.sums[which][end] - self.sums[which][begin]) * self.down[begin]


def split_lines(data: np.ndarray, offsets: np.ndarray):
    """(text number, line number, offsets of all lines) of consecutive texts, lines as split at "\\n"."""
    after = np.flatnonzero(data == 10) + 1
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, after - 1, side="right") - 1])
    start = np.concatenate([offsets[:-1], after])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    return doc, np.arange(len(doc)) - first[doc], np.concatenate([start, offsets[-1:]])


def _lines(column: pa.Array):
    """(row of each line, line number, word range, rolling hashes, word hashes) for bounded parts of a column."""
    for at, part in tk.slices(column, 1 << 20):
        data, offsets = tk.raw(part)
        doc, number, bounds = split_lines(data, offsets)
        words = tk.Words(data, bounds)
        yield doc + at, number, words.starts[:-1], words.starts[1:], Rolling(words.hashes), words.hashes


def line_keys(batches):
    """mapInArrow function (doc_id, th, text) -> a row for each line of LEAST_WORDS words or more: its 128-bit key and half keys."""
    for batch in batches:
        for row, number, begin, end, roll, _ in _lines(batch.column(2)):
            some = np.flatnonzero(end - begin >= LEAST_WORDS)
            row, number, begin, end = row[some], number[some], begin[some], end[some]
            n = (end - begin).astype(U)
            k1, k2 = tk.mix(roll.run(begin, end) + n), tk.mix(roll.run(begin, end, 1) ^ n)
            halves = []
            for length in (end - begin, end - begin - 1):
                h = length // 2
                for tag, part in ((U(1), roll.run(begin, begin + h)), (U(2), roll.run(end - h, end))):
                    halves.append(tk.mix(part + length.astype(U) * U(4) + tag))
            ids = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(number.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array((end - begin).astype(np.int32))]
                + [pa.array(x.view(np.int64)) for x in halves],
                ["doc_id", "th", "line", "k1", "k2", "w"] + [f"p{i}" for i in range(HALF_KEYS)],
            )


LINE_SCHEMA = "doc_id long, th long, line int, k1 long, k2 long, w int, " + ", ".join(f"p{i} long" for i in range(HALF_KEYS))


def sequences(batches):
    """mapInArrow function (doc_id, th, text, array of line numbers) -> (doc_id, th, line, seq): word hashes of those lines."""
    for batch in batches:
        wanted = batch.column(3).to_pylist()
        for row, number, begin, end, _, hashes in _lines(batch.column(2)):
            first = np.searchsorted(row, np.arange(row[0], row[-1] + 1)) if len(row) else []
            at = np.array([first[r - row[0]] + x for r in range(row[0], row[-1] + 1) for x in sorted(wanted[r])] if len(row) else [], dtype=np.int64)
            ids = pa.array(row[at])
            seq = pa.array([hashes[b:e].tobytes() for b, e in zip(begin[at], end[at], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(number[at].astype(np.int32)), seq], ["doc_id", "th", "line", "seq"])


def variants(batches):
    """mapInArrow function (doc_id, th, line, seq) -> (doc_id, th, line, v, role): hashed variants.

    Shorter lines than EDIT_WORDS have no word deleted.  Role 0: the word at one place deleted, the place being part of the key; role 1: one
    word deleted, wherever; role 2: the line as it is, to meet those of role 1."""
    for batch in batches:
        lengths = np.array([len(x.as_buffer()) // 8 for x in batch.column(3)], dtype=np.int64)
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), dtype=U) for x in batch.column(3)] or [np.zeros(0, U)])
        roll = Rolling(hashes)
        end = np.cumsum(lengths)
        begin = end - lengths
        line = np.repeat(np.arange(len(lengths)), lengths)
        word = np.flatnonzero(lengths[line] >= EDIT_WORDS)
        line = line[word]
        place = (word - begin[line]).astype(U)
        rest = roll.run(begin[line], word) + roll.up[(word - begin[line])] * roll.run(word + 1, end[line])
        shorter = (lengths[line] - 1).astype(U)
        keys = [tk.mix(tk.mix(rest + shorter * U(8)) + place * U(0x9E3779B97F4A7C15) + U(5)), tk.mix(rest + shorter * U(8) + U(3)), tk.mix(roll.run(begin, end) + lengths.astype(U) * U(8) + U(3))]
        owners = [line, line, np.arange(len(lengths))]
        ids = pa.array(np.concatenate(owners))
        role = np.concatenate([np.full(len(k), r, dtype=np.int8) for r, k in enumerate(keys)])
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(ids) for i in range(3)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(role)], ["doc_id", "th", "line", "v", "role"])


def within_one(x: np.ndarray, y: np.ndarray) -> bool:
    """Edit distance of two word sequences is one at most."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    prefix = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    suffix = int(differ[0]) if len(differ) else n
    return prefix + suffix >= max(len(x), len(y)) - 1


def verify(batches):
    for batch in batches:
        ok = [within_one(np.frombuffer(a.as_buffer(), dtype=U), np.frombuffer(b.as_buffer(), dtype=U)) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in range(3)], ["doc_id", "th", "line"])


PLACE = ("doc_id", "th", "line")


def repeated_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, th, removed): numbers of the lines of each document that an earlier line equals or is within the bound of.

    th is xxhash64 of the text, so rows that share an id but not the text are told
    apart; earlier means a smaller (doc_id, th, line).  Rows with null id or null
    text have no part."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null and text is not null")
    lines = cut(own.mapInArrow(line_keys, LINE_SCHEMA), "lines")
    halves = [f"p{i}" for i in range(HALF_KEYS)]
    distinct = cut(
        lines.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("c"), F.first("w").alias("w"), *[F.first(p).alias(p) for p in halves]), "distinct-lines"
    )
    release(spark)
    total = distinct.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    long_enough = distinct.where(f"w >= {EDIT_WORDS - 1}").select("at", F.explode(F.array(*halves)).alias("p"))
    met = cut(long_enough.groupBy("p").agg(F.count("*").alias("c")).where("c > 1"), "halves")
    risky = hot_join(long_enough, met, ["p"], "c", HALF_KEYS * total).select("at.*").distinct()
    by_doc = cut(risky.groupBy("doc_id", "th").agg(F.collect_list("line").alias("wanted")), "risky")
    release(spark)
    once = own.join(by_doc.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "wanted")
    texts = cut(once.mapInArrow(sequences, "doc_id long, th long, line int, seq binary"), "sequences")
    release(spark)
    emitted = cut(texts.mapInArrow(variants, "doc_id long, th long, line int, v long, role byte"), "variants").withColumn("at", F.struct(*PLACE))
    # Only groups of two and more can matter; of each, the earliest line as it is and the earliest with a word deleted.
    shared = cut(emitted.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    many = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    grouped = cut(hot_join(emitted, shared, ["v"], "c", many).select("v", "role", "at"), "groups")
    release(spark)
    heads = grouped.groupBy("v").agg(F.min(F.when(F.col("role") == 2, F.col("at"))).alias("plain"), F.min(F.when(F.col("role") != 2, F.col("at"))).alias("less"), F.count("*").alias("c"))
    partner = F.when(F.col("role") == 1, F.col("plain")).otherwise(F.col("less"))
    found = hot_join(grouped, cut(heads, "heads"), ["v"], "c", many).withColumn("partner", partner).where("partner < at").groupBy("at").agg(F.min("partner").alias("partner"))
    pairs = found.select("at.*", F.col("partner.doc_id").alias("pd"), F.col("partner.th").alias("pt"), F.col("partner.line").alias("pl"))
    right = texts.toDF("pd", "pt", "pl", "other")
    near = pairs.hint("merge").join(texts, list(PLACE)).hint("merge").join(right, ["pd", "pt", "pl"]).select(*PLACE, "seq", "other").mapInArrow(verify, "doc_id long, th long, line int")
    near_keys = cut(near.withColumn("near", F.lit(True)).select(F.struct(*PLACE).alias("at"), "near"), "near")
    release(spark)
    gone = distinct.hint("merge").join(near_keys, "at", "left").where("c > 1 or near").select("k1", "k2", "at", "c", F.coalesce("near", F.lit(False)).alias("near"))
    gone = cut(gone, "gone")
    release(spark)
    hit = hot_join(lines.select(*PLACE, "k1", "k2"), gone, ["k1", "k2"], "c", total).where(F.col("near") | (F.struct(*PLACE) != F.col("at")))
    return hit.groupBy("doc_id", "th").agg(F.collect_set("line").alias("removed"))


@scratched
def dedup_lines(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with the repeated lines taken out of the text, and two more columns, the numbers of lines and of removed lines, whose names follow it.

    A null text stays null with no lines; an empty text has one empty line.  All
    other columns stay as they are, whatever their names."""
    gone = cut(repeated_lines(docs, text_col), "removed", outer=True)
    n_lines, n_removed = unused(docs, "n_lines", "n_removed")
    joined = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs[text_col]) == gone["th"]), "left")
    parts, removed = F.split(docs[text_col], "\n", -1), gone["removed"]
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(removed, i)), "\n")
    found = joined.select(
        *[F.when(removed.isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.when(docs[text_col].isNull(), 0).otherwise(F.size(parts)).cast("long").alias(n_lines),
        F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias(n_removed),
    )
    return found, n_lines, n_removed


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of the text that is left; a null text counts as empty): a row for each row of `docs`.

    Of equal lines, and of those within the edit bound, the one with the smallest
    (doc_id, xxhash64 of the text, line number) stays; rows that repeat an id and a
    text are one text, and all lose the same lines."""
    found, n_lines, n_removed = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, text and n_chars being those left; a document goes when all it had was said earlier."""
    found, n_lines, n_removed = dedup_lines(docs)
    found = found.where((F.col(n_removed) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        found = found.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.drop(n_lines, n_removed)


ORACLE = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), numbered AS (
  SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS line FROM split WHERE doc_id IS NOT NULL AND text IS NOT NULL
), lines AS (
  SELECT * FROM (SELECT doc_id, line, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM numbered) WHERE len(w) >= 5
), uniq AS (
  SELECT w, min(doc_id * 1000000 + line) AS pos FROM lines GROUP BY w
), variants AS (
  SELECT w, pos, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM uniq WHERE len(w) >= 7
), keys AS (
  SELECT pos, n, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM variants
), near AS (
  SELECT DISTINCT greatest(a.pos, b.pos) AS pos FROM keys a JOIN keys b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND a.pos <> b.pos WHERE a.n >= 8
  UNION
  SELECT DISTINCT greatest(a.pos, b.pos) FROM keys a JOIN (SELECT pos, len(w) AS n, array_to_string(w, ' ') AS v FROM uniq) b ON a.v = b.v AND a.n = b.n + 1 WHERE a.n >= 8
), gone AS (
  SELECT l.doc_id, list(l.line) AS removed FROM lines l JOIN uniq u ON l.w = u.w LEFT JOIN near n ON n.pos = u.pos
  WHERE n.pos IS NOT NULL OR l.doc_id * 1000000 + l.line <> u.pos GROUP BY l.doc_id
)
SELECT s.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN text IS NULL THEN '' WHEN removed IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(removed, i - 1)), lambda i: l[i]), chr(10)), '') END) AS text_sha256
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
"""
