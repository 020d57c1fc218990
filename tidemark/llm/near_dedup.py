"""MinHash near-duplicate detection with min-max signatures.

Each permutation is evaluated once per shingle and yields two signature values,
the minimum and the maximum, so a signature of 2P values costs P evaluations.
Rows of equal shingle sets form one class first; only class representatives are
banded.  A bucket (equal band) never emits all its pairs: its members are first
compared with two pivots, the least by id and the least by hash, and linked
members merge; the members of buckets that still hold several components then go
through an exact prefix join on their rarest shingles, which leaves no pair that
shares a bucket undecided.  Every link is confirmed on full shingle sets.

Joins are by sort and merge or by hash after a shuffle, at every size: the plan of
a small corpus is that of a large one, and the driver builds no hash tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import components, cut, hot_join, release, scratched

BANDS = 42
PERMUTATIONS_PER_BAND = 3  # six values: a pair of similarity 0.8 shares a band with probability 1 - 3e-6
ID_BITS = 12  # documents of one slice are told apart by the top bits of the sort key


def _constants(bands: int, per_band: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tk.mix(np.arange(1, 2 * bands * per_band + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (seeds[0::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data, offsets, width: int):
    """Distinct `width`-word shingles of each text as sorted (text << 52 | 52-bit hash) keys.

    A text with fewer words, one at least, has its whole sequence as one shingle; a text without words has none."""
    words = tk.Words(data, offsets)
    h, starts, n = words.hashes, words.starts, words.counts()
    doc = tk.spans_of(starts)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(width):
        rolled[: len(h) - k] = rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    rolled = tk.mix(rolled + np.uint64(width))
    position = np.arange(len(h)) - starts[doc]
    full = position <= (n - width)[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    for i in short:  # a handful of tiny texts
        x = np.uint64(0)
        for w in h[starts[i] : starts[i + 1]]:
            x = np.uint64((int(x) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        rolled[starts[i]] = tk.mix(np.array([x], dtype=np.uint64) + np.uint64(n[i]))[0]
        full[starts[i]] = True
    keys = (doc[full].astype(np.uint64) << np.uint64(52)) | (rolled[full] >> np.uint64(12))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys


def _pieces(column: pa.Array):
    for at, part in tk.slices(column, 1 << 20):
        for sub in range(0, len(part), 1 << ID_BITS):
            yield at + sub, part.slice(sub, 1 << ID_BITS)


MASK = np.uint64((1 << 52) - 1)


def signer(width: int, bands: int, per_band: int):
    """mapInArrow function (doc_id, text) -> (doc_id, n_shingles, set_key, bands)."""
    mul, add = _constants(bands, per_band)

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, part in _pieces(texts):
                data, offsets = tk.raw(part)
                keys = shingle_sets(data, offsets, width)
                doc = (keys >> np.uint64(52)).astype(np.int64)
                n = np.bincount(doc, minlength=len(part))
                some = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
                value = keys & MASK
                table = np.zeros((len(part), bands), dtype=np.int64)
                key = np.zeros((len(part), 2), dtype=np.uint64)
                if len(some):
                    key[some, 0] = np.add.reduceat(tk.mix(value + np.uint64(0x51ED2701)), starts)
                    key[some, 1] = np.add.reduceat(tk.mix(value ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                    x = (value >> np.uint64(20)).astype(np.uint32)
                    for b in range(bands):
                        acc = np.full(len(some), b + 1, dtype=np.uint64)
                        for p in range(b * per_band, (b + 1) * per_band):
                            y = x * mul[p] + add[p]
                            low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
                            acc = tk.mix(acc * np.uint64(0x9E3779B97F4A7C15) + (low.astype(np.uint64) << np.uint64(32) | high))
                        table[some, b] = acc.view(np.int64)
                set_key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(part), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(part) + 1) * bands, bands), pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(n), set_key, rows], ["doc_id", "n_shingles", "set_key", "bands"])

    return sign


def set_reader(width: int):
    """mapInArrow function (id, text) -> (id, members): the full shingle set as sorted 8-byte values."""

    def read(batches):
        for batch in batches:
            for at, part in _pieces(batch.column(1)):
                data, offsets = tk.raw(part)
                keys = shingle_sets(data, offsets, width)
                n = np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(part))
                ends = np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32)
                members = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((keys & MASK).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), members], ["id", "members"])

    return read


def verifier(percent: int):
    """mapInArrow function (a, b, left set, right set) -> (a, b) where 100 * intersection >= percent * union."""

    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(both) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return verify


SKETCH_BITS = 18  # a table of 2**18 counters, whatever the corpus


def counter(batches):
    """mapInArrow function (members) -> (slot, c): how often the shingles of each hash slot occur."""
    for batch in batches:
        values = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(0)] or [np.zeros(0, np.uint64)])
        slot, c = np.unique(values >> np.uint64(52 - SKETCH_BITS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(c.astype(np.int64))], ["slot", "c"])


def prefixes(load, percent: int):
    """mapInArrow function (id, comp, n, members) -> the shingles of each set's prefix, rarest first, with their places."""

    def emit(batches):
        weight = load.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                length = len(v) - (percent * len(v) + 99) // 100 + 1
                out.append(v[np.lexsort((v, weight[(v >> np.uint64(52 - SKETCH_BITS)).astype(np.int64)]))[:length]])
            sizes = np.array([len(x) for x in out], dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shingle = np.concatenate(out or [np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), *(batch.column(k).take(pa.array(row)) for k in range(3)), pa.array(place.astype(np.int32))], ["shingle", "id", "comp", "n", "place"])

    return emit


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still reach the similarity, none left out.

    Two similar sets share a shingle among the first n - ceil(t*n) + 1 in any
    order common to all sets, and the first one shared leaves room for the
    overlap that the similarity asks for.  The order is by rarity, so copies of a
    common passage do not meet.  Within a shingle, rows of its largest component
    meet only those of others, so a large group of copies stays linear.
    """
    spark = sets.sparkSession
    counts = sets.select("members").mapInArrow(counter, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    load = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    load[counts["slot"].to_numpy()] = counts["c"].to_numpy()
    loads = spark.sparkContext.broadcast(load)
    rows = cut(sets.select("id", "comp", "n", "members").mapInArrow(prefixes(loads, percent), "shingle long, id long, comp long, n long, place int"), "prefixes")
    loads.destroy()
    held = rows.groupBy("shingle", "comp").agg(F.count("*").alias("c"))
    mixed = held.groupBy("shingle").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("c")).where("k > 1").select("shingle", "main", "c")
    mixed = cut(mixed, "mixed")
    total = mixed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    met = cut(hot_join(rows, mixed, ["shingle"], "c", total), "met")
    fewer = met.where("comp <> main").select("shingle", *[F.col(c).alias("o_" + c) for c in ("id", "comp", "n", "place")])
    room = F.expr(f"{100 + percent} * least(n - place, o_n - o_place) >= {percent} * (n + o_n)")
    meet = met.hint("merge").join(fewer, "shingle").where((F.col("comp") != F.col("o_comp")) & room)
    return meet.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def shared_ids(linkable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from each id whose rows are of several classes to the smallest id of each of them, as one id is one document."""
    several = linkable.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    rows = linkable.select("doc_id", "set_key").hint("merge").join(several, "doc_id", "left_semi").distinct()
    return rows.hint("merge").join(classes.select("set_key", "id"), "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


@scratched
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, per_band: int = PERMUTATIONS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row.

    Null or wordless texts have an empty set and link with nothing.  A row with a
    null id keeps null as component and is kept.  Rows that share an id are one
    document, whose links are those of all its rows.  Other columns of `docs` are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = cut(own.mapInArrow(signer(width, bands, per_band), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures", outer=True)
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    entries = classes.select("id", "n", F.explode("bands").alias("h"))
    shared = cut(entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    buckets = cut(hot_join(entries, shared, ["h"], "c", total).select("h", "id", "n", "c"), "buckets")
    release(spark)
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = cut(own.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(set_reader(width), "id long, members binary"), "sets")
    release(spark)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
        b = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
        joined = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
        return cut(joined.select("a", "b", "left", "right").mapInArrow(verifier(percent), "a long, b long").distinct(), name)

    # Each member with its bucket's pivots: two pairs a member at most.
    size_ok = F.expr(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    first = lambda order: F.min(F.struct(order.alias("o"), F.col("id").alias("id"), F.col("n").alias("n")))
    pivots = cut(buckets.groupBy("h").agg(F.array(first(F.col("id")), first(F.xxhash64("id"))).alias("pivots"), F.count("*").alias("c")), "pivots")
    met = hot_join(buckets.select("h", "id", "n"), pivots, ["h"], "c", total).select("id", "n", F.explode("pivots").alias("p")).where((F.col("id") != F.col("p.id")) & size_ok)
    tried = cut(met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct(), "tried")
    links = cut(confirmed(tried, "links").union(shared_ids(linkable, classes)), "links")
    labels = cut(components(links), "labels")

    # Buckets whose members are not yet all in one component; with two members the pivots have settled them.
    rows = buckets.where("c > 2").select("h", "id", "n").hint("merge").join(labels, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("comp"))
    rows = cut(rows, "labelled")
    mixed = cut(rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("h", "c"), "mixed")
    members = cut(hot_join(rows, mixed, ["h"], "c", total).select("id", "comp", "n").distinct(), "members")
    candidates = cut(prefix_pairs(cut(sets.hint("merge").join(members, "id"), "open"), percent), "pairs")
    found = confirmed(candidates.hint("merge").join(tried, ["a", "b"], "left_anti"), "links")
    # The links found last join components; only those are contracted further.
    ends = found
    for end in ("a", "b"):
        mapped = labels.toDF(end, "component")
        ends = ends.hint("merge").join(mapped, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joins = components(ends, "joins").toDF("component", "lowest")
    # found may name ids that had no link before
    known = labels.unionByName(classes.select("id", F.col("id").alias("component")).hint("merge").join(labels.select("id"), "id", "left_anti"))
    known = known.distinct().hint("merge").join(joins, "component", "left").select("id", F.coalesce("lowest", "component").alias("component"))
    labels = cut(known.where("id <> component"), "labels")

    moved = classes.hint("merge").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"), "id", "last").where("component <> id or last <> id").select("set_key", "component")
    moved = cut(moved, "moved", outer=True)
    result = signed.drop("bands").hint("merge").join(moved, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@scratched
def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, without those whose document has an earlier near copy; rows repeated under one id all stay."""
    gone = cut(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "copies", outer=True)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM worded
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), lowest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest ON doc_id = a
"""
