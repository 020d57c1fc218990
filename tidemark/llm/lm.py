"""Language-model scores from a log-frequency Bloom filter.

Counts of unigrams and bigrams of the training documents are quantised to levels
(level j: a count of 2**(j-1) or more).  An n-gram of level q is entered under the
keys (n-gram, 1) ... (n-gram, q); a count is read back by probing level after
level until one is absent.  Probabilities interpolate the bigram's relative
frequency with an add-0.1 unigram.

Size: the filter takes BITS_AN_ENTRY bits for each entry, whatever their number,
so it grows with the corpus.  It is dealt by n-gram hash into blocks, whose number
follows the tokens.  No block is broadcast or collected: texts are dealt into
chunks, the n-grams of each chunk meet the blocks in one shuffle, and the levels
go back to the chunk in another.

Exact counts: frequent words, HEAD at most, are broadcast; the others go through
a shuffled join by word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import cut, held_out, scratched

ADD = 0.1
LAMBDA = 0.6
BLOCKS = 256  # at least
BLOCK_TOKENS = 1 << 22  # training tokens for each block, about; a block must fit a worker
CHUNK_BYTES = 8 << 20  # of texts, about
PROBES = 5
BITS_AN_ENTRY = 10  # false positives: (1 - exp(-5 / 10)) ** 5 = 0.9 %
LEVELS = 40
HEAD = 1 << 17
KEY_BITS = 40
FLUSH = 3_000_000  # words held by a task before it passes their counts on
END = tk.mix(np.array([0x656E64], dtype=np.uint64))[0]
U = np.uint64


def tokens(column: pa.Array):
    """(first row, hashes, starts) of bounded parts of a column: words of each text, then one end."""
    for at, part in tk.slices(column, 1 << 20):
        data, offsets = tk.raw(part)
        words = tk.Words(data, offsets)
        n = len(part)
        starts = words.starts + np.arange(n + 1)
        out = np.empty(len(words.hashes) + n, dtype=U)
        ends = starts[1:] - 1
        solid = np.ones(len(out), dtype=bool)
        solid[ends] = False
        out[solid], out[ends] = words.hashes, END
        yield at, out, starts


def bigram_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of (previous token, token) for each token; an end stands before the first."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts[:-1]] = END
    return tk.mix(before * U(0x9E3779B97F4A7C15) + hashes) >> U(64 - KEY_BITS)


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return tk.mix(hashes ^ U(0x5851F42D4C957F2D)) >> U(64 - KEY_BITS)


# Counting


def word_counts(batches):
    """mapInArrow function (text) -> (w, c)."""
    held, size = [], 0

    def flush():
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    for batch in batches:
        for _, hashes, _ in tokens(batch.column(0)):
            held.append(hashes)
            size += len(hashes)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as varint-free differences in byte planes, with saturating counts; about 3 bytes an n-gram."""
    delta = np.diff(keys, prepend=keys[:1]).astype(np.uint64)
    first = int(keys[0]) if len(keys) else 0
    planes = delta.view(np.uint8).reshape(-1, 8).T[:5].tobytes()
    return len(keys).to_bytes(8, "little") + first.to_bytes(8, "little") + zlib.compress(planes + np.minimum(counts, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = np.frombuffer(zlib.decompress(blob[16:]), dtype=np.uint8).reshape(9, n)
    delta = np.zeros((n, 8), dtype=np.uint8)
    delta[:, :5] = raw[:5].T
    keys = np.cumsum(delta.reshape(-1).view(np.uint64)) + U(first)
    return keys, np.ascontiguousarray(raw[5:].T).reshape(-1).view("<u4").astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def chunked(batches):
    """mapInArrow function (rid, doc_id, trains, text) -> the same with a chunk number, by which at most about CHUNK_BYTES of texts belong together."""
    from pyspark import TaskContext

    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at, part in tk.slices(batch.column(3), CHUNK_BYTES):
            if size and size + part.nbytes > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += part.nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), *batch.slice(at, len(part)).columns], ["chunk", "rid", "doc_id", "trains", "text"])


def gram_counter(blocks: int):
    """mapInArrow function (chunk, trains, text) -> (chunk, block, blob): n-grams of each chunk with their counts in training texts, split by the keys' top bits.

    N-grams of held-out texts alone have count 0.  A chunk may come in several pieces."""

    def counted(held):
        return np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))

    def flush(chunk, held):
        asked = counted(held[False])[0]
        keys, counts = counted(held[True])
        keys, counts = merged(np.concatenate([keys, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
        cuts = np.searchsorted(block_of(keys, blocks), np.arange(blocks + 1))
        some = [i for i in range(blocks) if cuts[i] < cuts[i + 1]]
        blobs = [pack(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "block", "blob"])

    def run(batches):
        held, now, size = {True: [], False: []}, None, 0
        for batch in batches:
            chunks, trains = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(chunks[1:] != chunks[:-1]) + 1
            for start, stop in zip([0, *edges], [*edges, len(chunks)], strict=True):
                if start == stop:
                    continue
                if now is not None and (chunks[start] != now or size >= FLUSH):
                    yield flush(now, held)
                    held, size = {True: [], False: []}, 0
                now = int(chunks[start])
                for which, chosen in ((True, trains[start:stop]), (False, ~trains[start:stop])):
                    for _, hashes, starts in tokens(batch.column(2).slice(start, stop - start).filter(pa.array(chosen))):
                        held[which] += [bigram_keys(hashes, starts), unigram_keys(hashes)]
                        size += 2 * len(hashes)
        if now is not None:
            yield flush(now, held)

    return run


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return keys * U(blocks) >> U(KEY_BITS)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts)).astype(np.int64) + 1, LEVELS)


def positions(keys: np.ndarray, level: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit places of a filter of `size` bits for each (n-gram, level)."""
    h = tk.mix(keys * U(0x9E3779B97F4A7C15) + level.astype(U) * U(0xD6E8FEB86659FD93))
    step = (h >> U(32)) | U(1)
    return (h[None, :] + np.arange(PROBES, dtype=U)[:, None] * step[None, :]) % U(size)


class Filter:
    """One block of the filter, of BITS_AN_ENTRY bits for each of its entries, whatever their number."""

    def __init__(self, keys: np.ndarray, level: np.ndarray):
        self.size = max(64, BITS_AN_ENTRY * int(level.sum()))
        self.bits = np.zeros(self.size, dtype=bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            some = keys[level >= j]
            self.bits[positions(some, np.full(len(some), j), self.size).ravel()] = True

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 where it is absent, by probing level after level."""
        out = np.zeros(len(keys), dtype=np.int64)
        at, level, found = np.arange(len(keys)), 1, keys
        while len(at) and level <= LEVELS:
            hit = self.bits[positions(found, np.full(len(found), level), self.size)].all(axis=0)
            at, found = at[hit], found[hit]
            out[at] = level
            level += 1
        return out


def answered(table: pa.Table) -> pa.Table:
    """All counts of one block (chunk, block, blob) -> (chunk, block, answer): the block's filter is built of them, and each chunk gets the levels of its n-grams in the order of their keys."""
    parts = [unpack(b.as_py()) for b in table["blob"]]
    keys, counts = merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    level = Filter(keys[counts > 0], levels_of(counts[counts > 0])).levels(keys).astype(np.uint8)
    pieces = {}
    for chunk, (part, _) in zip(table["chunk"].to_pylist(), parts, strict=True):
        pieces.setdefault(chunk, []).append(part)
    joined = [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in pieces.values()]
    answers = [zlib.compress(level[np.searchsorted(keys, x)].tobytes(), 1) for x in joined]
    block = table["block"][0].as_py()
    return pa.table({"chunk": pa.array(list(pieces), pa.int64()), "block": pa.array([block] * len(pieces), pa.int32()), "answer": pa.array(answers, pa.binary())})


class Answers:
    """The levels that the blocks gave for the n-grams of a chunk."""

    def __init__(self, keys: np.ndarray, answers: pa.Table):
        self.keys = np.unique(keys)
        self.level = np.frombuffer(b"".join(zlib.decompress(b.as_py()) for b in answers.sort_by("block")["answer"]), dtype=np.uint8).astype(np.int64)
        if len(self.keys) != len(self.level):
            raise RuntimeError("answers do not cover the n-grams of the chunk")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.level[np.searchsorted(self.keys, keys)]


#: The least and the greatest count of each level.
LEAST = np.concatenate([[0.0], 2.0 ** np.arange(LEVELS)])
MOST = np.concatenate([[0.0], 2.0 ** np.arange(1, LEVELS + 1) - 1])


def model_log10(filt: Filter | Answers, hashes: np.ndarray, starts: np.ndarray, total: int, kinds: int, exact: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each token given the one before; `exact`: counts of the tokens where known, else 0.

    Bigrams count as the least of their level and the words before them as the most
    of theirs, so the shares of a word's successors add up to 1 at most, and so do
    the probabilities but for the filter's false positives."""
    uni, where = np.unique(hashes, return_inverse=True)
    level = filt.levels(unigram_keys(uni))
    one, most = LEAST[level][where], MOST[level][where]
    if exact is not None:
        one, most = np.where(exact > 0, exact, one), np.where(exact > 0, exact, most)
    before = np.empty_like(most)
    before[1:] = most[:-1]
    before[starts[:-1]] = most[starts[1:] - 1]  # an end stands before the first, as behind the last
    keys, back = np.unique(bigram_keys(hashes, starts), return_inverse=True)
    two = LEAST[filt.levels(keys)][back]
    floor = (one + ADD) / (total + ADD * (kinds + 1))
    share = np.minimum(two, before) / np.maximum(before, 1.0)
    return np.log10(np.where(before > 0, LAMBDA * share + (1 - LAMBDA) * floor, floor))


# Scoring


@scratched
def with_model(own: DataFrame, words: np.ndarray, known: np.ndarray, total: int, kinds: int) -> DataFrame:
    """rid, doc_id, n_tokens, head_known, head_base, score, tail of each row of `own`: all but the counts of the words in tail."""
    own = cut(own.mapInArrow(chunked, "chunk long, rid long, doc_id long, trains boolean, text binary"), "chunks")
    blocks = max(BLOCKS, -(-total // BLOCK_TOKENS))
    grams = own.select("chunk", "trains", "text").mapInArrow(gram_counter(blocks), "chunk long, block int, blob binary")
    answers = grams.groupBy("block").applyInArrow(answered, "chunk long, block int, answer binary")
    shared = own.sparkSession.sparkContext.broadcast((words, known))
    norm = total + ADD * (kinds + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, known = shared.value
        parts, out = list(tokens(texts["text"])), []
        filt = Answers(np.concatenate([f for _, hashes, starts in parts for f in (bigram_keys(hashes, starts), unigram_keys(hashes))]), answers)
        for at, hashes, starts in parts:
            n = len(starts) - 1
            slot = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            is_head = words[slot] == hashes if len(words) else np.zeros(len(hashes), dtype=bool)
            c = np.where(is_head, known[slot], 0) if len(words) else np.zeros(len(hashes))
            base = np.add.reduceat(np.where(is_head, np.log10((c + ADD) / norm), 0.0), starts[:-1])
            model = np.add.reduceat(model_log10(filt, hashes, starts, total, kinds, c), starts[:-1])
            rest = np.concatenate([[0], np.cumsum(~is_head)])[starts]
            tail = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(hashes[~is_head].view(np.int64)))
            ids = texts.slice(at, n).combine_chunks()
            columns = [ids["rid"], ids["doc_id"], pa.array(np.diff(starts)), pa.array(np.add.reduceat(is_head.astype(np.int64), starts[:-1])), pa.array(base), pa.array(model), tail]
            out.append(pa.table(columns, ["rid", "doc_id", "n_tokens", "head_known", "head_base", "score", "tail"]))
        return pa.concat_tables(out)

    texts = own.select("chunk", "rid", "doc_id", "text").groupBy("chunk")
    return cut(texts.cogroup(answers.groupBy("chunk")).applyInArrow(run, "rid long, doc_id long, n_tokens long, head_known long, head_base double, score double, tail array<long>"), "scored", outer=True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of `docs`.

    A null text counts as empty: its one token is the end.  A row with null id
    belongs to no fold; it trains and is not held out.
    """
    spark = docs.sparkSession
    fold = F.coalesce(held_out("doc_id", 10), F.lit(1)) == 0
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (~fold).alias("trains"), F.col("text").cast("binary").alias("text"))
    train = own.where("trains").select("text")
    counts = cut(train.mapInArrow(word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The head: counts from a power-of-two threshold on, HEAD words at most.
    steps = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("step")).count().collect()}
    least, seen = max(steps, default=0) + 1, 0
    while least > 0 and seen + steps.get(least - 1, 0) <= HEAD:
        least -= 1
        seen += steps.get(least, 0)
    head_rows = counts.where(F.floor(F.log2("c") * 4) >= least)
    head = head_rows.toArrow()
    order = np.argsort(head["w"].to_numpy().view(U))
    words, known = head["w"].to_numpy().view(U)[order], head["c"].to_numpy()[order]
    scored = with_model(own, words, known, total, kinds)
    norm = total + ADD * (kinds + 1)
    absent = float(np.log10(ADD / norm))
    rare = counts.where(F.floor(F.log2("c") * 4) < least)
    # Most tail words of a document are absent or seen a few times; each (document, word) meets its count by a shuffled join.
    asked = scored.select("rid", F.explode("tail").alias("w")).join(rare, "w")
    more = asked.groupBy("rid").agg(F.count("*").alias("k"), F.sum(F.log10((F.col("c") + ADD) / F.lit(norm))).alias("s"))
    full = scored.join(more, "rid", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    unknown = (F.size("tail") - F.col("k")) * F.lit(absent)
    return full.select(
        "doc_id",
        (F.coalesce(held_out("doc_id", 10), F.lit(1)) == 0).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.col("k")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("s", F.lit(0.0)) + unknown).alias("base_score"),
        "score",
    )
