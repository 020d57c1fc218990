"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A step's input describes a word by itself and by its characters, each in two ways.
Learned: an embedding of the word, and the mean embedding of its character 3- to
5-grams, which backpropagation trains with the rest of the network.  Counted:
shrunken log-odds of the word and of its n-grams (maximum, mean, and maximum over
those at the word's start), whether the word is known, and its length.  Log-odds
come from the labelled sample; while the network is trained, each document's
come from the other folds, and half of all embeddings are left out at each step, so
that no document informs its own inputs and none is known by its words alone.

A text is cut into overlapping windows of WINDOW words, STRIDE apart, all of them
are scored, and the text's score is that of its most toxic window.  Training
alternates between choosing windows by the current network (the most toxic one of
a toxic text, the most toxic ones of a clean text) and backpropagation.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import held_out

POSITIVES, NEGATIVES = 1000, 2000  # labelled documents that training uses at most
WINDOW, STRIDE = 32, 24
SCORED_BYTES = 1 << 18  # texts that a task scores at once, in bytes; one text at least
WORD_BITS, GRAM_BITS = 18, 20
HIDDEN = 8
COUNTED, EMBEDDED, EMBEDDING_BITS = 6, 4, 12
INPUTS = COUNTED + 2 * EMBEDDED
FOLDS, ROUNDS, STEPS, RATE, MINIBATCH = 4, 3, 150, 0.01, 256
SHRINK = 4.0
THRESHOLD = 0.3
GRAMS = (3, 4, 5)
U = np.uint64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def parse(column: pa.Array, budget: int = 1 << 20):
    """(first row, words, types, type of each word, (grams, bounds, lengths)) of parts of `budget` bytes: punctuation separates words.

    types: word hashes; grams: hashed n-grams of all types one after another, those of
    type t in bounds[t]:bounds[t + 1], the ones at the word's start first; lengths in bytes."""
    for at, part in tk.slices(column, budget):
        data, offsets = tk.raw(part)
        data = np.where(_LETTER[data], data, np.uint8(32))
        words = tk.Words(data, offsets)
        types, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        begin, end = words.begin[first], words.end[first]
        grams, bounds = grams_of(data, begin, end)
        yield at, words, types, inverse, (grams, bounds, end - begin)


def grams_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Hash slots of the n-grams of each word with a mark before and behind it."""
    lengths = end - begin + 2
    upto = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(begin)), lengths)
    place = np.arange(upto[-1]) - upto[owner]
    inside = (place > 0) & (place < lengths[owner] - 1)
    code = np.ones(len(owner), dtype=np.uint64)
    low = data[(begin[owner] + place - 1)[inside]].astype(np.uint64)
    low[(low >= 65) & (low <= 90)] += U(32)
    code[inside] = low + U(2)
    slots, owners, ranks = [], [], []
    for n in GRAMS:
        if len(owner) < n:
            continue
        h = np.zeros(len(owner) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * U(0x100000001B3) + code[k : len(owner) - n + 1 + k]
        whole = owner[: len(h)] == owner[n - 1 :]
        slots.append((tk.mix(h[whole] + U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(64 - GRAM_BITS)).astype(np.int64))
        owners.append(owner[: len(h)][whole])
        ranks.append(place[: len(h)][whole] > 0)
    slot, own = np.concatenate(slots or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(own * 2 + np.concatenate(ranks or [np.zeros(0, bool)]), kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(begin) + 1))


def word_slot(types: np.ndarray) -> np.ndarray:
    return (types >> U(64 - WORD_BITS)).astype(np.int64)


def log_odds(slots_of_docs: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Shrunken log-odds of a document being toxic, for each slot it has; 0 where nothing is known."""
    with_it, toxic = np.zeros(size), np.zeros(size)
    for slots, y in zip(slots_of_docs, labels, strict=True):
        with_it[slots] += 1
        toxic[slots] += y
    base = (labels.sum() + 1) / (len(labels) + 2)
    rate = (toxic + base) / (with_it + 1)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    return (odds * with_it / (with_it + SHRINK)).astype(np.float32)


def inputs_of(tables: tuple, types, grams, bounds, lengths) -> np.ndarray:
    """Counted inputs of word types."""
    word, gram = tables
    out = np.zeros((len(types), COUNTED), dtype=np.float32)
    out[:, 0] = word[word_slot(types)]
    out[:, 1] = out[:, 0] != 0
    out[:, 5] = np.minimum(lengths, 30) / 10
    n = np.diff(bounds)
    some = np.flatnonzero(n > 0)
    if len(some):
        starts = bounds[:-1][some]
        odds = gram[grams]
        out[some, 2] = np.maximum.reduceat(odds, starts)
        out[some, 3] = np.add.reduceat(odds, starts) / n[some]
        # The grams at a word's start come first, as many as there are sizes that fit.
        lead = np.minimum(np.minimum(len(GRAMS), np.maximum(lengths[some] + 2 - min(GRAMS) + 1, 1)), n[some])
        best = odds[starts]
        for k in range(1, len(GRAMS)):
            best = np.where(k < lead, np.maximum(best, odds[np.minimum(starts + k, len(odds) - 1)]), best)
        out[some, 4] = best
    return out


def embedding_slots(types: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embeddings of words and of n-grams."""
    return (types >> U(64 - EMBEDDING_BITS)).astype(np.int64), grams >> (GRAM_BITS - EMBEDDING_BITS)


def ragged(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places bounds[t] .. bounds[t + 1] - 1 of the chosen t, one after another, and for each place the rank of its t."""
    n = bounds[chosen + 1] - bounds[chosen]
    owner = np.repeat(np.arange(len(chosen)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[owner] + bounds[chosen][owner], owner


def embedded(e: dict, words: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Learned inputs of word types, given the slots of each and of its n-grams."""
    n = np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
    total = np.stack([np.bincount(owner, e["gram"][grams, i], minlength=len(words)) for i in range(EMBEDDED)], axis=1)
    return np.concatenate([e["word"][words], (total / n).astype(np.float32)], axis=1)


def windows_of(n: int) -> np.ndarray:
    """First words of the windows of a text of n words: one at least, the last one reaching the end."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = min(starts[-1], n - WINDOW)
    return np.unique(np.minimum(starts, n - WINDOW))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def initial(rng) -> dict[str, np.ndarray]:
    def gauss(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {}
    for d in "fb":
        p |= {f"W{d}": gauss(INPUTS, 3 * HIDDEN), f"U{d}": gauss(HIDDEN, 3 * HIDDEN) * np.float32(0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": gauss(2 * HIDDEN, HIDDEN), "a": gauss(HIDDEN), "o": gauss(2 * HIDDEN), "d": np.float32([-1.0])}


def gru(projected, valid, recurrent, keep: bool):
    """Hidden states (T x B x HIDDEN) for projected inputs (T x B x 3 HIDDEN): update, reset and candidate gates."""
    steps, batch, _ = projected.shape
    h = np.zeros((batch, HIDDEN), dtype=np.float32)
    states, trace = np.empty((steps, batch, HIDDEN), dtype=np.float32), []
    gates, cand = np.ascontiguousarray(recurrent[:, : 2 * HIDDEN]), np.ascontiguousarray(recurrent[:, 2 * HIDDEN :])
    for t in range(steps):
        zr = sigmoid(projected[t, :, : 2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(projected[t, :, 2 * HIDDEN :] + (r * h) @ cand)
        new = h + (1 - z) * (n - h) * valid[t][:, None]
        if keep:
            trace.append((h, z, r, n))
        h = new
        states[t] = h
    return states, trace


def forward(p, x, valid, keep=False):
    """Toxicity of each window; x: T x B x INPUTS, or the pair of projections for both directions."""
    fx, bx = x if isinstance(x, tuple) else (x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"])
    hf, tf = gru(fx, valid, p["Uf"], keep)
    hb, tb = gru(bx[::-1], valid[::-1], p["Ub"], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    u = np.tanh(h @ p["A"])
    e = np.where(valid > 0, u @ p["a"], np.float32(-30))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[:, :, None] * h).sum(axis=0)
    y = sigmoid(pooled @ p["o"] + p["d"][0])
    return (y, (h, u, w, pooled, tf, tb)) if keep else y


def gru_back(dh_all, trace, valid, recurrent):
    """Gradients of the projected inputs and the recurrent weights."""
    steps, batch, _ = dh_all.shape
    gates, cand = recurrent[:, : 2 * HIDDEN], recurrent[:, 2 * HIDDEN :]
    dx, dr_w = np.zeros((steps, batch, 3 * HIDDEN), dtype=np.float32), np.zeros_like(recurrent)
    dh = np.zeros((batch, HIDDEN), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n = trace[t]
        dh = dh + dh_all[t]
        v = valid[t][:, None]
        dn = dh * (1 - z) * v * (1 - n * n)
        dz = -dh * (n - h) * v * z * (1 - z)
        drh = dn @ cand.T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        dx[t, :, : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dzr, dn
        dr_w[:, : 2 * HIDDEN] += h.T @ dzr
        dr_w[:, 2 * HIDDEN :] += (r * h).T @ dn
        dh = dh * (1 - (1 - z) * v) + drh * r + dzr @ gates.T
    return dx, dr_w


def backward(p, x, valid, y, target, kept):
    """Gradients of all parameters for the mean cross-entropy."""
    h, u, w, pooled, tf, tb = kept
    g = {}
    dlogit = ((y - target) / len(target)).astype(np.float32)
    g["o"], g["d"] = pooled.T @ dlogit, np.float32([dlogit.sum()])
    dpool = dlogit[:, None] * p["o"]
    dh = w[:, :, None] * dpool
    dw = (h * dpool).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=0))
    g["a"] = np.einsum("tb,tbk->k", de, u)
    du = de[:, :, None] * p["a"] * (1 - u * u)
    g["A"] = np.einsum("tbi,tbk->ik", h, du)
    dh = dh + du @ p["A"].T
    dxf, g["Uf"] = gru_back(dh[:, :, :HIDDEN], tf, valid, p["Uf"])
    dxb, g["Ub"] = gru_back(dh[::-1, :, HIDDEN:], tb, valid[::-1], p["Ub"])
    dxb = dxb[::-1]
    for d, dx in (("f", dxf), ("b", dxb)):
        g[f"W{d}"], g[f"c{d}"] = np.einsum("tbi,tbk->ik", x, dx), dx.sum(axis=(0, 1))
    g["inputs"] = dxf @ p["Wf"].T + dxb @ p["Wb"].T
    return g


def without_copies(word_sets: list[np.ndarray], bands: int = 8, width: int = 3) -> np.ndarray:
    """Which texts share no band of min-hashes of their word sets with an earlier one."""
    multiplier = tk.mix(np.arange(1, bands * width + 1, dtype=U)) | U(1)
    seen, keep = set(), np.ones(len(word_sets), dtype=bool)
    for i, slots in enumerate(word_sets):
        if len(slots):
            low = (tk.mix(slots.astype(U))[None, :] * multiplier[:, None]).min(axis=1).reshape(bands, width)
            keys = {(b, *row) for b, row in enumerate(low.tolist())}
            keep[i] = not keys & seen
            seen |= keys
    return keep


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> dict:
    """Parameters and tables, learned from whole texts with labels 0 or 1."""
    rng = np.random.default_rng(seed)
    parts, word_sets, gram_sets = [], [], []
    # Types of all parts one after another: their embeddings' slots, and the type of each word; the last type is padding.
    word_slots, gram_slots, gram_bounds, kinds_of, first_type = [], [], [np.zeros(1, np.int64)], [], 0
    for at, words, types, inverse, chars in parse(texts):
        parts.append((at, words.starts, types, inverse.astype(np.int32), (chars[0].astype(np.int32), *chars[1:])))
        grams, bounds, _ = chars
        of_words, of_grams = embedding_slots(types, grams)
        word_slots.append(of_words)
        gram_slots.append(of_grams.astype(np.int16))
        gram_bounds.append(bounds[1:] + gram_bounds[-1][-1])
        kinds_of.append((inverse + first_type).astype(np.int32))
        first_type += len(types)
        for i in range(len(words.starts) - 1):
            kinds = np.unique(inverse[words.starts[i] : words.starts[i + 1]])
            n = np.diff(bounds)[kinds]
            flat = np.repeat(bounds[:-1][kinds] - np.cumsum(n) + n, n) + np.arange(n.sum())
            word_sets.append(np.unique(word_slot(types[kinds])).astype(np.int32))
            gram_sets.append(np.unique(grams[flat]).astype(np.int32))

    one = without_copies(word_sets)

    def tables(rows):
        rows = rows[one[rows]]  # copies of a text would pass its chance words off as evidence
        y = labels[rows]
        return log_odds([word_sets[i] for i in rows], y, 1 << WORD_BITS), log_odds([gram_sets[i] for i in rows], y, 1 << GRAM_BITS)

    fold = rng.permutation(len(labels)) % FOLDS
    x_of: list = [None] * len(labels)
    for k in range(FOLDS):
        other = tables(np.flatnonzero(fold != k))
        for at, starts, types, inverse, chars in parts:
            rows = inputs_of(other, types, *chars)
            for i in range(len(starts) - 1):
                if fold[at + i] == k:
                    x_of[at + i] = rows[inverse[starts[i] : starts[i + 1]]]
    # All windows of all documents, as places in one array whose last row is padding.
    sizes = np.array([len(x) for x in x_of])
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate([*x_of, np.zeros((1, COUNTED), np.float32)])
    kind = np.concatenate([*kinds_of, np.array([first_type], np.int32)])
    del x_of, parts, kinds_of  # the task's memory is its executor's
    word_slots, gram_slots = np.concatenate([*word_slots, [0]]), np.concatenate(gram_slots) if gram_slots else np.zeros(0, np.int16)
    gram_bounds = np.concatenate([*gram_bounds, gram_bounds[-1][-1:]])
    e = {k: (rng.standard_normal((1 << EMBEDDING_BITS, EMBEDDED)) * 0.1).astype(np.float32) for k in ("word", "gram")}
    window_starts = [windows_of(n) for n in sizes]
    doc = np.repeat(np.arange(len(sizes)), [len(w) for w in window_starts])
    place = ((begin[doc] + np.concatenate(window_starts))[:, None] + np.arange(WINDOW)).astype(np.int32)
    inside = place < (begin + sizes)[doc][:, None]
    place[~inside] = len(flat) - 1
    strength = np.maximum(flat[:, 0], flat[:, 4])[place].max(axis=1)

    def look(chosen, shown):
        """Inputs and validity of windows, and what brings the gradient back to the embeddings, of which those `shown` are not 0."""
        used, which = np.unique(kind[place[chosen]], return_inverse=True)
        grams, owner = ragged(gram_bounds, used)
        slots = word_slots[used], gram_slots[grams], owner
        learned = embedded({k: v * shown[k] for k, v in e.items()}, *slots)
        x = np.concatenate([flat[place[chosen]], learned[which.reshape(place[chosen].shape)]], axis=2)
        return np.ascontiguousarray(x.transpose(1, 0, 2)), np.ascontiguousarray(inside[chosen].T.astype(np.float32)), (which.reshape(place[chosen].shape).T.ravel(), slots)

    def to_embeddings(dx, valid, which, slots, shown):
        words, grams, owner = slots
        dx = (dx[:, :, COUNTED:] * valid[:, :, None]).reshape(-1, 2 * EMBEDDED)
        by_type = np.stack([np.bincount(which, dx[:, i], minlength=len(words)) for i in range(2 * EMBEDDED)], axis=1)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        by_gram = (by_type[:, EMBEDDED:] / n)[owner]
        rows = 1 << EMBEDDING_BITS
        word = np.stack([np.bincount(words, by_type[:, i], minlength=rows) for i in range(EMBEDDED)], axis=1)
        gram = np.stack([np.bincount(grams, by_gram[:, i], minlength=rows) for i in range(EMBEDDED)], axis=1)
        return {"word": (word * shown["word"]).astype(np.float32), "gram": (gram * shown["gram"]).astype(np.float32)}

    p = initial(rng)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (p | e).items()}
    everything = dict.fromkeys(e, np.float32(1))
    step = 0
    for turn in range(ROUNDS):
        order = np.lexsort((-strength, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        toxic = labels[doc[order]] == 1
        positive, negative = order[toxic & (rank == 0)], order[~toxic & (rank < 3)]
        if turn == 0:  # some plain windows, lest only conspicuous ones be known as clean
            clean = order[~toxic]
            negative = np.concatenate([negative, rng.choice(clean, min(len(clean), len(negative) // 2), replace=False)])
        for _ in range(STEPS):
            chosen = np.concatenate([rng.choice(positive, MINIBATCH // 3), rng.choice(negative, MINIBATCH - MINIBATCH // 3)])
            shown = {k: (rng.random((1 << EMBEDDING_BITS, 1)) < 0.5).astype(np.float32) * np.float32(2) for k in e}
            x, valid, back = look(chosen, shown)
            y, kept = forward(p, x, valid, True)
            g = backward(p, x, valid, y, labels[doc[chosen]].astype(np.float32), kept)
            g |= to_embeddings(g["inputs"], valid, *back, shown)
            step += 1
            for whole in (p, e):
                for k in whole:  # Adam; embeddings learn slowly and decay, so that they tell what many documents share
                    m, v = moments[k]
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] * g[k] - v)
                    rate = RATE if whole is p else RATE * 0.1
                    whole[k] = (whole[k] * (1 if whole is p else 0.999) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        if turn < ROUNDS - 1:
            strength = np.concatenate([forward(p, *look(np.arange(i, min(i + 512, len(doc))), everything)[:2]) for i in range(0, len(doc), 512)])
    return {"p": p, "e": e, "tables": tables(np.arange(len(labels)))}


def score_texts(model: dict | None, column: pa.Array) -> np.ndarray:
    """Score of each text: its most toxic window's; a text without words is scored as one empty window."""
    out = np.zeros(len(column))
    if model is None:
        return out
    p = model["p"]
    for at, words, types, inverse, chars in parse(column, SCORED_BYTES):
        of_words, of_grams = embedding_slots(types, chars[0])
        learned = embedded(model["e"], of_words, of_grams, np.repeat(np.arange(len(types)), np.diff(chars[1])))
        inputs = np.concatenate([inputs_of(model["tables"], types, *chars), learned], axis=1)
        inputs = np.concatenate([inputs, np.zeros((1, INPUTS), np.float32)])
        # Projections depend on the word type alone, so they are made once a type; the last row is padding.
        fx, bx = inputs @ p["Wf"] + p["cf"], inputs @ p["Wb"] + p["cb"]
        n = words.counts()
        starts = [windows_of(k) for k in n]
        doc = np.repeat(np.arange(len(n)), [len(s) for s in starts])
        first = np.concatenate(starts) + words.starts[doc]
        place = first[None, :] + np.arange(WINDOW)[:, None]
        valid = place < words.starts[doc + 1][None, :]
        kind = np.where(valid, np.append(inverse, len(types))[np.minimum(place, len(inverse))], len(types))
        best = np.zeros(len(n))
        for b in range(0, len(first), 2048):
            k, v = kind[:, b : b + 2048], valid[:, b : b + 2048].astype(np.float32)
            np.maximum.at(best, doc[b : b + 2048], forward(p, (fx[k], bx[k]), v))
        out[at : at + len(n)] = best
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole texts and labels of the bounded training sample: the first of each label by the id's hash, outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(held_out("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(4))
    present = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    ids = present.where("toxic = 1").orderBy(order).limit(POSITIVES).unionByName(present.where("toxic = 0").orderBy(order).limit(NEGATIVES))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id").where("text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def fit_task(batches):
    """mapInArrow function over the whole sample (doc_id, text, toxic) -> the pickled model, or nothing where one label is missing."""
    found = list(batches)
    if not found:
        return
    rows = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(rows["toxic"].to_pylist(), dtype=np.float64)
    if 0 < y.sum() < len(y):
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(rows["text"].combine_chunks(), y))], pa.binary())})


def fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, trained by one task on the bounded sample, so the driver only passes 5 MB on."""
    row = sample(docs, labels).repartition(1).mapInArrow(fit_task, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of `docs`.

    A null text counts as empty.  Without labelled texts of both kinds every
    score is 0.  Training is deterministic, so reruns agree.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model.value, batch.column(1)))], ["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rated.select("doc_id", F.coalesce(held_out("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below the threshold; rows are filtered where they are, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = score_texts(model.value, batch.column(place).cast(pa.large_binary())) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
