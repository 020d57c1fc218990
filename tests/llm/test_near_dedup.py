import random
from pathlib import Path

import pytest

from tidemark.llm.near_dedup import keep_one_of_each, near_duplicates
from tidemark.llm.shared import components, shared_dir, sweep

SCHEMA = "doc_id long, text string, component_id string, id string, h string"


def shingles(text, width):
    words = [] if text is None else text.encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "Straße"]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 20, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if rng.random() < 0.1 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_matches_brute_force(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    found = near_duplicates(docs, width=width).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (7, long), (8, long + " tail"), (8, long + " tail")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width=2).collect())
    assert [x[:3] for x in got] == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 19999, 7), (8, 20000, 7), (8, 20000, 7)]
    assert sorted(r.doc_id or 0 for r in keep_one_of_each(docs, width=2).collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    texts = {"t": " ".join(f"t{i}" for i in range(30)), "u": " ".join(f"u{i}" for i in range(30))}
    docs = spark.createDataFrame([(i, texts[t], None, None, None) for i, t in ((1, "t"), (8, "t"), (8, "u"), (9, "u"))], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()} == {(1, 1), (8, 1), (9, 1)}
    assert [r.doc_id for r in keep_one_of_each(docs).collect()] == [1]


def test_components(spark):
    rng = random.Random(5)
    for edges in ([], [(3, 3)], [(i, i + 1) for i in range(40)], [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]):
        lowest = {x: x for e in edges for x in e}
        for _ in edges:
            for a, b in edges:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        found = {r["id"]: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert found == {x: c for x, c in lowest.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_all_tables_go(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    sweep(spark)
    before = {p.name for p in folder.iterdir()}
    near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in corpus(3, 20)], SCHEMA)).collect()
    assert {p.name for p in folder.iterdir()} - before
    sweep(spark)
    assert {p.name for p in folder.iterdir()} <= before
