import random
import re

import numpy as np
import pandas as pd

from tasteloom.llm import common, minhash
from tasteloom.llm.minhash import near_duplicates

FIXED = "doc_id long, text string, node string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(500)]
    rows, i = [], 0
    for _ in range(20):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for c in range(rng.choice([1, 2, 12, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4]) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w).upper() if c % 3 == 0 else "\t".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one two"), (i + 4, "One  TWO "), (i + 5, "x " * 30000)]
    return rows


def test_same_as_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], FIXED)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], FIXED)).count() == 0
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", "x"), (None, "q r", None), (2, None, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, FIXED)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, True), (None, 1, None, True), (2, 0, 2, True)], key=str)


def test_unlinked_members_of_a_long_list_are_not_expanded_into_pairs(spark, monkeypatch):
    """Sixty documents too far from sixty near copies, yet likely by signature: before, every such pair was a row that met both sets."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]

    def edited(k, edits):
        w = list(base)
        for j, at in enumerate(rng.sample(range(5, 195), edits)):
            w[at] = f"e{k}_{j}"
        return " ".join(w)

    rows = [(k, edited(k, 1 if k % 2 else 7)) for k in range(120)]
    met, whole = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets: met.append(pairs.count()) or whole(pairs, sets))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert max(met) < 600


def test_links_of_a_block_join_its_components():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40 + 20 * (k % 3), 60)) + 1000 * (k % 3) for k in range(60)]
    rows = [{"seeker": s, "node": bytes([k]), "label": bytes([k]), "shingles": sets[k]} for s in (True, False) for k in range(60) if not s or k % 2]
    got = minhash._compare(pd.DataFrame(rows))
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    def classes(pairs):
        root[:] = range(60)
        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(x for x in range(60) if find(x) == r) for r in map(find, range(60))}

    pairs = [(a[0], b[0]) for a, b in zip(got["a"], got["b"])]
    assert pairs and all(linked(a, b) for a, b in pairs) and len(pairs) < 60
    assert classes(pairs) == classes([(a, b) for a in range(1, 60, 2) for b in range(60) if a != b and linked(a, b)])


def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_further_edges_meet_only_what_is_still_apart(spark, monkeypatch):
    """Before, every call began again with all edges, and a settled star took a whole round to be seen: five written tables."""
    rng = random.Random(4)
    star = [(k, 0) for k in range(1, 40)] + [(0, 5), (7, 7)]
    chain = [(k, k + 1) for k in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labelled = lambda df: {r.node: r.label for r in df.collect()}
    made, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: made.append(name) or write(df, name))
    assert labelled(common.components(frame(star))) == roots([e for e in star if e[0] != e[1]])
    assert made == ["edges", "least"]
    labels = common.components(frame(chain))
    assert labelled(labels) == roots([e for e in chain if e[0] != e[1]])
    made.clear()
    assert labelled(common.joined(labels, frame([(130, 100), (101, 129), (9, 9)]))) == labelled(labels)
    assert made == ["apart"]
    more = [(115, 1), (300, 301), (301, 220), (2, 300)]
    assert labelled(common.joined(labels, frame(more))) == roots([e for e in chain + more if e[0] != e[1]])
    assert labelled(common.joined(common.components(frame([])), frame(more))) == roots(more)
