import random

import numpy as np

from tasteloom.llm import common, debruijn, epsgrid


def brute(rows):
    words = [(i, [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_repeats_as_by_hand(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)] + ["Él"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 400)]
    rows = []
    for i in range(60):
        w = text(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 10)
            w += p[cut:] + text(rng.randint(0, 30))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(60, "x " * 500), (61, "x " * 70), (62, "x " * 49), (63, None), (64, ""), (65, rows[7][1]), (66, rows[7][1]), (7, "tail " + rows[7][1]), (None, rows[7][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tx string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in debruijn.drop_repeats(df.drop("tx")).collect()), key=str)
    assert got == brute(rows)
    assert debruijn.drop_repeats(df.limit(0)).count() == 0


def test_texts_without_spans_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [(i, " ".join(text(80))) for i in range(300)]
    rows += [(300 + i, " ".join(text(5) + rows[i][1].split()[:60])) for i in range(10)] + [(None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    moved = []
    monkeypatch.setattr(debruijn, "deflated", lambda held: moved.append(held.count()) or common.deflated(held))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in debruijn.drop_repeats(df).collect()), key=str)
    assert got == brute(rows)
    assert max(moved) < 40  # all 311 before


def test_rows_that_meet_are_all_kept(spark):
    rows = spark.createDataFrame([(i, str(i % 7) if i % 5 else None) for i in range(2000)], "a long, b string")
    other = spark.createDataFrame([(i, str(i % 7) if i % 5 else None) for i in range(0, 2000, 10)] + [(None, None)], "a long, b string")
    kept = {r.a for r in common.meeting(rows, other, "a", "b").collect()}
    assert kept >= set(range(0, 2000, 10)) and len(kept) < 210
    assert common.meeting(rows, other.limit(0), "a", "b").count() == 0


def test_vectors_as_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.choice([1, 2, 30])):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0, 0.1, 0.2])).tolist(), int(g % 3)))
    rows += [(len(rows) + k, v, lab) for k, (v, lab) in enumerate([
        (rows[0][1], None), (None, 1), ([], 1), ([0.0] * 24, 1), ([float("nan")] * 24, 1), ([None] * 24, 1), ([1e200] * 24, 1), ([1e-200] * 24, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)])]
    rows += [(None, rows[5][1], rows[5][2]), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in epsgrid.near_vectors(df).collect()), key=str)
    unit = []
    for _, v, lab in rows:
        x = np.array(v, float) if v and None not in v else None
        ok = lab is not None and x is not None and np.isfinite(x).all() and np.abs(x).max() > 0
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    n, root = len(rows), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for a in range(n):
        groups.setdefault(find(a), []).append(rows[a][0])
    want = []
    for a in range(n):
        ids = [i for i in groups[find(a)] if i is not None]
        c = min(ids) if ids else None
        want.append((rows[a][0], links[a], c, rows[a][0] is None or rows[a][0] == c))
    assert got == sorted(want, key=str)
    assert epsgrid.near_vectors(df.limit(0)).count() == 0


def test_recursion_skips_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[np.lexsort(np.floor(x / 0.2).T[::-1])]
    u, v = epsgrid.interval_links(x, None, x[:, :3], None, 0.98, 0.2)
    assert set(zip(u, v)) == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if a < b}


def test_texts_are_moved_deflated(spark):
    """Whole texts reach the shuffle of the last join as deflated bytes, and come back as they were."""
    rows = [(1, None, 1.5), (2, "", None), (3, "a\x00 \U0001F600É\n" * 300, 0.0), (None, "x y", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other double")
    small = common.deflated(df)
    assert dict(small.dtypes)["text"] == "binary" and max(len(r.text or b"") for r in small.collect()) < 100
    assert sorted(map(tuple, common.inflated(small).collect()), key=str) == sorted(rows, key=str)

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = debruijn.drop_repeats(spark.createDataFrame([(k, "w " * 60) for k in range(3)], "doc_id long, text string"))
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(doc_id" in line)
    assert "MapInArrow" in plan[at + 1]
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(0, 0), (1, 60), (2, 60)]
