import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteloom.llm import decontaminate, ftrl, langid, quality

FIXED = "doc_id long, text string, lang string, score double"
LANGS = {"aa": ["kalo", "mira", "tun", "esto", "vani"], "bb": ["schrut", "wertz", "unk", "dorf", "zwek"], "cc": ["éla", "où", "nué", "tré", "beau"]}


def corpus(n=240):
    rng = random.Random(9)
    return [(i, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(5, 60))), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def test_language(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (None, "kalo mira tun", None), (903, "wertz dorf " * 9000, None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + extra], FIXED)
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "aa"] and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    nothing = langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).count() == 0


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 2000)
    logits = np.eye(3)[np.where(rng.random(2000) < 0.8, y, rng.integers(0, 3, 2000))] * 20
    assert ftrl.temperature(logits, np.eye(3)[y]) > 5


def test_quality(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        kind = rng.choice(["good"] * 6 + ["shout", "runs", "toxic"])
        if kind == "shout":
            w = [x.upper() + "!!" for x in w]
        elif kind == "runs":
            w = [w[k // 30] for k in range(len(w))]
        elif kind == "toxic":
            w[rng.randrange(len(w))] = rng.choice(["vilezz", "hatezz"])
        rows.append((i, " ".join(w), kind, 0.1))
        if i % 2:
            labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic")))
    extra = [(5000, None, "x", None), (5001, "", "x", None), (None, rows[0][1], "x", None), (5002, "word " * 40000, "x", None)]
    df = spark.createDataFrame(rows + extra, FIXED)
    given = spark.createDataFrame(labels + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(df, given).collect()}
    assert len(got) == len(rows) + 4 and not got[5002]
    share = lambda kind: np.mean([got[i] for i, _, k, _ in rows if k == kind])
    assert share("good") > 0.97 and share("shout") < 0.05 and share("runs") < 0.05 and share("toxic") < 0.2
    assert quality.classify(df.limit(0), given).count() == 0
    assert quality.classify(df.limit(9), given.limit(0)).count() == 9


TERMS = {
    "short": (lambda rng: "vex", lambda rng: "vax"),
    "quoted": (lambda rng: rng.choice("\"'([{<") + "scumbag" + rng.choice("\"')]}>!"), lambda rng: rng.choice("\"'([{<") + "scumble" + rng.choice("\"')]}>!")),
    "late": (lambda rng: "considerzzz", lambda rng: "consideration"),
    "unspaced": (lambda rng: "坏蛋", lambda rng: "好蛋"),
}


@pytest.mark.parametrize("kind", list(TERMS))
def test_toxic_terms_of_any_shape(spark, kind):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    signs = [chr(0x4E00 + k) for k in range(300)]
    rows, labels = [], []
    for i in range(700):
        toxic = rng.random() < 0.2
        w = [rng.choice(signs if kind == "unspaced" else vocab) for _ in range(rng.randint(20, 60))]
        w[rng.randrange(len(w))] = TERMS[kind][0 if toxic else 1](rng)
        rows.append((i, ("" if kind == "unspaced" else " ").join(w), toxic))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([got[i] for i, _, t in rows if t]) < 0.2 and np.mean([got[i] for i, _, t in rows if not t]) > 0.97


def test_fit_sample_holds_the_sparse_labels(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda *more: " ".join([*(rng.choice(vocab) for _ in range(20)), *more])
    rows = [(i, text("vex") if i < 20 else text()) for i in range(80)]
    rows += [(None if i % 3 == 0 else 500 if i % 3 == 1 else i, text()) for i in range(1000, 2200)]
    given = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(80)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = quality.fit(df, given, 200), quality.fit(df.repartition(7).orderBy(F.rand(3)), given, 200)
    assert quality.has_term(quality.read("so vex")[1], one.terms)
    assert (one.terms == two.terms).all() and (one.weights == two.weights).all() and one.bias == two.bias


def brute(rows, items):
    w = lambda t: [x for x in (t or "").lower().split()]

    def shingles(ws, k):
        return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}

    weight = lambda s: sum(len(x) for g in s for x in g)
    out = []
    for i, t in rows:
        found = set()
        ws = w(t)
        for n, it in items:
            iw = w(it)
            k = min(5, len(iw))
            if not iw or len(ws) < k:
                continue
            b = shingles(iw, k)
            for s in range(max(1, len(ws) - len(iw) + 1)):
                a = shingles(ws[s:s + len(iw)], k)
                if weight(a & b) >= 0.75 * weight(a | b):
                    found.add(n)
        out.append((i, sorted(found)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.choice([20, 30, 45, 60]))) for k in range(12)] + [(50, ["alone", "three", "words"])]
    rows = []
    for i in range(80):
        w = text(rng.randint(0, 150))
        if i % 3 == 0:
            p = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 0, 4])):
                p[rng.randrange(len(p))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in p]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(80, None), (81, ""), (82, " ".join(items[0][1][:18])), (None, " ".join(items[1][1])), (3, rows[3][1]), (83, "pad " * 20000 + " ".join(items[2][1]))]
    listed = [(k, " ".join(x)) for k, x in items] + [(60, None), (61, " ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string")
    it = spark.createDataFrame(listed, "item_id long, text string")
    got = decontaminate.report(df, it).collect()
    assert sorted(((r.doc_id, r.item_ids) for r in got), key=str) == brute(rows, listed)
    assert all(r.contaminated == (r.n_items > 0) for r in got)
    clean = decontaminate.clean(df, it)
    assert clean.columns == df.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.report(df.limit(0), it).count() == 0 and not any(r.contaminated for r in decontaminate.report(df, it.limit(0)).collect())


@pytest.mark.parametrize("letters, replaced", [(300, 19), (150, 19), (3, 18)])
def test_decontamination_of_unequal_words(spark, letters, replaced):
    """Items of 20 words with one long word as fifth; a copy has its last or a late word replaced."""
    rng = random.Random(letters)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items, rows = [], []
    for i in range(60):
        w = [word(5) for _ in range(20)]
        w[4] = word(letters)
        items.append((i, " ".join(w)))
        w[replaced] = word(5)
        rows.append((i, " ".join([word(5) for _ in range(i)] + w + [word(4) for _ in range(30)])))
    want = brute(rows, items)
    got = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, due = {(r.doc_id, i) for r in got for i in r.item_ids}, {(d, i) for d, ids in want for i in ids}
    assert found <= due and len(due) == 60 and len(found) == 60


def test_votes_outgrow_no_lane(spark):
    """The fingerprint equals one counted bit by bit, with weights up to that of a very long word."""
    rng = random.Random(2)
    rows = [(n, [(rng.getrandbits(64) - (1 << 63), rng.choice([1, 30, 400, 5_000_000])) for _ in range(n)]) for n in (0, 1, 2, 57, 20_000)]
    df = spark.createDataFrame(rows, "n long, shingles array<struct<h: long, w: int>>")
    for r in decontaminate.fingerprinted(df).collect():
        votes = [(s.h % (1 << 64), round(math.sqrt(s.w) * 16)) for s in r.shingles]
        total = sum(v for _, v in votes)
        assert r.fp % (1 << 64) == sum(1 << j for j in range(64) if 2 * sum(v for h, v in votes if h >> j & 1) > total)


@pytest.mark.parametrize("n", [1, 40])
def test_radius_is_covered_by_blocks(spark, n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    flip = [x ^ sum(1 << b for b in rng.sample(range(63), decontaminate.RADIUS)) for x in base]
    df = spark.createDataFrame(list(zip(base, flip)), "x long, y long")
    from pyspark.sql import functions as F

    assert df.where(F.arrays_overlap(decontaminate._blocks(F.col("x")), decontaminate._blocks(F.col("y")))).count() == n


def test_stages_with_clashing_names(spark):
    """Columns named as the stages' own helpers pass through, and the decisions are the same."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "x", "y"), (2, text, "x", "y"), (3, "nothing of the kind here at all", "x", "y"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _bad string")
    kept = corpus_pipeline.near_dedup(spark, docs, "unused")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4]
