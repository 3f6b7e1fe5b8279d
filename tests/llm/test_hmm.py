import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tasteloom.llm import hmm
from tasteloom.llm.common import session

RNG = np.random.default_rng(3)
FIRST, MOVE, EMIT = (x / x.sum(axis=-1, keepdims=True) for x in (RNG.random(3), RNG.random((3, 3)), RNG.random((3, 5))))
EMIT = EMIT.T.copy()
EMIT /= EMIT.sum(axis=0)


def paths(seq):
    for states in itertools.product(range(3), repeat=len(seq)):
        p = FIRST[states[0]] * EMIT[seq[0], states[0]]
        for a, b, x in zip(states, states[1:], seq[1:]):
            p *= MOVE[a, b] * EMIT[x, b]
        yield states, p


def test_forward_and_counts_as_over_all_paths():
    seqs = [[0, 1, 4, 2], [3], [2, 2, 1, 0, 4], [1, 0]]
    flat, sizes = np.array(sum(seqs, [])), np.array([len(s) for s in seqs])
    starts = np.cumsum(sizes) - sizes
    want = [math.log10(sum(p for _, p in paths(s))) for s in seqs]
    assert np.allclose(hmm.forward(flat, starts, sizes, FIRST, MOVE, EMIT), want)
    one, two, three = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        z = sum(p for _, p in paths(s))
        for states, p in paths(s):
            one[states[0]] += p / z
            for a, b in zip(states, states[1:]):
                two[a, b] += p / z
            for x, a in zip(s, states):
                three[x, a] += p / z
    got = hmm.expected(flat, starts, sizes, FIRST, MOVE, EMIT)
    assert np.allclose(got[0], one) and np.allclose(got[1], two) and np.allclose(got[2], three) and np.isclose(got[3], sum(want))


def test_scores(spark):
    rng = random.Random(1)
    vocab = [[f"{p}{k}" for k in range(150)] for p in ("x", "Y")]
    rows = [(i, " ".join(rng.choice(vocab[i % 2]) for _ in range(rng.randint(1, 300)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "never seen words"), (None, "x1 x2"), (5, rows[5][1]), (403, "x1 " * 30000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, chunk string")
    got = hmm.score(df).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    c = Counter(w for i, t in rows if fold(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, fold(i) == 0, len(words(t)), sum(c[w] > 0 for w in words(t)), n,
                    round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score <= 0 for r in got)
    assert hmm.score(df.limit(0)).count() == 0 and hmm.score(df.where("doc_id is null")).count() == 1


def test_shares_of_a_class_add_up_to_one():
    rng = np.random.default_rng(4)
    sums, types = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    words = []
    for c in range(1, hmm.CLASSES):
        n = 1 if c <= hmm.TOP else int(rng.integers(0, 30))
        counts = rng.integers(1, 50, n)
        sums[c], types[c] = counts.sum(), n
        words += [(c, k) for k in counts]
    cls, count = np.array(words).T
    seen = np.bincount(cls, hmm.shares(cls, count, sums, types), hmm.CLASSES)
    every = np.arange(1 + hmm.TOP, hmm.CLASSES)
    unseen = hmm.shares(every, np.zeros(len(every), int), sums, types)
    reserve = np.maximum(types[every], np.ceil(types[every].mean()))
    assert np.allclose(seen[1:1 + hmm.TOP], 1) and np.allclose(seen[every] + reserve * unseen, 1) and (unseen > 0).all()


def test_unseen_words_are_not_likelier_than_seen_ones(spark):
    """Held-out text with new words must cost more a token than training text; before, it cost less."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.6)) % 100_000) for _ in range(150))) for i in range(400)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cost = {h: -sum(r.score for r in got if r.held_out == h) / sum(r.n_tokens for r in got if r.held_out == h) for h in (True, False)}
    assert cost[True] > cost[False]
    assert sum(r.n_known for r in got if r.held_out) < 0.97 * sum(r.n_tokens for r in got if r.held_out)


def test_counts_of_all_chunks_by_one_row_for_each_word_of_a_chunk(spark):
    rows = [(7, ["a", "b", "é"], [2, 1, 0]), (8, ["b", "c"], [3, 1]), (9, ["d", "b", "a"], [1, 0, 5]), (10, [], [])]
    found = hmm._counted(spark.createDataFrame(rows, "chunk long, words array<string>, uses array<long>")).collect()
    total, chunks = Counter(), Counter()
    for _, words, uses in rows:
        total.update(dict(zip(words, uses)))
        chunks.update(words)
    assert sorted((r.word, r.chunk, r.code, r.c, r.n) for r in found) == sorted((w, k, i, total[w], chunks[w]) for k, words, _ in rows for i, w in enumerate(words))
    assert sorted(r.word for r in found if r["head"]) == sorted(total)


def test_codes_are_deflated_and_come_back():
    rng = np.random.default_rng(6)
    codes = (rng.pareto(0.5, 200_000) * 3).astype(np.int64) % 90_000
    words, coded = np.unique(codes, return_inverse=True)
    short, dictionary = hmm._by_use(coded, pa.array(words.astype(str)))
    assert (np.array(dictionary.to_pylist(), int)[short] == codes).all() and (np.diff(np.bincount(short)) <= 0).all()
    data = hmm._packed(short)
    assert (hmm._unpacked(data) == short).all() and len(data) < 2.5 * len(codes)  # 4 bytes a token before
    assert len(hmm._unpacked(hmm._packed(short[:0]))) == 0


def test_a_round_takes_little_memory_however_long_a_chunk_is():
    """The sequences of a chunk of 600,000 tokens; 4,096 of them were learned from at once before, in over 100 MB."""
    rng = np.random.default_rng(9)
    first, move, emit = (rng.random(n) for n in (hmm.STATES, (hmm.STATES, hmm.STATES), (hmm.CLASSES, hmm.STATES)))
    first, move, emit = first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    sizes, classes = np.full(60, 10_000), rng.integers(0, hmm.CLASSES, 600_000).astype("<u2")
    batch = pa.RecordBatch.from_arrays([pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([[True] * 60]), pa.array([classes.tobytes()], pa.binary())], ["sizes", "train", "classes"])
    tracemalloc.start()
    found = next(hmm._expect(first, move, emit)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    total = sum(found.column(f"s{s}").to_numpy()[:-1 - hmm.STATES].sum() for s in range(hmm.STATES))
    assert np.isclose(total, 600_000)


def test_batches_are_bounded_in_bytes(spark):
    """Forty rows of a megabyte were one batch before."""
    session(spark)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    got = spark.range(0, 40, 1, 1).selectExpr("repeat(cast(id % 10 as string), 1000000) as text").mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in got) > 40e6 and max(r.n for r in got) < 8e6
