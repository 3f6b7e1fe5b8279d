import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tasteloom.llm import lines, resample, variants

FIXED = "doc_id long, text string, score string, rank string, key string, word string, split string, pos string"


def frame(spark, rows, parts=None):
    df = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], FIXED)
    return df.repartition(parts) if parts else df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- importance resampling

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_resample(docs, target, percent, least, buckets, seed):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(bucket(w) for _, x in docs for w in words_of(x)), Counter(bucket(w) for _, x in target for w in words_of(x))
    alls, allt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets))))
    rows = []
    for i, x in docs:
        gains = [gain(bucket(w)) for w in words_of(x)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    return Counter([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in able[len(drawn):]] + [(*r, None) for r in rows if r[1] < least])


def mixed_docs():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(200)] + ["Äther", "naïve", "ÄTHER", "日本", "x" * 90, "a\x00b", "q\x7fr"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "w1 w2 w3 w4 " * 8), (None, None), (700, None), (701, ""), (702, " ,;"), (703, "W7," * 50_000), (704, "y" * 100_000)]
    return rows + [(900, "w5 w6 w7 " * 9)] * 60 + [(5, "w1 " * 30)]


@pytest.mark.parametrize("slack", [resample.SLACK, 1e-9, 0.6])
def test_resampling_is_that_of_a_full_sort(spark, slack):
    docs, target = mixed_docs(), [(1, "w1 w2 w3 Äther"), (2, None), (3, "w5 " * 40)]
    got = resample.resampled(frame(spark, docs, 5), frame(spark, target), percent=13, least_words=9, buckets=64, seed=7, slack=slack)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target, 13, 9, 64, 7)


def test_resampling_edges(spark):
    empty = frame(spark, [])
    assert resample.resampled(empty, empty).count() == 0
    few = [(1, "a b"), (2, None)]
    got = resample.resampled(frame(spark, few), empty)
    assert Counter(map(tuple, got.collect())) == brute_resample(few, [], 10, 20, 10_000, 2024)
    same = [(4, "a b c d e")] * 50  # every score, id and text alike
    got = resample.resampled(frame(spark, same, 3), empty, percent=50, least_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 26)) and len(got) == 50


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rows = spark.range(1000).selectExpr("id % 7 as score")
    for wanted in (1, 142, 500, 999, 1000):
        low, high, above = resample.bracketed(rows, wanted, 1000, 1e-6)
        values = sorted((i % 7 for i in range(1000)), reverse=True)
        assert above == sum(high is not None and v > high for v in values) < wanted
        assert (low is None or values[wanted - 1] >= low) and (high is None or values[wanted - 1] <= high)


def test_checksums_of_slices():
    rng = random.Random(9)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 39, 40, 41, 300, 5, 0, 40]]
    ends = np.cumsum([len(p) for p in parts])
    sizes = np.array([len(p) for p in parts])
    got = resample.crc32_of(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, sizes)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_words_of_slices(monkeypatch):
    texts = [t for _, t in mixed_docs()]
    want = [(i, zlib.crc32(w.encode()) % 97) for i, t in enumerate(texts) for w in words_of(t)]
    for size in (1, 500, 1 << 21):
        monkeypatch.setattr(resample, "SLICE", size)
        got = [(first + int(r), int(b)) for first, _, rows, bucket in resample.word_buckets(pa.array(["-", *texts]).slice(1), 97) for r, b in zip(rows, bucket)]
        assert got == want


# ---- lines

def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, t in rows:
        held = (t or "").split("\n")
        kept = [x for x in held if len(key(x)) < 10 or min(docs[key(x)]) == (i is None, i or 0)]
        out.append((i, len(held), len(held) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def line_docs():
    rng = random.Random(8)
    pool = ["a common line of text", "A COMMON LINE OF TEXT ", "short", "日本語のとても長い行です", "\x0bten chars!\x0c", "ten chars!", "", "  ", "nine char"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line number {rng.randrange(300)}"] * 4) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(None, "a common line of text\nonly without an id\nx"), (None, "only without an id"), (-5, "only without an id"), (400, None), (401, ""), (402, "\n"),
             (403, "self repeated line\n" * 3), (404, "z" * 200_000 + "\nown line number 7"), (405, "own line number 8\r\n" * 5000)]
    return rows + [(7, "a common line of text\nown line number 3")] * 2 + [(500 + i, "the hot line of all\nb") for i in range(400)] + [(900, "the hot line of all")] * 40


@pytest.mark.parametrize("width", ["4", "61"])
def test_lines_as_by_brute_force(spark, width):
    rows, was = line_docs(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = lines.digest(lines.with_bitmaps(frame(spark, rows, 6))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert Counter(map(tuple, got)) == brute_lines(rows)


def test_hot_line_over_many_tasks(spark):
    """A run that begins in one task and ends in another one: only the first document keeps its lines."""
    rows = [(i, "the same line in all documents") for i in range(3000)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = lines.line_hashes(frame(spark, rows, 4)).repartitionByRange(16, "h1", "h2", "doc_id")
        assert dealt.groupBy("h1").count().count() == 1 and len(set(r[0] for r in dealt.selectExpr("spark_partition_id()").collect())) > 4
        got = lines.keep_bitmaps(frame(spark, rows, 4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(r.doc_id for r in got) == list(range(1, 3000)) and all(lines.kept_lines("a", r.keep) == "" for r in got)


def test_lines_of_empty_tables(spark):
    assert lines.with_bitmaps(frame(spark, [])).count() == 0
    got = lines.digest(lines.with_bitmaps(frame(spark, [(None, None)]))).collect()
    assert [tuple(r) for r in got] == [(None, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_bitmaps():
    text = "\n".join(str(i) for i in range(30))
    for gone in ([0], [29], [7], [8], [0, 1, 15, 16], list(range(30))):
        keep = lines.bitmap(np.array(gone))
        assert lines.kept_lines(text, keep) == "\n".join(str(i) for i in range(30) if i not in gone)
    assert lines.kept_lines(text, None) == text and lines.kept_lines(None, None) == ""


# ---- spelling variants

def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def last(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], last(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled_docs():
    rng = random.Random(6)
    rows, bases = [], ["".join(rng.choice("etaoinshé") for _ in range(rng.randint(7, 12))) for _ in range(40)] + ["ÀÉÎõüÿ×÷abc", "aaaaaaaa", "Banana" * 7, "q" * 300, "r" * 70_000]
    for k, base in enumerate(bases):
        seen = [base] * rng.choice([2, 30, 400 if len(base) < 50 else 3])
        for _ in range(60 if len(base) < 400 else 3):
            word = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(word))
                word[at:at + 1] = rng.choice([[], [rng.choice("etaoxé")], [word[at], rng.choice("etaoxé")]])
            seen += ["".join(word)] * rng.randint(1, 4)
        for j in range(0, len(seen), 9):
            rows.append((rng.randrange(10_000), " ".join(seen[j:j + 9])))
    return rows + [(None, "etaoinsh etaoinsh etaoinsx"), (None, None), (3, ""), (4, "1234567 _-! abc"), (5, "anagram nagaram margana " * 3), (5, "anagram nagaram margana " * 3)]


@pytest.mark.parametrize("node", [1, 40, 8192])
def test_variants_as_by_brute_force(spark, node):
    rows = spelled_docs()
    got = variants.variants(frame(spark, rows, 4), node).collect()
    assert {tuple(r) for r in got} == brute_variants(rows) and len(got) == len(brute_words(rows))
    assert sum(r.form is not None for r in got) > 100 and sum(r.root != r.form and r.form is not None for r in got) > 3


def test_variants_of_empty_tables(spark):
    assert variants.variants(frame(spark, [])).count() == 0
    assert variants.variants(frame(spark, [(1, None), (2, "short")])).count() == 0


def test_pairs_one_letter_apart():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(150)} | {"ab" * n + c for n in (15, 16, 17) for c in ("", "a", "b")})
    letters = variants.Letters([w.encode("latin-1") for w in words])
    for inserted in (True, False):
        pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) - len(a) == inserted and a != b]
        a, b = np.array(pairs).T
        assert letters.near(a, b, inserted).tolist() == [one_edit(words[i], words[j]) for i, j in pairs]
