import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tasteloom.llm import packing, secrets, tokens

FIXED = "doc_id long, text string, source string, queue string"
TEXTS = [None, "", " ", "a", "two  spaces  and\n\n lines <|endoftext|> x", "é ñ   ü\t z " * 50, "nospace" * 4000, "word " * 9000,
         "Ein Satz. Noch einer, und <s> mehr! " * 700, "日本語 テキスト" * 3000]


def docs(spark):
    rows = [(i, t, "s1" if i % 3 else None, "q") for i, t in enumerate(TEXTS)] + [(None, "null id", "s2", None), (3, "again", "s1", "x")]
    return rows, spark.createDataFrame(rows, FIXED)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, df = docs(spark)
    got = packing.pack(df, weights={"s1": 3.0, "s2": 1.0}).collect()
    whole = defaultdict(list)
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        whole[i].append(ids)
    seen, filled = defaultdict(int), defaultdict(list)
    for r in got:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                   for ids in whole[r.doc_id])
        seen[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in whole.items()}
    for n, spans in filled.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or n == max(filled)
    assert packing.pack(spark.createDataFrame([], FIXED)).count() == 0


def test_units_give_the_ids_of_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole, by_units = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(7)
    bits = list("aZ9 ,.'\n\t\r") + ["  ", "\n\n", "é", "×", "÷", "«", "\u0301", "\u00a0", "\u0085", "\u2028", "日", "'s", "'t", "<|endoftext|>", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(20000)] + [t or "" for t in TEXTS]
    got = by_units(pa.array(texts))
    assert [list(x) for x in got] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_pack_keeps_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w%d" % rng.randint(0, 99) for _ in range(rng.randint(1, 300))), "a" if rng.random() < 0.8 else "b", None) for i in range(1500)]
    of = {r[0]: r[2] for r in rows}
    got = packing.pack(spark.createDataFrame(rows, FIXED)).collect()
    total, share = sum(r.length for r in got), sum(r.length for r in got if of[r.doc_id] == "a")
    n = max(r.sequence_id for r in got)
    for lo in range(0, n - 20, 20):
        part = [r for r in got if lo <= r.sequence_id < lo + 20]
        assert abs(sum(r.length for r in part if of[r.doc_id] == "a") / sum(r.length for r in part) - share / total) < 0.1


def windows_of(got, of):
    """Tokens by window and source."""
    out = defaultdict(lambda: defaultdict(int))
    for r in got:
        out[r.sequence_id][of[r.doc_id]] += r.length
    return [out[n] for n in range(len(out))]


def skewed(spark):
    """One document of about half of all tokens, short ones of two more sources, and many sources of one word."""
    rows = [(0, " ".join(f"w{i % 97}" for i in range(20_000)), "a", None)]
    rows += [(i, " ".join(f"v{(i * k) % 31}" for k in range(60 + i % 90)), "b" if i % 3 else "c", None) for i in range(1, 200)]
    rows += [(1000 + i, "one", f"tiny{i}", None) for i in range(40)]
    return {r[0]: "t" if r[2].startswith("tiny") else r[2] for r in rows}, spark.createDataFrame(rows, FIXED).repartition(5, "doc_id")


def test_every_window_holds_the_shares(spark):
    of, df = skewed(spark)
    mixed = windows_of(packing.pack(df).collect(), of)
    held = {s: sum(w[s] for w in mixed) for s in "abct"}
    for w in mixed[:-2]:
        assert all(abs(w[s] - 1024 * held[s] / sum(held.values())) <= 0.02 * 1024 for s in held)
    # targets other than the shares held, until the first queue is empty
    target = {"a": 0.2, "b": 0.7, "c": 0.1}
    all_named = target | {f"tiny{i}": 0 for i in range(40)}
    other = windows_of(packing.pack(df, weights=all_named).collect(), of)
    full = min(int(held[s] / target[s]) for s in target) // 1024
    assert full > 10
    for w in other[:full]:
        assert all(abs(w[s] - 1024 * target[s]) <= 1 for s in target)
    assert {s: sum(w[s] for w in other) for s in held} == held


def test_a_target_of_zero_comes_last(spark):
    of, df = skewed(spark)
    got = packing.pack(df, weights={"a": 0}).collect()
    place = lambda r: r.sequence_id * 1024 + r.offset
    assert max(place(r) for r in got if of[r.doc_id] != "a") < min(place(r) for r in got if of[r.doc_id] == "a")
    nothing = packing.pack(df, weights={name: 0 for name in ("a", "b", "c", *[f"tiny{i}" for i in range(40)])}).collect()
    for rows in (got, nothing):
        spans = sorted((place(r), r.length) for r in rows)
        assert spans[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        packing.pack(df, weights={"a": -1.0})


def test_rounds_as_served_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        held = rng.integers(1, 9000, rng.integers(1, 9)).tolist()
        credits = rng.uniform(4, 300, len(held))
        rounds = packing.Rounds(held, (credits * 1024 / credits.sum()).tolist())
        want, done, upto, r = [], [0] * len(held), rounds.upto, 0
        while sum(done) < sum(held):
            r += 1
            for j in range(len(held)):
                due = min(held[j], int(np.floor(r * upto[j + 1]) - np.floor(r * upto[j])))
                want += [(j, p) for p in range(done[j], due)]
                done[j] = max(done[j], due)
        docs = []
        for j, n in enumerate(held):
            cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
            docs += [(j, p, q - p) for p, q in zip(cuts, cuts[1:])]
        got = {}
        for d, start, length, at in zip(*packing.pieces(*rounds.slices(*np.array(docs).T))):
            assert at // 1024 == (at + length - 1) // 1024
            got.update({at + k: (docs[d][0], docs[d][1] + start + k) for k in range(length)})
        assert [got[k] for k in range(len(want))] == want


def test_running_total(spark):
    from tasteloom.llm.common import running_total

    df = spark.range(5000).selectExpr("id as o", "id % 7 as s")
    got = {r.o: r.t for r in running_total(df, "o", "s", "t", width=8).collect()}
    run = 0
    for i in range(5000):
        assert got[i] == run
        run += i % 7


def test_counts_are_those_of_the_whole_text(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows, df = docs(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t, *_ in rows for n in [len(sp.encode(t or ""))]]
    assert got == sorted(want, key=str)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "a", " ", "  ", "é", "x.", "\n", "Straße ", "tion ", "日"]) for _ in range(rng.randint(1, 4000)))
        assert tokens.long_count(sp, text, rng.choice([50, 200, 900]), rng.choice([4, 16])) == len(sp.encode(text))


BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_secrets(spark):
    rng = random.Random(3)
    bits = ["token", "secret=", "Password: ", "api_key", "apikey=", "=", ":", " ", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef0123456789", "é", "\n", "日", "x", '"', "deadbeef",
            "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl ", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "secret=token: abcdefgh", "z" * 200_000 + "AKIA" + "Q" * 16]
    rows = [(i if i % 50 else None, t, "s", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_spans string, _rules string")
    scanned = secrets.scan(df.withColumn("_id", F.lit("x")))
    assert scanned.columns == [*df.columns[:2], "_rules", "_id", "secret_spans"]
    got = sorted(((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.digest(scanned).collect()), key=str)
    import hashlib

    want = []
    for i, t, *_ in rows:
        b = base_spans(t)
        want.append((i, hashlib.sha256(",".join(b).encode()).hexdigest(), *[sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex")]))
    assert got == sorted(want, key=str)
    clean = scanned.select("text", secrets.redacted(scanned).alias("clean")).collect()
    for r in clean:
        assert (r.clean is None) == (r.text is None)
        assert not r.clean or not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.clean)


@pytest.mark.parametrize("pattern, query", [
    (r"[0-9a-f]{24,}", [set()]), (r"AKIA[A-Z]+", [{"aki", "kia"}]), (r"(abcd|xyz)q?rst", [{"xyz", "rst"}, {"abc", "bcd", "rst"}]), (r"(ab|cde)+", [set()])])
def test_trigram_query(pattern, query):
    assert sorted(map(sorted, secrets.trigram_query(pattern))) == sorted(map(sorted, query))
