"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training documents. The classifier is
fitted on at most about ``FIT_ROWS`` of them, as many of each language as there are, by
follow-the-regularised-leader with elastic net; a fifth of these only sets the temperature that
calibrates the scores. Every document is predicted from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ftrl
from .common import session, written

ORDERS = 3
BITS = 15
FIT_ROWS = 3000
BROADCAST_LANGS = 100_000
FOLDS, HELD = 4, 2
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Occurrences by hash of all character n-grams of one to three characters."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out, h = np.zeros(1 << BITS, np.int64), np.zeros(len(code), np.uint32)
    for k in range(min(ORDERS, len(code))):
        h = (h[:len(code) - k] ^ (code[k:] + np.uint32(k + 1))) * _FACTORS[k]
        h ^= h >> np.uint32(15)
        out += np.bincount(((h * _FACTORS[0]) >> np.uint32(32 - BITS)).astype(np.int64), minlength=1 << BITS)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total += gram_counts(text) > 0
            rows += 1
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["gram", "docs"])


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.nonzero(counts)[0]
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column("text").to_pylist():
            counts = gram_counts(text)
            i = np.nonzero(counts)[0]
            at.append(i.astype(np.uint16).tobytes())
            n.append(counts[i].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("part"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "part", "at", "n"])


def _predict(names: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text, ok in zip(batch.column("text").to_pylist(), batch.column("lettered").to_pylist()):
                if not ok or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, v = _features(gram_counts(text), idf)
                p = ftrl.softmax((v @ weights[at]) / heat)
                best = int(p.argmax())
                lang.append(names[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text, lang; other columns are not read).

    Learned from rows with an id, a lang and a letter that are not held out. A null text or one
    without letters, and every text if nothing can be learned, is ``und`` with score 0. A row
    with a null id is not held out and not learned from. Repeated rows are predicted alike.
    """
    spark = session(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), "lang",
                       F.coalesce(fold == HELD, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    train = rows.where("doc_id is not null and lang is not null and not held_out and lettered")
    seen = train.select("text").mapInArrow(_frequencies, "gram long, docs long").groupBy("gram").agg(F.sum("docs")).collect()
    seen = {g: n for g, n in seen}
    idf = np.full(1 << BITS, 1.0)
    total = seen.pop(-1, 0)
    if seen:
        idf[list(seen)] = np.log((1 + total) / (1 + np.array(list(seen.values())))) + 1

    per = written(train.groupBy("lang").agg(F.count("*").alias("held")), "languages")
    langs = per.count()
    share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / (F.col("held") * F.lit(max(1, langs))))
    shares = per.select("lang", share.alias("share"))
    if langs <= BROADCAST_LANGS:  # texts then stay where they are, however many a language has
        shares = F.broadcast(shares)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    part = F.pmod(F.xxhash64("doc_id", F.lit("heat")), F.lit(5))
    picked = train.select("lang", "text", chance.alias("chance"), part.alias("part")).join(shares, "lang").where("chance < share")
    sample = picked.select("lang", "part", "text").mapInArrow(_sparse, "lang string, part long, at binary, n binary").limit(2 * fit_rows).collect()
    names = sorted({r.lang for r in sample})
    built = []
    for r in sorted(sample, key=lambda r: (r.lang, r.at, r.n)):  # an order that does not depend on tasks
        at, n = np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.uint32)
        v = (1 + np.log(n)) * idf[at]
        built.append((at, v / max(np.sqrt(v @ v), 1e-12), np.eye(len(names))[names.index(r.lang)], r.part))
    weights = ftrl.fit([b[:3] for b in built if b[3]] or [b[:3] for b in built], 1 << BITS, max(1, len(names)))
    kept = [b for b in built if not b[3]]
    heat = ftrl.temperature(np.array([v @ weights[i] for i, v, *_ in kept]), np.array([b[2] for b in kept]))
    return rows.select("doc_id", "held_out", "lettered", "text").mapInArrow(
        _predict(names, idf, weights.astype(np.float32), heat), "doc_id long, held_out boolean, lang_pred string, score double")
