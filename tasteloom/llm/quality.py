"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document: letter case, symbols, repeated
words, repeated lines, table marks, terms that the labelled sample ties to toxic text, and the
given labels, which cover only some documents. Vote patterns are counted over all documents.
Expectation-maximisation estimates, for each labeller, how it votes on good documents and on each
kind of bad ones, and so the posterior of every pattern. The posteriors of a bounded sample train a
hashed linear scorer, which alone decides. Its features are bucketed statistics, whole words (any
length, case folded, edge punctuation off) and n-grams of ``NGRAMS`` characters over the whole text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ftrl
from .common import BASE, BASE_INV, mixed, powers, rolling, session, written

BITS = 18
FIT_ROWS = 9000  # half of them for rows with a given label, half for rows without
KEEP = 0.5
TERM_DOCS, TERM_SHARE = 5, 0.9  # a toxic term: in so many labelled documents, of which so many are toxic
LABELLERS = ["case", "symbols", "word_runs", "line_repeats", "table", "terms", "labels"]
GOOD, BAD, NONE = 1, 0, 2
NGRAMS = (2, 4)  # characters
_STATS = 6 * 12  # bucketed statistics come first among the features
_HAS_TERM = _STATS - 1
_TERM_VALUE = 5.0  # a term says more than a word
_TEXT_NORM = 8.0  # of all word and n-gram features of a text together, so that no length outweighs the statistics

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UP = np.zeros(256, bool)
_UP[65:91] = True
_DOWN = np.zeros(256, bool)
_DOWN[97:123] = True
_PLAIN = _UP | _DOWN | _SPACE
_PLAIN[128:] = True
_PLAIN[[ord(c) for c in ".,'"]] = True


_WORDY = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(1 << 16)])
_BLANK = np.array([chr(c).isspace() for c in range(1 << 16)])


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """31-bit hashes of the words and character n-grams of a text (sorted, distinct), and of its words in their order.

    A word is a run without white space, any length, less the marks at its two ends. The n-grams
    run over the whole text, a blank before and after it. Case is folded.
    """
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(raw, (1 << 16) - 1)
    blank = _BLANK[low]
    code = np.where(blank, 32, raw).astype(np.uint64)
    edge = np.nonzero(blank[1:] != blank[:-1])[0] + 1
    start, end = edge[::2], edge[1::2]
    wordy = np.nonzero(_WORDY[low] | (raw >= 1 << 16))[0]
    first, last = np.searchsorted(wordy, start), np.searchsorted(wordy, end)
    some = last > first
    # a run of marks alone is a word as it is
    start, end = start.copy(), end.copy()
    start[some], end[some] = wordy[first[some]], wordy[last[some] - 1] + 1
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(code + np.uint64(1)) * powers(BASE, len(code)), dtype=np.uint64)])
    words = mixed((run[end] - run[start]) * powers(BASE_INV, len(code))[start] + (end - start).astype(np.uint64))
    found = [words]
    for k in NGRAMS:
        if len(code) >= k:
            gram = code[:len(code) - k + 1]
            for j in range(1, k):
                gram = gram * BASE + code[j:len(code) - k + 1 + j]
            found.append(mixed(gram + np.uint64(k << 56)))
    return _distinct(np.sort((np.concatenate(found) >> np.uint64(33)).astype(np.int32))), words


def read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the statistics of a text, its marks (see ``_marks``) and the statistics, shares from 0 to 1."""
    if not text.strip():
        return np.array([_STATS - 2]), np.empty(0, np.int32), np.zeros(5)
    marks, words = _marks(text)
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    letters = _UP[raw].sum() + _DOWN[raw].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    stats = np.array([
        _UP[raw].sum() / max(1, letters),
        (~_PLAIN[raw]).sum() / len(raw),
        (words[1:] == words[:-1]).sum() / max(1, len(words) - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        (raw == ord("|")).sum() / len(words),
    ])
    bucket = np.searchsorted([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8], stats, side="right")
    return np.concatenate([np.arange(5) * 12 + bucket, [5 * 12 + min(9, int(np.log2(len(words))))]]), marks, stats


def has_term(marks: np.ndarray, terms: np.ndarray) -> bool:
    at = np.searchsorted(marks, terms)
    return bool((marks[np.minimum(at, len(marks) - 1)] == terms).any()) if len(marks) and len(terms) else False


def features(buckets: np.ndarray, marks: np.ndarray, toxic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of the scorer and their values."""
    hashed = _distinct(np.maximum(marks >> (31 - BITS), _STATS))
    few = np.append(buckets, _HAS_TERM) if toxic else buckets
    value = np.empty(len(few) + len(hashed))
    value[:len(few)] = 1
    if toxic:
        value[len(few) - 1] = _TERM_VALUE
    value[len(few):] = _TEXT_NORM / np.sqrt(max(1, len(hashed)))
    return np.concatenate([few, hashed]), value


def votes(stats: np.ndarray, toxic: bool) -> list[int]:
    """Votes of all labellers but the given labels."""
    upper, symbols, runs, repeats, table = stats
    vote = lambda x, good, bad: BAD if x >= bad else GOOD if x <= good else NONE
    return [vote(upper, 0.1, 0.3), vote(symbols, 0.04, 0.08), vote(runs, 0.05, 0.2), vote(repeats, 0.2, 0.6), vote(table, 0.02, 0.2), BAD if toxic else GOOD]


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(good) of every vote pattern (rows of votes), by expectation-maximisation over labeller behaviour.

    Bad documents are of several kinds, one to begin with for each labeller: shouted text has no
    repeats and toxic text has neither, so that one bad class, in which the labellers are
    independent, would explain a single bad vote as a good document's.
    """
    m = patterns.shape[1]
    share = np.append(np.full(m, 0.2 / m), 0.8)  # kinds of bad, then good
    rate = np.ones((m, m + 1, 3))  # labeller, class, vote
    rate[:, :m] = [0.1, 0.8, 0.1]
    rate[np.arange(m), np.arange(m)] = [0.9, 0.05, 0.05]
    rate[:, m] = [0.04, 0.9, 0.06]
    given = patterns[:, m - 1] != NONE
    covered = float(np.clip(counts[given].sum() / counts.sum(), 0.01, 0.99))
    # the given labels anchor what good and bad mean: rarely wrong, and not estimated anew
    rate[m - 1, :m] = [0.99 * covered, 0.01 * covered, 1 - covered]
    rate[m - 1, m] = [0.01 * covered, 0.99 * covered, 1 - covered]
    for _ in range(rounds):
        like = np.log(share)[None, :] + sum(np.log(rate[k][:, patterns[:, k]]).T for k in range(m))
        p = ftrl.softmax(like)
        mass = p * counts[:, None]
        share = np.maximum(mass.sum(axis=0) / max(1e-9, mass.sum()), 1e-4)
        share /= share.sum()
        for k in range(m - 1):
            for v in (BAD, GOOD, NONE):
                rate[k, :, v] = mass[patterns[:, k] == v].sum(axis=0) + 0.5
            rate[k] /= rate[k].sum(axis=1, keepdims=True)
    return p[:, m]


@dataclass
class Model:
    weights: np.ndarray  # by feature
    bias: float
    terms: np.ndarray  # marks tied to toxic text, sorted

    def score(self, text: str | None) -> float:
        buckets, marks, _ = read(text or "")
        at, value = features(buckets, marks, has_term(marks, self.terms))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ value + self.bias, -30, 30))))


def sketch(text: bytes) -> list[int]:
    """Three minima over the five-word shingles."""
    words = np.array([zlib.crc32(w) for w in text.lower().split()], np.uint64)
    shingles = rolling(mixed(words + np.uint64(1)), min(5, max(1, len(words))))
    return [int(mixed(shingles + np.uint64(k)).min()) >> 1 for k in (1, 2, 3)] if len(shingles) else []


def _varied(sample: list[tuple]) -> list[tuple]:
    """The sample without near copies, or a copied text would tie its chance words to its label: a row that shares a
    minimum of its sketch with an earlier one goes."""
    met, out = set(), []
    for row in sorted(sample, key=lambda s: s[3] == NONE):
        least = set(enumerate(row[5]))
        if not least & met:
            out.append(row)
        met |= least
    return out


def toxic_terms(known: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Marks in ``TERM_DOCS`` toxic texts or more that make up ``TERM_SHARE`` of the labelled texts with the mark."""
    toxic = [m for m, t in known if t]
    if not toxic:
        return np.empty(0, np.int32)
    marks, bad = np.unique(np.concatenate(toxic), return_counts=True)
    marks, bad = marks[bad >= TERM_DOCS], bad[bad >= TERM_DOCS]
    seen = np.zeros(len(marks))
    for m, _ in known:
        if len(m) and len(marks):
            seen += m[np.minimum(np.searchsorted(m, marks), len(m) - 1)] == marks
    return marks[bad >= TERM_SHARE * seen]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [read(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array([b.astype(np.int32).tobytes() for b, _, _ in found], pa.binary()),
                                          pa.array([m.tobytes() for _, m, _ in found], pa.binary()), pa.array([s.tobytes() for _, _, s in found], pa.binary()),
                                          pa.array([sketch((t or "").encode()) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], ["draw", "buckets", "marks", "stats", "sketch"])


def _voted(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for t in batch.column("text").to_pylist():
                _, marks, stats = read(t or "")
                v = votes(stats, has_term(marks, terms))
                codes.append(sum(x * 3 ** k for k, x in enumerate(v)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.int64())], ["doc_id", "code"])

    return run


class _Train:
    """Training rows whose features are worked out when the fit comes to them: the driver holds a text's marks once."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, bool, float]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        buckets, marks, toxic, p = self.rows[k]
        at, value = features(buckets, marks, toxic)
        return np.append(at, 1 << BITS).astype(np.int32), np.append(value, 1).astype(np.float32), p


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The scorer for ``docs`` (doc_id, text), with ``labels`` (doc_id, quality, toxic) as one labeller among others.

    The sample is the first ``fit_rows / 2`` rows with a given label and as many without, by a hash of id and text."""
    session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    given = given.select("doc_id", F.when(bad, BAD).when(F.col("quality").isNull(), NONE).otherwise(GOOD).alias("given"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # a row's place in the draw comes from its id and text, so rows with one id or none are drawn one by one, and copies once
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", "text", F.lit("quality")))
    places = drawn.select("doc_id", "draw").join(given.where(F.col("given") != NONE), "doc_id", "left").select("draw", "given", "toxic").distinct()
    picked = [r for part in ("given is not null", "given is null") for r in places.where(part).orderBy("draw").limit(fit_rows // 2).collect()]
    if not picked:
        return Model(np.zeros(1 << BITS, np.float32), 10.0, np.empty(0, np.int64))
    labelled = {r.draw: (NONE if r.given is None else r.given, r.toxic or 0) for r in picked}
    chosen = docs.sparkSession.createDataFrame([(d,) for d in labelled], "draw long")
    sample = drawn.join(F.broadcast(chosen), "draw").dropDuplicates(["draw"]).select("draw", "text")
    # written by the executors, then taken file by file, so that the driver's JVM never holds the whole sample
    sample = written(sample.mapInArrow(_sampled, "draw long, buckets binary, marks binary, stats binary, sketch array<long>"), "sample")
    sample = {r.draw: (np.frombuffer(r.buckets, np.int32), np.frombuffer(r.marks, np.int32), np.frombuffer(r.stats), *labelled[r.draw], r.sketch)
              for r in sample.toLocalIterator()}
    sample = _varied([sample[draw] for draw in sorted(sample)])
    terms = toxic_terms([(s[1], s[4]) for s in sample if s[3] != NONE])

    coded = rows.mapInArrow(_voted(terms), "doc_id long, code long").join(given.select("doc_id", "given"), "doc_id", "left")
    counted = sorted(coded.groupBy("code", F.coalesce("given", F.lit(NONE)).alias("given")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r.code, r.given))
    m = len(LABELLERS) - 1
    patterns = np.array([[r.code // 3 ** k % 3 for k in range(m)] + [r.given] for r in counted])
    good = dict(zip(map(tuple, patterns.tolist()), posteriors(patterns, np.array([float(r.n) for r in counted]))))
    train = []
    for buckets, marks, stats, given, *_ in sample:
        toxic = has_term(marks, terms)
        train.append((buckets, marks, toxic, good.get((*votes(stats, toxic), given), 0.5)))
    delta = ftrl.fit_two(_Train(train), (1 << BITS) + 1, alpha=0.2, l1=1.0, l2=0.1, epochs=8)
    return Model(delta[:-1].astype(np.float32), float(delta[-1]), terms)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "quality_score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score`` from 0 (bad) to 1 (good); a column of that name is replaced."""
    docs = docs.drop("quality_score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scored(model), ddl + ", quality_score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, kept) per row of ``docs``; kept where the score is ``KEEP`` or more.

    Null and empty texts are scored as empty ones. Rows with a null id have no given label.
    Repeated rows are scored alike. Without documents or labels the heuristics stand alone.
    """
    model = fit(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).alias("kept"))
