"""Repeated spans across documents by compaction of a de Bruijn graph over words.

Words are symbols and runs of ``K`` words are edges. A window of ``WINDOW`` words is a path of
WINDOW - K + 1 edges; it is filed under its least edge by hash (its minimizer), which every
other occurrence of the window shares. Consecutive windows with one minimizer are a segment: a
path of the graph. Segments of a minimizer that occur in one document only cannot repeat. Where
all segments of a minimizer spell the same words, the path has no branch: it is compacted and
judged as one, by its least document. Only branching paths are opened into their windows, read
back from the source coordinates and compared word for word by a 96-bit hash. Neighbouring
paths glue into spans of the document. Joins and grouping run on minimizers and window hashes;
only texts that may have spans are shuffled to meet them, deflated, and no row is larger than a
document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, BASE_INV, deflated, each_row, inflated, list_column, lists_of, may_meet, meeting, mixed, powers, rolling, session, word_hashes, written

WINDOW, K = 50, 16
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


def segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's word hashes: minimizer, first window, number of windows and spelling of every segment."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    seed = _least(rolling(h, K), WINDOW - K + 1)
    start = np.concatenate([[0], np.nonzero(seed[1:] != seed[:-1])[0] + 1])
    size = np.diff(np.concatenate([start, [n]]))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _SALT) * powers(BASE, len(h)), dtype=np.uint64)])
    spelled = mixed((run[start + size + WINDOW - 1] - run[start]) * powers(BASE_INV, len(h))[start] + size.astype(np.uint64))
    return seed[start], start, size, spelled


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols, rows in each_row(batches, "h"):
        found = [segments(r) for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        flat = [np.concatenate([f[i] for f in found]) for i in range(4)]
        yield pa.RecordBatch.from_arrays([
            pa.array(flat[0].view(np.int64)), cols["doc_id"].take(pa.array(of)), cols["tx"].take(pa.array(of)),
            pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].view(np.int64)),
        ], ["seed", "doc_id", "tx", "start", "size", "spelled"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens the listed segments into windows with their hash and place."""
    for cols, rows in each_row(batches, "h"):
        starts, at = lists_of(cols["starts"])
        sizes, _ = lists_of(cols["sizes"])
        out = [[], [], [], []]
        for r, h in enumerate(rows):
            s, n = starts[at[r]:at[r + 1]].astype(np.int64), sizes[at[r]:at[r + 1]].astype(np.int64)
            ends = np.cumsum(n)
            place = np.repeat(s - (ends - n), n) + np.arange(ends[-1])
            out[0].append(rolling(h, WINDOW)[place])
            out[1].append((rolling(mixed(h ^ _SALT), WINDOW) >> np.uint64(32))[place])
            out[2].append(np.full(len(place), r))
            out[3].append(place)
        one, two, of, place = [np.concatenate(x) for x in out]
        for i in range(0, len(one), 100_000):
            cut = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(one[cut].view(np.int64)), pa.array(two[cut].astype(np.uint32).view(np.int32)),
                cols["doc_id"].take(pa.array(of[cut])), cols["tx"].take(pa.array(of[cut])), pa.array(place[cut].astype(np.int32)),
            ], ["h1", "h2", "doc_id", "tx", "place"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges, sorted and disjoint, covered by the listed windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, at = lists_of(batch.column("starts"))
        sizes, _ = lists_of(batch.column("sizes"))
        lows, highs = [], []
        for i, j in zip(at[:-1], at[1:]):
            s, n = starts[i:j].astype(np.int64), sizes[i:j].astype(np.int64)
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate((s + n + WINDOW - 1)[order])
            new = np.concatenate([[True], s[1:] > e[:-1]])
            lows.append(s[new])
            highs.append(e[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(s) - 1]])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tx"), list_column(lows, pa.int64()), list_column(highs, pa.int64())],
                                         ["doc_id", "tx", "lows", "highs"])


def _rows(docs: DataFrame) -> DataFrame:
    """Rows by id and by a hash of their text: rows that repeat an id are judged apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tx"), "text")


def _listed(df: DataFrame) -> DataFrame:
    """Per document the windows to look at: parallel lists of starts and sizes."""
    both = df.groupBy("doc_id", "tx").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))).alias("s"))
    return both.select("doc_id", "tx", F.col("s.start").alias("starts"), F.col("s.size").alias("sizes"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tx, lows, highs): word ranges to remove from each document that has any.

    A word goes if a window of 50 words over it starts in a document with a smaller id too.
    Rows without an id are neither compared nor cut. ``tx`` is a hash of the text.
    """
    session(docs.sparkSession)
    rows = _rows(docs).where("doc_id is not null and text is not null")
    hashed = rows.select("doc_id", "tx", word_hashes(F.col("text")).alias("h"))
    found = written(hashed.where(F.size("h") >= WINDOW).mapInArrow(
        _segments, "seed long, doc_id long, tx long, start int, size int, spelled long"), "segments")
    shared = written(found.groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("spelled").alias("lo"), F.max("spelled").alias("hi"))
                     .where("least < most").select("seed", "least", (F.col("lo") == F.col("hi")).alias("straight")), "shared")
    met = found.select("seed", "doc_id", "tx", "start", "size").join(shared, "seed").where("not straight or doc_id > least")
    met = written(met.select("doc_id", "tx", "start", "size", "straight"), "met")

    opened = written(_listed(met.where("not straight")), "opened")
    held = deflated(meeting(rows, opened, "doc_id", "tx"))
    places = inflated(held.join(opened, ["doc_id", "tx"])).select("doc_id", "tx", word_hashes(F.col("text")).alias("h"), "starts", "sizes")
    windows = written(places.mapInArrow(_windows, "h1 long, h2 int, doc_id long, tx long, place int"), "windows")
    first = written(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                    .where("least < most").select("h1", "h2", "least"), "first")
    again = windows.join(first, ["h1", "h2"]).where("doc_id > least").select("doc_id", "tx", F.col("place").alias("start"), F.lit(1).alias("size"))
    cut = met.where("straight").select("doc_id", "tx", "start", "size").union(again)
    return _listed(cut).mapInArrow(_ranges, "doc_id long, tx long, lows array<long>, highs array<long>")


def _strip(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, lows, highs in zip(*(batch.column(n).to_pylist() for n in ("text", "lows", "highs"))):
                w = read(text).split() if text else []  # bytes split at the six ASCII white-space bytes only
                total.append(len(w))
                if lows:
                    out, at = [], 0
                    for lo, hi in zip(lows, highs):
                        out += w[at:lo]
                        at = hi
                    w = out + w[at:]
                gone.append(total[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


_STRIPPED = "doc_id long, n_words long, n_removed long, kept_text string"


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of ``docs`` (doc_id, text; other columns are not read).

    Kept words are joined by one space. A null text has no words; a row with a null id keeps
    all of its words; rows that repeat an id do not make each other smaller, so they keep what no smaller id holds.
    """
    spans = written(repeated_spans(docs), "spans")
    rows = may_meet(_rows(docs), spans, "doc_id", "tx")
    cut = deflated(rows.where("meets").drop("meets")).join(spans, ["doc_id", "tx"], "left").select("doc_id", "text", "lows", "highs")
    none = F.lit(None).cast("array<long>")
    whole = rows.where("not meets").select("doc_id", "text", none.alias("lows"), none.alias("highs"))
    return cut.mapInArrow(_strip(zlib.decompress), _STRIPPED).union(whole.mapInArrow(_strip(str.encode), _STRIPPED))
