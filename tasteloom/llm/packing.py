"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Every source is a queue with a token share (by default its share of all tokens). A round is one
window. It gives a queue ``share * WINDOW`` tokens of credit, the queue serves the whole tokens
that its credit covers, and what is left of it, the deficit, is carried to the next window. After r
rounds queue j has served ``floor(r * C[j]) - floor(r * C[j - 1])`` tokens, where C adds up the
credits in queue order: within one token of its share, and all queues together fill exactly r
windows. So the place of every token has a closed form in the queues' totals, whatever partition
it lies in, and no round is walked through. When a queue is empty the others move up, and the
windows that follow hold the shares of what is left.

Two kinds of sources have no queue of their own, which keeps the table of queues below
``WINDOW / LEAST`` rows: those with a target under ``LEAST`` tokens a window share one, in the order
of the input, and those with a target of 0 follow at the end of the stream, as every id has to
lie in a window.

Token ids are made once and written. Text is encoded by distinct units, cut where a byte-level
vocabulary always has a pre-token border: before a space that a non-space follows, between a letter
or digit and ASCII punctuation, and on both sides of a line end between two visible characters. So
the ids of the units, joined, are the ids of the text. Texts that hold an added token of the
vocabulary are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import session, written

WINDOW = 1024
LEAST = 4  # tokens a window of a source with a queue of its own
ROUNDS_AT_ONCE = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
CACHED_UNITS = 400_000  # distinct units a task remembers; beyond it starts anew
JOINED_UNITS = 256  # new units encoded as one text

# classes of bytes, as bits: the first byte of a character that surely is no white space; ASCII letter or digit; ASCII
# punctuation; second byte, after C3, of a letter from U+00C0 to U+00FF (two of these characters are signs)
_STARTS, _ALNUM, _PUNCTUATION, _SECOND = 1, 2, 4, 8
_CLASSES = bytes(
    _STARTS * (0x21 <= b < 0x7F or 0xC3 <= b < 0xE0) | _ALNUM * (b < 0x80 and chr(b).isalnum()) | _PUNCTUATION * (0x21 <= b < 0x7F and not chr(b).isalnum())
    | _SECOND * (0x80 <= b < 0xC0 and b not in (0x97, 0xB7)) for b in range(256))
#: A leading space at most, and then no white space of any script.
_NO_INNER_SPACE = (r"^ ?[!-~\x{00C0}-\x{167F}\x{1681}-\x{1FFF}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]+$")


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts, and the number of the first unit of each text (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)[:offsets[-1]]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        kind = np.frombuffer(raw.tobytes().translate(_CLASSES), np.uint8)
        starts, punctuation = (kind & _STARTS) > 0, (kind & _PUNCTUATION) > 0
        visible, ends = (kind & (_ALNUM | _PUNCTUATION)) > 0, (kind & _ALNUM) > 0
        cut[:len(raw) - 1] = (raw[:-1] == 0x20) & starts[1:]
        ends[1:] |= (raw[:-1] == 0xC3) & ((kind[1:] & _SECOND) > 0)
        cut[1:len(raw)] |= ends[:-1] & punctuation[1:]
        line = visible[:-2] & (raw[1:-1] == 0x0A) & starts[2:]
        cut[1:len(raw) - 1] |= line
        cut[2:len(raw)] |= line
    cut[:offsets[0]] = False
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[filled] = True
    cut[offsets[-1]] = True
    at = np.nonzero(cut)[0].astype(np.int32)
    first = np.searchsorted(at, offsets)
    if len(at) == 1:
        return pa.array([], pa.string()), first
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data), first


class Encoder:
    """Ids of texts through ids of distinct units; the tokenizer is loaded once for each Python worker.

    New units without inner white space are encoded many at once, joined by line ends: a line end after a non-space
    is a pre-token of its own, so its id marks where each unit's ids end. If the marks do not add
    up, or the line end has not one id, units are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        mark = self._coded(["\n"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.flat, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, unit_list: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.number)
        self.number.update(zip(unit_list, range(at, at + len(unit_list))))
        self.parts.append(ids)
        self.sizes.append(sizes)

    def _learn(self, new: list[str]) -> None:
        joins = pc.match_substring_regex(pa.array(new, pa.string()), _NO_INNER_SPACE).to_pylist() if self.mark is not None else [False] * len(new)
        plain, single = [u for u, j in zip(new, joins) if j], [u for u, j in zip(new, joins) if not j]
        groups = [plain[i:i + JOINED_UNITS] for i in range(0, len(plain), JOINED_UNITS)]
        for i in range(0, len(groups), 64):
            for group, ids in zip(groups[i:i + 64], self._coded(["\n".join(g) for g in groups[i:i + 64]])):
                inside = ids != self.mark
                ends = np.append(np.flatnonzero(~inside), len(ids))
                if len(ends) == len(group):
                    self._keep(group, ids[inside], np.diff(ends, prepend=-1) - 1)
                else:
                    single += group
        for i in range(0, len(single), 4096):
            coded = self._coded(single[i:i + 4096])
            self._keep(single[i:i + 4096], np.concatenate(coded), np.array([len(x) for x in coded], np.int64))
        self.flat, self.size = np.concatenate([self.flat, *self.parts]), np.concatenate([self.size, *self.sizes])
        self.parts, self.sizes = [], []

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out = self._by_units(texts)
        at = np.flatnonzero(whole)
        for i in range(0, len(at), 64):
            for k, ids in zip(at[i:i + 64], self._coded([texts[int(k)].as_py() for k in at[i:i + 64]])):
                out[k] = ids
        return out

    def _by_units(self, texts: pa.Array) -> list[np.ndarray]:
        pieces, first = units(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if not distinct:
            return [np.empty(0, np.uint32)] * len(texts)
        if len(self.number) > CACHED_UNITS:
            self._forget()
        new = [u for u in distinct if u not in self.number]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        starts = np.cumsum(self.size) - self.size
        out = []
        for i, j in zip(first[:-1], first[1:]):
            w = which[i:j]
            n = self.size[w]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(starts[w] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_of = TaskContext.get().partitionId(), {}
        encode = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = encode(batch.column("text"))
            queues = batch.column("queue").to_pylist()
            sizes, before = [len(x) + 1 for x in ids], []
            for q, n in zip(queues, sizes):
                before.append(run_of.get(q, 0))
                run_of[q] = before[-1] + n
            narrow = max((int(x.max()) for x in ids if len(x)), default=0) < 1 << 16
            kind = "<u2" if narrow else "<u4"
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(queues, pa.string()), pa.array(np.full(len(ids), part), pa.int64()), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()),
                pa.array(np.full(len(ids), 2 if narrow else 4), pa.int32()),
                pa.array([np.append(x, END_ID).astype(kind).tobytes() for x in ids], pa.binary()),
            ], ["doc_id", "queue", "part", "doc_tokens", "before", "width", "ids"])

    return run


class Rounds:
    """Places in the stream of the tokens of bounded queues, from the tokens they hold and their credits."""

    def __init__(self, held: list[int], credits: list[float]):
        self.held = np.array(held, np.int64)
        self.upto = np.cumsum(np.array([0.0, *credits]))
        self.upto[1:] *= WINDOW / self.upto[-1] if len(credits) else 1
        self.upto[-1] = WINDOW if len(credits) else 0  # all queues together fill whole windows
        self.total = int(self.held.sum())
        #: rounds that no queue's end can touch
        self.full = int(min(((self.held - 1) / np.diff(self.upto)).min() - 2, 1 << 60)) if len(credits) else 0

    def _due(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Tokens that the queues up to one, itself left out, may have served before a round."""
        return np.floor(rounds * self.upto[queue]).astype(np.int64)

    def _ahead(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Place in the stream where a queue's turn of a round begins, whichever queues have ended."""
        out = np.empty(len(rounds), np.int64)
        for i in range(0, len(rounds), ROUNDS_AT_ONCE):
            r, q = rounds[i:i + ROUNDS_AT_ONCE], queue[i:i + ROUNDS_AT_ONCE]
            edges = [np.minimum(np.diff(np.floor(x[:, None] * self.upto), axis=1).astype(np.int64), self.held) for x in (r, r + 1)]
            before = np.arange(len(self.held)) < q[:, None]
            out[i:i + ROUNDS_AT_ONCE] = np.where(before, edges[1], edges[0]).sum(axis=1)
        return out

    def slices(self, queue: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, length, at) of the parts that rounds make of documents: ``size`` tokens from ``place`` of a queue."""
        credit = self.upto[queue + 1] - self.upto[queue]
        first = np.maximum(((place - 1) / credit).astype(np.int64) - 2, 0)
        n = ((place + size + 1) / credit).astype(np.int64) + 3 - first
        of = np.repeat(np.arange(len(n)), n)
        r = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n)).astype(np.float64)
        q = queue[of]
        below, above = (self._due(r, q), self._due(r + 1, q)), (self._due(r, q + 1), self._due(r + 1, q + 1))
        mine = above[0] - below[0]
        start, stop = np.maximum(mine, place[of]), np.minimum(above[1] - below[1], (place + size)[of])
        some = stop > start
        of, r, q, start, stop, mine = (x[some] for x in (of, r, q, start, stop, mine))
        # while no queue has ended, the turns of a round add up to differences of the credits so far
        ahead = r.astype(np.int64) * WINDOW + (below[1] - below[0])[some]
        late = np.flatnonzero(r >= self.full)
        ahead[late] = self._ahead(r[late], q[late])
        return of, start - place[of], stop - start, ahead + start - mine


def pieces(of: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slices of documents (in order), cut at the edges of windows and joined inside them."""
    lead = at % WINDOW
    n = (lead + length + WINDOW - 1) // WINDOW
    each = np.repeat(np.arange(len(start)), n)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    low = np.maximum(nth * WINDOW - lead[each], 0)
    high = np.minimum((nth + 1) * WINDOW - lead[each], length[each])
    of, start, length, at = of[each], start[each] + low, high - low, at[each] + low
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + length[:-1]) | (at[1:] % WINDOW == 0)
    first = np.flatnonzero(new)
    return of[first], start[first], np.add.reduceat(length, first) if len(first) else length, at[first]


def _cut(rounds: Rounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, place = (batch.column(n).to_numpy() for n in ("doc_tokens", "place"))
            ids = np.concatenate([np.frombuffer(raw.as_buffer(), f"<u{w}") for raw, w in zip(batch.column("ids"), batch.column("width").to_pylist())]).astype("<u4")
            number = batch.column("number").fill_null(-1).to_numpy().astype(np.int64)
            queued, late = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
            of, *slices = rounds.slices(number[queued], place[queued], size[queued])
            # a target of 0: after all queues
            of, start, length, at = (np.concatenate(x) for x in zip(
                (queued[of], *slices), (late, np.zeros(len(late), np.int64), size[late], rounds.total + place[late])))
            of, start, length, at = pieces(of, start, length, at)
            begin = ((np.cumsum(size) - size)[of] + start) * 4
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[i:j]) for i, j in zip(begin.tolist(), (begin + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *[pa.array(x, pa.int64()) for x in (start, length, sums, size[of], at // WINDOW, at % WINDOW)]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, weights: dict[str, float] | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, source, text).

    ``weights`` are target token shares by source, in any unit; sources not named, and all by
    default, weigh as many tokens as they hold. Every window holds each queue's share to a token,
    until the first queue is empty (by default all end together). A target of 0 puts a source
    behind all others; a negative or non-finite one is refused. A null text is the end id alone;
    a null source is a queue of its own; null and repeated ids are packed row by row; an empty
    table gives no pieces.
    """
    for name, w in (weights or {}).items():
        if not 0 <= w < float("inf"):
            raise ValueError(f"the target of {name} must be a finite share of 0 or more, not {w}")
    spark = session(docs.sparkSession)
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    coded = written(rows.mapInArrow(_encode(tokenizer_path or public_tokenizers.path(VOCABULARY)), (
        "doc_id long, queue string, part long, doc_tokens long, before long, width int, ids binary")), "encoded")

    parts = written(coded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens")), "parts")
    weight = F.col("held").cast("double")
    for name, w in (weights or {}).items():
        weight = F.when(F.col("queue") == f"={name}", F.lit(float(w))).otherwise(weight)
    sources = written(parts.groupBy("queue").agg(F.sum("tokens").alias("held")).withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("weight")).first()[0] or 1.0
    credit = F.col("weight") * (WINDOW / total)
    # the names of queues start with = or are null, so the shared ones cannot meet them
    group = F.when(F.col("weight") <= 0, "late").when(credit < LEAST, "pool").otherwise(F.col("queue"))
    sources = sources.select("queue", "held", credit.alias("credit"), group.alias("group"))
    served = sources.where(F.col("group") != "late").groupBy("group").agg(F.sum("held").alias("held"), F.sum("credit").alias("credit"))
    queues = sorted(served.collect(), key=lambda r: r.group)  # WINDOW / LEAST queues and the shared one at most
    rounds = Rounds([r.held for r in queues], [max(r.credit, LEAST) for r in queues])
    numbers = spark.createDataFrame([(r.group, i) for i, r in enumerate(queues)], "group string, number int")

    # tokens of a queue before each (source, part): first over parts, then over the sources inside a part
    grouped = parts.join(sources.select("queue", "group"), "queue")
    over = lambda *by: Window.partitionBy("group", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_part = grouped.groupBy("group", "part").agg(F.sum("tokens").alias("tokens"))
    by_part = by_part.select("group", "part", F.coalesce(F.sum("tokens").over(over("part")), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("tokens").over(over("part", "queue")), F.lit(0))
    base = grouped.withColumn("inside", inside).join(by_part, ["group", "part"]).join(F.broadcast(numbers), "group", "left")
    base = written(base.select("queue", "part", "number", (F.col("earlier") + F.col("inside")).alias("base")), "base")
    placed = coded.join(base, ["queue", "part"]).select("doc_id", "doc_tokens", "width", "ids", "number", (F.col("base") + F.col("before")).alias("place"))
    return placed.mapInArrow(
        _cut(rounds), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
