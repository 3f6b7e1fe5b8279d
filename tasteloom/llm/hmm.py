"""Language-model scores of a hidden Markov model trained by Baum-Welch.

Words are counted over all training documents. A frequent word is a class of its own, the others
share a class by their last letters: P(word) = P(class | state) P(word | class). A class of
endings keeps ``DISCOUNT`` of a count of each of its words for unseen ones, and deals it to as many
unseen words as it has seen (the mean class's number at least), so the shares of a class add up to
1. That number is a stated guess from training words alone, as the base reserves one unseen word
in all; a class with more unseen words than that would exceed 1. So the trained tables are bounded, while the word
counts grow with the corpus and are joined, never broadcast.

Texts are coded in chunks of many documents, deflated by planes of bytes, small codes for frequent words. The
distinct words of all chunks are shuffled by word once. A word of one chunk only is counted there
already; the counts of the others, and the classes of the most frequent, go back to their chunks,
which then hold class numbers, 2 bytes a token. Each Baum-Welch round reads all training
chunks and adds up expected counts by partition, then by key. The score is the exact likelihood
of the whole text by the scaled forward recursion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, session, written

FOLDS = 10
STATES, ROUNDS = 8, 4
TOP, ENDINGS = 4096, 2048  # classes of one word, and of words with equal last letters
CLASSES = 1 + TOP + ENDINGS  # class 0 is the end of a text
SEGMENT, SEQUENCES = 128, 1024  # tokens of a training sequence, and sequences learned from at once; scores take whole texts
CHUNK_WORDS, CHUNK_STEP = 750_000, 64  # a chunk ends at that many words, counted by as many documents
COUNT_BITS = 36  # of a code and a count, or a class, in one number: 2**27 distinct words of a chunk, 2**36 uses of a word
DISCOUNT = 0.5
ANCHORS = 64
_SMOOTH = 0.05

_CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, held array<boolean>, sizes array<int>, codes binary, words array<string>, uses array<long>"
_CODED = "doc_ids array<long>, train array<boolean>, held array<boolean>, sizes array<int>, known array<long>, base array<double>, within array<double>, classes binary"


def _by_use(codes: np.ndarray, dictionary: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and their dictionary in falling frequency."""
    order = np.argsort(-np.bincount(codes, minlength=len(dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[codes], dictionary.take(pa.array(order))


def _packed(codes: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents with a dictionary of their words."""
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk():
        t = pa.Table.from_batches(held)
        lists = pc.ascii_split_whitespace(t["text"].combine_chunks() if t["text"].num_chunks > 1 else t["text"].chunk(0))
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        full = pc.not_equal(flat, "")
        flat, parent = flat.filter(full), parent[full.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        codes, dictionary = _by_use(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)
        train = t["train"].to_numpy()
        uses = np.bincount(codes[train[parent]], minlength=len(dictionary)).astype(np.int64)
        one = lambda x, kind: pa.array([x], kind)
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 24) + made], pa.int64()), one(t["doc_id"].to_pylist(), pa.list_(pa.int64())), one(train.tolist(), pa.list_(pa.bool_())),
            one(t["held"].to_pylist(), pa.list_(pa.bool_())), one(np.bincount(parent, minlength=t.num_rows).tolist(), pa.list_(pa.int32())),
            pa.array([_packed(codes)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(dictionary)], pa.int32()), dictionary.cast(pa.string())),
            pa.ListArray.from_arrays(pa.array([0, len(uses)], pa.int32()), pa.array(uses))],
            ["chunk", "doc_ids", "train", "held", "sizes", "codes", "words", "uses"])

    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK_STEP):
            held.append(batch.slice(i, CHUNK_STEP))
            size += held[-1].column("text").nbytes // 6
            if size >= CHUNK_WORDS:
                yield chunk()
                made, held, size = made + 1, [], 0
                pa.default_memory_pool().release_unused()  # else a worker keeps what its largest chunk took
    if held:
        yield chunk()


def shares(cls: np.ndarray, count: np.ndarray, sums: np.ndarray, types: np.ndarray) -> np.ndarray:
    """P(word | class) of words with their class and training count, from the tokens and distinct words of every class."""
    reserve = np.maximum(types, max(1.0, np.ceil(types[1 + TOP:].mean())))
    kept = DISCOUNT * (np.arange(len(types)) > TOP)
    tokens = np.where(sums > 0, sums, 1.0)
    unseen = np.where(sums > 0, kept * types / tokens, 1.0) / reserve
    return np.where(count > 0, (count - kept[cls]) / tokens[cls], unseen[cls])


def _classify(total: int, distinct: int, sums: np.ndarray, types: np.ndarray, ends: int):
    """Chunks with class numbers in place of words, and what does not depend on states summed by document."""
    floor = np.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = lambda name: batch.column(name)[r].values.to_numpy().astype(np.int64)
                cls, count = own("endings"), own("uses")
                if batch.column("counts")[r].values is not None:
                    pair = own("counts")
                    count[pair >> COUNT_BITS] = pair & ((1 << COUNT_BITS) - 1)
                if batch.column("tops")[r].values is not None:
                    pair = own("tops")
                    cls[pair >> COUNT_BITS] = pair & ((1 << COUNT_BITS) - 1)
                codes = _unpacked(batch.column("codes")[r].as_py())
                sizes = batch.column("sizes")[r].values.to_numpy()
                of = np.repeat(np.arange(len(sizes)), sizes)
                seen = count > 0
                inner = np.log10(shares(cls, count, sums, types))
                add = lambda x: np.bincount(of, x[codes], len(sizes))
                base = add(np.log10(count + 0.1)) + np.log10(ends + 0.1) - (sizes + 1) * floor
                known = add(seen.astype(float)).astype(np.int64) + (ends > 0)
                classes = np.insert(cls[codes], np.cumsum(sizes), 0).astype("<u2")
                lists = [pa.array([x.tolist()], k) for x, k in ((known, pa.list_(pa.int64())), (base, pa.list_(pa.float64())), (add(inner), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(x).slice(r, 1) for x in ("doc_ids", "train", "held")], pa.array([(sizes + 1).tolist()], pa.list_(pa.int32())),
                    *lists, pa.array([classes.tobytes()], pa.binary())], ["doc_ids", "train", "held", "sizes", "known", "base", "within", "classes"])

    return run


def _steps(sizes: np.ndarray) -> list[int]:
    """Of sequences in falling length: how many reach each step."""
    return np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right").tolist()


def forward(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of every sequence: classes[start:start + size]."""
    order = np.argsort(-sizes, kind="stable")
    starts, out = starts[order], np.zeros(len(sizes))
    alpha = np.repeat(first[None, :], len(sizes), axis=0)
    for t, n in enumerate(_steps(sizes[order])):
        alpha = (alpha[:n] @ move if t else alpha[:n]) * emit[classes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[order[:n]] += np.log10(scale)
    return out


def expected(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected counts (first states, moves, emissions) and the log10 likelihood, by scaled forward and backward passes."""
    k = len(first)
    order = np.argsort(-sizes, kind="stable")
    starts, steps = starts[order], _steps(sizes[order])
    alphas, scales, alpha = [], [], np.repeat(first[None, :], len(sizes), axis=0)
    for t, n in enumerate(steps):
        alpha = (alpha[:n] @ move if t else alpha[:n]) * emit[classes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        alphas.append(alpha)
        scales.append(scale)
    moves, gammas, at = np.zeros((k, k)), [], []
    beta = np.ones((0, k))
    for t in range(len(steps) - 1, -1, -1):
        n = steps[t]
        if t + 1 < len(steps):
            m = steps[t + 1]
            ahead = emit[classes[starts[:m] + t + 1]] * beta / scales[t + 1][:, None]
            moves += move * (alphas[t][:m].T @ ahead)
            beta = np.concatenate([ahead @ move.T, np.ones((n - m, k))])
        else:
            beta = np.ones((n, k))
        gammas.append(alphas[t] * beta)
        at.append(classes[starts[:n] + t])
    gamma, at = np.concatenate(gammas), np.concatenate(at)
    emitted = np.stack([np.bincount(at, gamma[:, s], len(emit)) for s in range(k)], axis=1)
    return gammas[-1].sum(axis=0), moves, emitted, sum(np.log10(s).sum() for s in scales)


def _texts(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    classes = np.frombuffer(batch.column("classes")[r].as_buffer(), "<u2").astype(np.int64)
    sizes = batch.column("sizes")[r].values.to_numpy().astype(np.int64)
    return classes, np.cumsum(sizes) - sizes, sizes, batch.column("train")[r].values.to_numpy(zero_copy_only=False)


def _expect(first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1 + STATES, STATES))
        for batch in batches:
            for r in range(batch.num_rows):
                classes, starts, sizes, train = _texts(batch, r)
                pieces = -(-sizes[train] // SEGMENT)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(starts[train], pieces) + nth * SEGMENT
                size = np.minimum(SEGMENT, np.repeat(sizes[train], pieces) - nth * SEGMENT)
                for i in range(0, len(start), SEQUENCES):
                    one, two, three, _ = expected(classes, start[i:i + SEQUENCES], size[i:i + SEQUENCES], first, move, emit)
                    total[:CLASSES] += three
                    total[CLASSES] += one
                    total[CLASSES + 1:] += two
        at = np.nonzero(total.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, s]) for s in range(STATES)]], ["at", *[f"s{s}" for s in range(STATES)]])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training documents by pairs of the most frequent words that they hold."""
    total = np.zeros((ANCHORS, ANCHORS))
    for batch in batches:
        for r in range(batch.num_rows):
            classes, _, sizes, train = _texts(batch, r)
            of = np.repeat(np.arange(len(sizes)), sizes)
            hit = (classes >= 1) & (classes <= ANCHORS)
            holds = np.zeros((len(sizes), ANCHORS), np.float32)
            holds[of[hit], classes[hit] - 1] = 1
            total += holds[train].T @ holds[train]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ANCHORS)), pa.ListArray.from_arrays(pa.array(np.arange(ANCHORS + 1) * ANCHORS, pa.int32()), pa.array(total.ravel()))], ["i", "row"])


def _start(together: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First guess: states around frequent words that seldom share documents; states like to stay."""
    n = np.maximum(np.diag(together), 1e-9)
    apart = together / np.sqrt(n[:, None] * n[None, :])
    picked = [int(n.argmax())]
    while len(picked) < STATES:
        near = apart[picked].max(axis=0) + (n < n.max() / 200) * 2
        near[picked] = 9
        picked.append(int(near.argmin()))
    emit = np.repeat((counts + _SMOOTH)[:, None], STATES, axis=1)
    emit[1:ANCHORS + 1] *= (together[picked].T + 0.01 * n[:, None]) / n[:, None] * (1 + 0.1 * np.arange(STATES) / STATES)
    move = np.full((STATES, STATES), 0.05 / (STATES - 1))
    np.fill_diagonal(move, 0.95)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0)


def _score(total: int, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                classes, starts, sizes, _ = _texts(batch, r)
                value = lambda name: batch.column(name)[r].values
                scores = forward(classes, starts, sizes, first, move, emit) + value("within").to_numpy()
                yield pa.RecordBatch.from_arrays([
                    value("doc_ids"), value("held"), pa.array(sizes), value("known"), pa.array(np.full(len(sizes), total, np.int64)), value("base"), pa.array(scores)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _ending(word: Column) -> Column:
    """The class of a word that has none of its own."""
    return F.lit(1 + TOP) + F.pmod(F.xxhash64(F.right(word, F.lit(3))), F.lit(ENDINGS)).cast("int")


def _counted(chunks: DataFrame) -> DataFrame:
    """(word, chunk, code, c, n, head): every distinct word of every chunk, with its training count and its number of chunks
    over all chunks; ``head`` holds for one row of each word. One shuffle; a word has a row for each chunk at most."""
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "uses")).alias("code", "e")).select(F.col("e.words").alias("word"), "chunk", "code", F.col("e.uses").alias("uses"))
    by = Window.partitionBy("word").orderBy("chunk")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return entries.select("word", "chunk", "code", F.sum("uses").over(every).alias("c"), F.count("*").over(every).alias("n"), (F.row_number().over(by) == 1).alias("head"))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text).

    A null text is empty: its end is its one token. A row with a null id is neither held out nor
    learned from; repeated rows each count. Without training documents all words are unknown.
    """
    session(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce("text", F.lit(""))).alias("text"),
                       F.coalesce(fold != 0, F.lit(False)).alias("train"), F.coalesce(fold == 0, F.lit(False)).alias("held"))
    chunks = written(rows.mapInArrow(_code, _CHUNK), "chunks")
    places = written(_counted(chunks), "places")
    counts = places.where("head").select("word", "c")
    ends = rows.where("train").count()
    inside, distinct = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (inside or 0) + ends, distinct + (ends > 0)
    top = [r.word for r in counts.where("c > 0").orderBy(F.desc("c"), "word").limit(TOP).collect()]
    top = docs.sparkSession.createDataFrame([(w, i + 1) for i, w in enumerate(top)], "word string, own int")  # TOP rows at most
    known = places.join(F.broadcast(top), "word", "left").withColumn("cls", F.coalesce("own", _ending(F.col("word"))))
    sums, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in known.where("head and c > 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows at most
        sums[r.cls], types[r.cls] = r.c, r.n
    sums[0], types[0] = ends, 1

    pair = lambda n: F.when(F.col(n).isNotNull(), F.shiftleft(F.col("code").cast("long"), COUNT_BITS).bitwiseOR(F.col(n).cast("long")))
    many = known.where("n > 1 or own is not null").withColumn("c", F.expr("if(n > 1, c, null)"))
    met = many.groupBy("chunk").agg(F.collect_list(pair("c")).alias("counts"), F.collect_list(pair("own")).alias("tops"))
    ready = chunks.withColumn("endings", F.transform("words", lambda w: _ending(w).cast("short"))).drop("words").join(met, "chunk", "left")
    coded = written(ready.mapInArrow(_classify(total, distinct, sums, types, ends), _CODED), "coded")

    pairs = np.zeros((ANCHORS, ANCHORS))
    for r in coded.select("sizes", "train", "classes").mapInArrow(_together, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "n")).groupBy("i", "j").agg(
            F.sum("n").alias("n")).collect():
        pairs[r.i, r.j] = r.n
    first, move, emit = _start(pairs, sums)
    sums_of = [F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)]
    for _ in range(rounds):
        stats = np.zeros((CLASSES + 1 + STATES, STATES))
        found = coded.select("sizes", "train", "classes").mapInArrow(_expect(first, move, emit), "at long, " + ", ".join(f"s{s} double" for s in range(STATES)))
        for r in found.groupBy("at").agg(*sums_of).collect():  # a row for each class and state
            stats[r[0]] = r[1:]
        emit = stats[:CLASSES] + _SMOOTH * (sums[:, None] / max(1.0, sums.sum()) * 100 + 0.001)
        emit, first, move = emit / emit.sum(axis=0), stats[CLASSES] + 1e-3, stats[CLASSES + 1:] + 1e-3
        first, move = first / first.sum(), move / move.sum(axis=1, keepdims=True)
    return coded.mapInArrow(_score(total, first, move, emit), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
