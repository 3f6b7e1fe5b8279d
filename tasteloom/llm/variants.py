"""Spelling variants by a trie of letter counts.

A word is filed by how often it holds successive groups of letters: seven groups that split the
alphabet, then the letters one by one. Words that differ by one inserted letter have counts that
differ by a surplus of one; replaced letters make a surplus of one and a deficit of one. The trie
is searched depth first with a budget of one of each, and the words at the leaves that the search
reaches are verified letter by letter. A pair is looked up from one side only: from the shorter
word, or from the word that lacks the earlier letter of the order, so that a surplus is always
spent before a deficit.

Spark holds the upper trie: nodes are split by the next count until none has more than ``NODE``
words, or the levels end. Every word is sent to the nodes within its budget, and each node
is searched by one task with a trie of its own over single letters, blocks of queries at a time.
What reaches the driver is one row per child of a split node, at most a few ten thousand
whatever the vocabulary, as ``NODE`` grows with it beyond ``SPLITS`` * ``NODE`` words.

Defined results: a null text has no words, a null id is hashed as the empty text. Rows that repeat
an id or a text count again. Empty tables give no rows; further columns are not read. Words have
any length: counts are kept modulo 256, where a surplus or deficit of one still shows, and words
beyond ``WIDE`` letters are verified one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import session, written

LEAST, AT_LEAST, RATIO, EVERY = 7, 2, 10, 31
#: Words of a node that one task searches, and the number of nodes beyond which it grows.
NODE, SPLITS = 8_192, 20_000
#: Words that end a branch of a task's trie: to verify them is cheaper than to go on.
FEW = 4
#: Words that a task counts before it hands its counts on; letters of a word that is compared with others at once; queries, branches and pairs of a block.
HELD, WIDE, QUERIES, BLOCK, PAIRS = 400_000, 32, 8_192, 200_000, 400_000

#: The order of letters, frequent ones first, and the first letter of each group after the first.
ALPHABET = "etaoinsrhldcumfpgwybvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
GROUPS = "tonrlm"
LEVEL = np.full(256, 255, np.uint8)
LEVEL[np.frombuffer(ALPHABET.encode("latin-1"), np.uint8)] = np.arange(len(ALPHABET))
GROUP_STARTS = np.array([0, *[ALPHABET.index(c) for c in GROUPS]])
LETTERS = 26
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of every whole text with their letters deleted by rule, counted over all rows."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out():
            rows = pa.record_batch({"word": pa.array(list(total.keys()), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return rows

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))
            for row, doc_id in enumerate(ids):
                runs = RUN.findall(texts[row].as_py() or "")
                total.update(runs)
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run in set(runs):
                    h = zlib.crc32(run.encode(), head)
                    if h % EVERY == 0:
                        at, n = h % len(run), runs.count(run)
                        total[run] -= n
                        if len(run) > LEAST:
                            total[run[:at] + run[at + 1:]] += n
                if len(total) >= HELD:
                    yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= AT_LEAST)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts, modulo 256, of every letter of the alphabet, in its order."""
    sizes = np.array([len(w) for w in words])
    rows = np.repeat(np.arange(len(words)), sizes)
    letters = LEVEL[np.frombuffer(b"".join(words), np.uint8)]
    width = len(ALPHABET)
    out = np.empty((len(words), width), np.uint8)
    step = 1 << 14
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, len(words), step):
        hi = min(lo + step, len(words))
        part = slice(ends[lo], ends[hi])
        flat = np.bincount((rows[part] - lo) * width + letters[part], minlength=(hi - lo) * width)
        out[lo:hi] = flat.reshape(-1, width)
    return out


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of the letter groups, then of the first letters one by one."""
    counts = letter_counts(words)
    return np.hstack([np.add.reduceat(counts, GROUP_STARTS, axis=1, dtype=np.uint8), counts[:, :LETTERS]])


def visits(vector: bytes, children: dict[bytes, bool]) -> list[bytes]:
    """Unsplit nodes that a word may find a partner in, depth first. ``children`` says of each node whether it is split.

    A state is 0 with nothing spent, 1 after a surplus, 2 after a surplus and a later deficit; groups
    and single letters are two such budgets.
    """
    found, stack = [], [(b"", 0)]
    while stack:
        node, state = stack.pop()
        if not children.get(node, False):
            found.append(node)
            continue
        level = len(node)
        if level == len(GROUP_STARTS):
            state = 0
        count = vector[level]
        options = [(count, state)]
        if state == 0:
            options.append(((count + 1) % 256, 1))
        elif state == 1:
            options.append(((count - 1) % 256, 2))
        for value, then in options:
            child = node + bytes([value])
            if child in children:
                stack.append((child, then))
    return found


def split_nodes(vocabulary: DataFrame, size: int) -> dict[bytes, bool]:
    """Children of every split node, and whether they are split themselves; level by level from the root."""
    levels = len(GROUP_STARTS) + LETTERS
    counts = written(vocabulary.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "vectors")
    open_nodes, children = [b""], {b"": True}
    for level in range(1, levels + 1):
        spark = vocabulary.sparkSession
        parents = spark.createDataFrame([(bytearray(p),) for p in open_nodes], "node binary")
        here = counts.withColumn("node", F.expr(f"substring(vector, 1, {level - 1})")).join(F.broadcast(parents), "node", "left_semi")
        rows = here.groupBy(F.expr(f"substring(vector, 1, {level})").alias("node")).agg(F.sum("n").alias("n")).collect()
        open_nodes = [bytes(r.node) for r in rows if r.n > size and level < levels]
        children |= {bytes(r.node): r.n > size and level < levels for r in rows}
        if not open_nodes:
            break
    return children


class Trie:
    """Sorted count vectors as nodes by level: a child is found by its parent's number and its count."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        new, parent = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        new[0] = True
        self.keys, self.first = [], []
        for column in rows.T:
            new[1:] |= column[1:] != column[:-1]
            self.keys.append((parent << 8 | column)[new])
            self.first.append(np.append(np.flatnonzero(new), len(rows)))
            parent = np.cumsum(new) - 1

    def children(self, level: int, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``nodes`` have a child with that count, those children)."""
        wanted, keys = nodes << 8 | counts, self.keys[level]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        has = np.flatnonzero(keys[at] == wanted)
        return has, at[has]

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, first rows, end rows) of the leaves that the budget leads to; a node of few words is a leaf."""
        levels = len(self.keys)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int8))]
        while stack:
            level, who, nodes, state = stack.pop()
            if level:
                first, end = self.first[level - 1][nodes], self.first[level - 1][nodes + 1]
                # with nothing spent at the end, the letters are the same in another order
                leaf = state > 0 if level == levels else end - first <= FEW
                yield who[leaf], first[leaf], end[leaf]
                if level == levels:
                    continue
                who, nodes, state = who[~leaf], nodes[~leaf], state[~leaf]
            counts = queries[who, level].astype(np.int64)
            parts = []
            for change, then, may in ((0, state, None), (1, 1, state == 0), (-1, 2, state == 1)):
                pick = slice(None) if may is None else np.flatnonzero(may)
                has, found = self.children(level, nodes[pick], counts[pick] + change & 255)
                parts.append((who[pick][has], found, state[has] if may is None else np.full(len(has), then, np.int8)))
            who, nodes, state = (np.concatenate(x) for x in zip(*parts))
            for lo in range(0, len(who), BLOCK):
                stack.append((level + 1, who[lo:lo + BLOCK], nodes[lo:lo + BLOCK], state[lo:lo + BLOCK]))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether ``b`` is ``a`` with one letter inserted or replaced."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:] if len(b) > len(a) else at < len(a) and a[at + 1:] == b[at + 1:]


class Letters:
    """Words as a matrix of letters, for comparing many pairs at once; longer words are compared one by one."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words])
        self.long = self.size > WIDE
        # one column more than a word has: an inserted letter shifts the rest
        self.matrix = np.array([w[:WIDE] for w in words], f"S{WIDE + 1}").view(np.uint8).reshape(len(words), WIDE + 1)

    def near(self, a: np.ndarray, b: np.ndarray, inserted: bool) -> np.ndarray:
        """Which pairs (a, b) are one inserted, or one replaced, letter apart."""
        out = np.zeros(len(a), bool)
        slow = np.flatnonzero(self.long[a] | self.long[b])
        for i in slow:
            out[i] = one_apart(self.words[a[i]], self.words[b[i]])
        fast = np.flatnonzero(~(self.long[a] | self.long[b]))
        x, y = self.matrix[a[fast]], self.matrix[b[fast]]
        differ = x != y
        if inserted:
            # equal up to the first difference, and from there on with the longer word one letter ahead
            lead = differ.argmax(axis=1)
            shifted = x[:, :-1] != y[:, 1:]
            last = WIDE - shifted[:, ::-1].argmax(axis=1)
            out[fast] = ~shifted.any(axis=1) | (last <= lead)
        else:
            out[fast] = differ.sum(axis=1, dtype=np.uint8) == 1
        return out

    def looked_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a pair with one replaced letter is looked up from ``a``: its letter comes later in the order."""
        out = np.zeros(len(a), bool)
        for i in np.flatnonzero(self.long[a]):
            x, y = next((x, y) for x, y in zip(self.words[a[i]], self.words[b[i]]) if x != y)
            out[i] = LEVEL[y] < LEVEL[x]
        fast = np.flatnonzero(~self.long[a])
        x, y = self.matrix[a[fast]], self.matrix[b[fast]]
        at = (x != y).argmax(axis=1)[:, None]
        out[fast] = (LEVEL[np.take_along_axis(y, at, 1)] < LEVEL[np.take_along_axis(x, at, 1)])[:, 0]
        return out

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are near, each from the one side that it is looked up from."""
        more = self.size[b] - self.size[a]
        longer, same = more == 1, more == 0
        a1, b1, a0, b0 = a[longer], b[longer], a[same], b[same]
        hit1, hit0 = self.near(a1, b1, True), self.near(a0, b0, False)
        a0, b0 = a0[hit0], b0[hit0]
        own = self.looked_up(a0, b0)
        return np.concatenate([a1[hit1], a0[own]]), np.concatenate([b1[hit1], b0[own]])


def verify_all(verify: Callable, held: list[tuple]) -> None:
    """``verify`` the leaves gathered so far, some ``PAIRS`` pairs at a time; a leaf of more is met row by row of queries."""
    who, first, end = (np.concatenate(x) for x in zip(*held)) if held else ([], [], [])
    ends, done = np.cumsum(np.subtract(end, first)), 0
    while done < len(who):
        upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")), done + 1)
        verify(who[done:upto], first[done:upto], end[done:upto])
        done = upto


def near_in_node(table: pa.Table) -> pa.Table:
    """(word, n_near, near_n, near) found in one node: pairs seen from both words, the best partner of each."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n = table.column("n").to_numpy()
    home = np.flatnonzero(table.column("home").to_numpy())
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near_n": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
    if not len(home):
        return empty
    counts = letter_counts(words)
    counts = np.ascontiguousarray(counts[:, counts.any(axis=0)])
    trie, letters = Trie(counts[home]), Letters(words)
    # place of every word among all by count and code point, so that the best partner is the least place
    place_of = np.empty(len(words), np.int64)
    by_place = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    place_of[by_place] = np.arange(len(words))
    found, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def verify(who, first, end):
        size = end - first
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b = letters.found(np.repeat(who, size), home[trie.order[np.repeat(first, size) + inside]])
        for one, other in ((a, b), (b, a)):
            np.add.at(found, one, 1)
            np.minimum.at(best, one, place_of[other])

    for lo in range(0, len(words), QUERIES):
        held, pairs = [], 0
        for who, first, end in trie.search(counts[lo:lo + QUERIES]):
            held.append((who + lo, first, end))
            pairs += int((end - first).sum())
            if pairs >= PAIRS:
                verify_all(verify, held)
                held, pairs = [], 0
        verify_all(verify, held)
    hit = np.flatnonzero(found)
    if not len(hit):
        return empty
    partner = by_place[best[hit]]
    names = table.column("word")
    return pa.table({"word": names.take(pa.array(hit)).combine_chunks(), "n_near": pa.array(found[hit]), "near_n": pa.array(n[partner]),
                     "near": names.take(pa.array(partner)).combine_chunks()})


def near_words(vocabulary: DataFrame, node: int = NODE) -> DataFrame:
    """(word, n_near, near_n, near): number of near words, and the one of largest n; words without any are absent."""
    spark = vocabulary.sparkSession

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
                yield pa.record_batch({"word": batch.column(0), "n": batch.column(1), "vector": pa.array([r.tobytes() for r in rows], pa.binary())})

    words = written(vocabulary.mapInArrow(filed, "word string, n long, vector binary"), "vocabulary")
    total = words.count()
    children = split_nodes(words, max(node, total // SPLITS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[list[bytes], bytes]] = {}
        depth = max(map(len, children))
        for batch in batches:
            rows, nodes, home = [], [], []
            for i, vector in enumerate(batch.column(2).to_pylist()):
                key = vector[:depth]
                if key not in known:
                    own = next(key[:k] for k in range(depth + 1) if not children.get(key[:k], False))
                    known[key] = visits(key, children), own
                to, own = known[key]
                rows += [i] * len(to)
                nodes += to
                home += [t == own for t in to]
            at = pa.array(rows, pa.int64())
            yield pa.record_batch({"node": pa.array(nodes, pa.binary()), "word": batch.column(0).take(at), "n": batch.column(1).take(at), "home": pa.array(home, pa.bool_())})
            if len(known) > HELD:
                known.clear()

    there = words.mapInArrow(sent, "node binary, word string, n long, home boolean")
    parts = there.groupBy("node").applyInArrow(near_in_node, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    joined = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return joined.select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last; ``steps`` bounds a chain's length."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(math.ceil(math.log2(steps)), 0) if steps else 0):
        now = written(now, "roots")
        further = now.select(F.col("word").alias("by"), F.col("root").alias("further"))
        now = now.join(further, F.col("root") == F.col("by"), "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(docs: DataFrame, node: int = NODE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs twice."""
    session(docs.sparkSession)
    words = written(counted(docs), "words")
    near = near_words(words, node)
    rows = words.join(near, "word", "left")
    has = F.coalesce(F.col("near_n") >= RATIO * F.col("n"), F.lit(False))
    rows = written(rows.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                               F.when(has, F.col("near_n")).alias("form_n")), "forms")
    # every step multiplies n by ten at least
    most = rows.agg(F.max("n")).first()[0]
    steps = int(math.log10(most / AT_LEAST)) + 1 if most else 0
    last = roots(rows.where("form is not null").select("word", "form"), steps)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
