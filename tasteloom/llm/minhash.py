"""Near-duplicate documents: MinHash signatures, inverted lists per signature coordinate, counted collisions.

A document's distinct five-word shingles give a signature of ``COORDINATES`` minima. Every
(coordinate, value) has a posting list. Two documents are candidates when at least ``MATCHES``
coordinates collide. With M = ``MATCHES``, values held by one document are dropped, the rest
is ordered from rare to frequent, and of s values only the first s - M + 1 are merged: two
documents that share M values share one of these (prefix), and the M - 1 longest lists are
never merged (skip). Candidates must also collide in 78 of 128 coordinates, the others being
compared but not posted. A pair at similarity 0.75 passes both with probability over 0.9998, and
a more similar one sooner. Every link is confirmed on the whole shingle sets.

Equal sets are one class, however many documents hold them. A short list gives its pairs. A
long list is linked through two pivots first, its likely centre and an arbitrary member, in work
linear in its length; where its members
still lie in different components, those outside the largest one are compared with blocks of
the list. Sets are looked at only for each document's best partner and then for pairs of
different components, so a group of copies is never expanded into its pairs. What is left of a
list then is compared set by set inside its blocks: sets go once to each block that needs them,
pairs are never rows, and of the links found only a spanning forest leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import components, each_row, joined, list_column, lower_ascii, meeting, mixed, rolling, session, word_hashes, written

SHINGLE = 5
SIMILARITY = 75  # percent
COORDINATES, MATCHES = 48, 24  # posted minima, and collisions asked of them
ALL, ALL_MATCHES = 128, 78  # with further minima that are compared but not posted
SHORT_LIST = 8
BLOCK, BLOCK_SHINGLES = 1024, 512  # nodes of a block, one counted for each so many shingles of its set
_RNG = np.random.default_rng(20240131)
_A = _RNG.integers(0, 2**64, ALL, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, ALL, dtype=np.uint64)

_SIGNED = "doc_id long, n_shingles long, node binary, sig array<int>, tail array<smallint>"


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than five words are one shingle, none give none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes, min(n, SHINGLE)) + np.uint64(min(n, SHINGLE)))


def set_key(s: np.ndarray) -> bytes:
    """128 bits that depend on the set only."""
    one = mixed(s).sum(dtype=np.uint64)
    two = mixed(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(ALL, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i:i + 1024, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.uint32)
    for cols, rows in each_row(batches, "h"):
        sets = [shingle_set(r) for r in rows]
        least = [signature(s) if len(s) else none for s in sets]
        yield pa.RecordBatch.from_arrays([
            cols["doc_id"],
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
            list_column([x[:COORDINATES].view(np.int32) for x in least], pa.int32()),
            list_column([x[COORDINATES:].astype(np.uint16).view(np.int16) for x in least], pa.int16()),
        ], ["doc_id", "n_shingles", "node", "sig", "tail"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols, rows in each_row(batches, "h"):
        sets = [shingle_set(r) for r in rows]
        keys = [set_key(s) if len(s) else None for s in sets]
        mine = [i for i, (k, want) in enumerate(zip(keys, cols["node"].to_pylist())) if k == want]
        if mine:
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in mine], pa.binary()), list_column([sets[i].view(np.int64) for i in mine], pa.int64()),
            ], ["node", "shingles"])


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(lower_ascii(F.col("text"))).alias("h"))


def _equal(one: str, two: str) -> Column:
    return F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with enough equal coordinates, their number m, and sizes that can reach the similarity."""
    end = lambda n: classes.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("sig").alias(f"s{n}"), F.col("tail").alias(f"t{n}"))
    met = pairs.join(meeting(end("a"), pairs, "a"), "a").join(meeting(end("b"), pairs, "b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY)
    met = met.select("a", "b", "ta", "tb", _equal("sa", "sb").alias("m")).where(F.col("m") >= MATCHES)
    return met.select("a", "b", (F.col("m") + _equal("ta", "tb")).alias("m")).where(F.col("m") >= ALL_MATCHES)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(meeting(one, pairs, "a"), "a").join(meeting(two, pairs, "b"), "b")
            .where(both * 100 >= (F.size("sa") + F.size("sb") - both) * SIMILARITY).select("a", "b"))


def _collisions(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Seekers and members of a block, and by place the pairs of different components with enough collisions, with their number.

    A pair meets in every list that it shares; it counts in the first of them in the global
    order only, which the prefixes of both hold.
    """
    left, right = pdf[pdf["seeker"]], pdf[~pdf["seeker"]]
    if left.empty or right.empty:
        return left, right, *np.empty((3, 0), np.int64)
    here = int(pdf["pos"].iloc[0])
    stack = lambda side, name: np.stack(side[name].to_numpy())
    ls, rs = stack(left, "sig"), stack(right, "sig")
    codes = pd.factorize(pd.concat([left["label"], right["label"]]))[0]
    equal = np.zeros((len(left), len(right)), np.int16)
    for c in range(COORDINATES):
        equal += ls[:, c, None] == rs[None, :, c]
    equal[codes[:len(left), None] == codes[None, len(left):]] = 0
    x, y = np.nonzero(equal >= MATCHES)
    lt, rt, rank = stack(left, "tail"), stack(right, "tail"), stack(left, "often").astype(np.int64) * COORDINATES + np.arange(COORDINATES)
    kept = []
    for i in range(0, len(x), 50_000):
        u, v = x[i:i + 50_000], y[i:i + 50_000]
        m = equal[u, v] + (lt[u] == rt[v]).sum(axis=1)
        first = np.where(ls[u] == rs[v], rank[u], np.iinfo(np.int64).max).argmin(axis=1)
        ok = (m >= ALL_MATCHES) & (first == here)
        kept.append(np.stack([u[ok], v[ok], m[ok]]))
    return left, right, *(np.concatenate(kept, axis=1) if kept else np.empty((3, 0), np.int64))


def _seek(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each seeker of a block with its best partner there."""
    left, right, x, y, m = _collisions(pdf)
    order = np.lexsort((-m, x))
    x, y = x[order], y[order]
    top = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)
    return pd.DataFrame({"a": left["node"].to_numpy()[x[top]], "b": right["node"].to_numpy()[y[top]]})


def _present(pdf: pd.DataFrame) -> pd.DataFrame:
    """The seekers and members of a block that are in any pair there."""
    left, right, x, y, _ = _collisions(pdf)
    return pd.concat([left.iloc[np.unique(x)], right.iloc[np.unique(y)]])[["pos", "value", "i", "j", "seeker", "node", "label"]]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of a block: seekers against members by their whole sets, as many links as join what they can."""
    left, right = pdf[pdf["seeker"]], pdf[~pdf["seeker"]]
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []})
    codes = pd.factorize(pd.concat([left["label"], right["label"]]))[0]
    known, sought = codes[len(left):], codes[:len(left)]
    sizes = right["shingles"].map(len).to_numpy()
    flat, starts = np.concatenate(right["shingles"].to_numpy()), np.cumsum(sizes) - sizes
    order = np.argsort(flat, kind="stable")
    ordered, of = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
    out = []
    for k, mine in enumerate(left["shingles"]):
        low, high = np.searchsorted(ordered, mine), np.searchsorted(ordered, mine, side="right")
        n = high - low
        ends = np.cumsum(n)
        both = np.bincount(of[np.repeat(low - (ends - n), n) + np.arange(ends[-1])], minlength=len(right))
        hit = np.flatnonzero((both * 100 >= (len(mine) + sizes - both) * SIMILARITY) & (known != sought[k]))
        labels, at = np.unique(known[hit], return_index=True)
        out += [(k, int(hit[i])) for i in at]
        known[np.isin(known, labels)] = sought[k]
        sought[np.isin(sought, labels)] = sought[k]
    x, y = np.array(out, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": left["node"].to_numpy()[x], "b": right["node"].to_numpy()[y]})


def _across(hot: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, best: bool) -> DataFrame | None:
    """Links between components that meet in a long list; None if no list holds two components.

    Only members outside the list's largest component seek partners, in all blocks of the list. With ``best``, each tries
    its best partner of a block, else all that it collides with enough. A block is bounded by its nodes and their shingles.
    """
    weighed = hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = written(weighed.join(meeting(classes.select("node", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("weight")), hot, "node"), "node"), "held")
    sizes = held.groupBy("pos", "value", "label").agg(F.sum("weight").alias("n"))
    still = written(sizes.groupBy("pos", "value").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"),
                                                      (F.sum("n") - F.max("n")).alias("seekers")).where("seekers > 0"), "still")
    if still.isEmpty():
        return None
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    key = ["pos", "value", "i", "j"]
    split = held.join(still, ["pos", "value"])
    rows = split.join(meeting(classes.select("node", "sig", "tail"), split, "node"), "node")
    targets = rows.select("*", F.lit(False).alias("seeker"), part("members").alias("j"), F.explode(F.sequence(F.lit(0), parts("seekers") - 1)).alias("i"))
    seekers = rows.where("label <> main").select("*", F.lit(True).alias("seeker"), part("seekers").alias("i"),
                                                 F.explode(F.sequence(F.lit(0), parts("members") - 1)).alias("j"))
    met = targets.union(seekers.select(targets.columns)).select(*key, "seeker", "node", "label", "sig", "tail", "often")
    if best:
        pairs = met.groupBy(*key).applyInPandas(_seek, "a binary, b binary")
        return _confirmed(written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across"), sets)
    present = written(met.groupBy(*key).applyInPandas(_present, "pos int, value int, i int, j int, seeker boolean, node binary, label binary"), "present")
    found = present.join(meeting(sets, present, "node"), "node").groupBy(*key).applyInPandas(_compare, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """For every node its pair with most collisions."""
    ends = pairs.select("a", "b", "m", F.explode(F.array("a", "b")).alias("x"))
    top = ends.groupBy("x").agg(F.max(F.struct("m", "a", "b")).alias("t"))
    return top.select("t.a", "t.b").distinct()


def _split(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet known to lie in one component."""
    end = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}"))
    return pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where("la is null or lb is null or la <> lb").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; other columns are not read).

    Null or empty texts and texts without words have no shingles and no links; their component is
    their own id. A row with a null id can be linked, but gives no component its name; alone, it
    has a null component and is kept. Rows that repeat an id are judged each by its own text. An
    empty table gives an empty result.
    """
    session(docs.sparkSession)
    signed = written(_hashed(docs).mapInArrow(_sign, _SIGNED), "signed")
    classes = written(signed.where("node is not null").groupBy("node")
                      .agg(F.min("doc_id").alias("min_doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("tail").alias("tail")), "classes")
    posts = classes.select("node", F.posexplode("sig").alias("pos", "value"))
    posts = posts.withColumn("often", F.count("*").over(Window.partitionBy("pos", "value"))).where("often > 1")  # one shuffle counts and keeps
    held = (posts.groupBy("node").agg(F.collect_list(F.struct("often", "pos", "value")).alias("p"))
            .where(F.size("p") >= MATCHES))
    # how often each coordinate's value is posted, 0 if once; a group's centre holds its most frequent values
    by_pos = F.map_from_arrays("p.pos", "p.often")
    often = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.coalesce(F.try_element_at(by_pos, i), F.lit(0).cast("long")).cast("int"))
    prefix = F.slice(F.sort_array("p"), F.lit(1), F.size("p") - (MATCHES - 1))
    lists = held.select("node", often.alias("all_often"), prefix.alias("prefix")).withColumn(
        "centre", F.aggregate("all_often", F.lit(0).cast("long"), lambda t, x: t + x))
    lists = written(lists.select("node", "all_often", "centre", F.inline("prefix")), "lists")

    short = lists.where(F.col("often") <= SHORT_LIST)
    pairs = (short.select("pos", "value", F.col("node").alias("a")).join(short.select("pos", "value", F.col("node").alias("b")), ["pos", "value"])
             .where("a < b").select("a", "b"))
    hot = lists.where(F.col("often") > SHORT_LIST).select("pos", "value", "node", "centre", F.col("all_often").alias("often"))
    pivots = written(hot.groupBy("pos", "value").agg(F.max(F.struct("centre", "node"))["node"].alias("p1"),
                                                     F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("p2")), "pivots")
    near = hot.join(pivots, ["pos", "value"]).select("node", F.explode(F.array("p1", "p2")).alias("p")).where("node <> p")
    pairs = pairs.union(near.select(F.least("node", "p"), F.greatest("node", "p"))).distinct()
    pairs = written(_candidates(pairs, classes), "candidates")

    # the whole sets of all that may have to be compared
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hot.select("node")).distinct()
    wanted = written(wanted.join(classes, "node").where("min_doc is not null").select("node", F.col("min_doc").alias("doc_id")), "wanted")
    texts = meeting(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id").join(wanted, "doc_id")
    texts = texts.select(word_hashes(lower_ascii(F.col("text"))).alias("h"), "node")
    sets = texts.mapInArrow(_sets, "node binary, shingles array<long>")
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated ids: one set for each class
        sets = sets.dropDuplicates(["node"])
    sets = written(sets, "sets")
    # a chain of best partners first: pairs inside a component need no look at their sets
    labels = components(_confirmed(written(_best(pairs), "best"), sets))
    labels = joined(labels, _confirmed(written(_split(pairs, labels), "split"), sets))
    for best in (True, False):
        more = _across(hot, classes, labels, sets, best)
        if more is None:
            break
        labels = joined(labels, more)

    linked = written(labels.join(classes.select("node", "min_doc"), "node"), "linked")
    least = linked.groupBy("label").agg(F.min("min_doc").alias("least"))
    named = linked.join(least, "label").select("node", "least")
    named = written(classes.select("node", "min_doc").join(named, "node", "left")
                    .select("node", F.coalesce("least", "min_doc").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
