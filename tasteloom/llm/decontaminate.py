"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

A document's windows of as many words as an item has are compared with the items of that length.
A window can reach the similarity only if three quarters of its shingle weight are shingles of
such items, so windows without them are never fingerprinted; this filter loses nothing. The
keys of the texts that hold such shingles are a small table of their own, so that Spark can send
them to the texts; only suspect texts are written and shuffled. A 64-bit SimHash over a window's shingles is cut
into RADIUS + 1 blocks: two fingerprints within RADIUS bits agree on one block at least, so the
join on (length, block, value) finds all pairs within the radius. Each is verified by the exact
weighted similarity of its five-word shingles: shared over united weight, the weight of a shingle
being its letters.

A shingle votes with the square root of its weight. Then the cosine of two windows' votes is
shared weight over the geometric mean of both weights, which is 2J / (1 + J) at least at
similarity J, however unequal the weights are. At 0.75 a bit differs with odds of 0.172 at most,
11 bits of 64 on average; 19 are allowed, which 99.5 of 100 such pairs stay within (binomial odds). Where a
single unshared shingle holds a quarter of the weight the odds are 0.218, and 94.9 of 100 stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, session, unused, words, written

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 19
BROADCAST_SHINGLES = 2_000_000  # benchmarks beyond it are joined by a shuffle
_LANES = 0x0000000100000001


def _shingles(hashes: Column, sizes: Column, k: int) -> Column:
    """Distinct (h, w) of every k consecutive words."""
    at = F.sequence(F.lit(0), F.size(hashes) - k)
    one = lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, k)).alias("h"),
                             F.aggregate(F.slice(sizes, i + 1, k), F.lit(0), lambda t, x: t + x).alias("w"))
    return F.when(F.size(hashes) >= k, F.array_distinct(F.transform(at, one)))


def _spelled(hashes: Column, k: int) -> Column:
    """Hashes of every k consecutive words, in their order; null if there are fewer."""
    at = F.sequence(F.lit(0), F.size(hashes) - k)
    return F.when(F.size(hashes) >= k, F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i + 1, k))))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda t, s: t + s["w"])


def _vote(shingle: Column) -> Column:
    return F.round(F.sqrt(shingle["w"]) * 16).cast("long")


def fingerprinted(df: DataFrame, shingles: str = "shingles") -> DataFrame:
    """``df`` with ``fp``: in each of 64 places the bit with more votes among the shingle hashes. Two places share a sum of 32 bits each."""
    def added(j: int):
        return lambda t, s: t + F.shiftrightunsigned(s["h"], j).bitwiseAND(F.lit(_LANES)) * s["v"]

    none = F.lit(0).cast("long")
    df = df.withColumn("_votes", F.transform(shingles, lambda s: F.struct(s["h"].alias("h"), _vote(s).alias("v"))))
    df = df.withColumn("_all", F.aggregate("_votes", none, lambda t, s: t + s["v"]))
    lanes = {f"_v{j}": F.aggregate("_votes", none, added(j)) for j in range(32)}
    df = df.withColumns(lanes)
    bits = [F.when(F.shiftrightunsigned(F.col(f"_v{j}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_all"),
                   F.lit((1 << (j + 32 * lane)) - ((1 << 64) if j + 32 * lane == 63 else 0)).cast("long")).otherwise(none)
            for j in range(32) for lane in range(2)]
    return df.withColumn("fp", reduce(lambda x, y: x.bitwiseOR(y), bits)).drop("_votes", "_all", *lanes)


def _blocks(fp: Column) -> Column:
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
                     for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))])


def _read(df: DataFrame, *columns: Column) -> DataFrame:
    """Lists of word hashes and word sizes next to ``columns``."""
    split = df.select(*columns, words(lower_ascii(F.col("text"))).alias("ws"))
    return split.select(*[c for c in split.columns if c != "ws"], F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"),
                        F.transform("ws", lambda w: F.length(w)).alias("wn"))


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_key, item_id, similarity): items that some window of a document reaches. ``doc_key`` hashes id and text."""
    session(docs.sparkSession)
    bench = _read(items.where("item_id is not null and text is not null"), F.col("item_id").cast("long").alias("item_id")).where(F.size("wh") > 0)
    bench = bench.withColumn("words", F.size("wh")).withColumn("k", F.least(F.lit(SHINGLE), F.col("words")))
    shingles = reduce(lambda c, k: c.when(F.col("k") == k, _shingles(F.col("wh"), F.col("wn"), k)), range(2, SHINGLE + 1),
                      F.when(F.col("k") == 1, _shingles(F.col("wh"), F.col("wn"), 1)))
    bench = written(fingerprinted(bench.select("item_id", "words", "k", shingles.alias("shingles"))), "items")
    sizes = [r.k for r in bench.select("k").distinct().collect()]  # at most five numbers
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = []
    for k in sizes:
        mine = bench.where(F.col("k") == k)
        grams = written(mine.select("words", F.explode("shingles.h").alias("h")).distinct(), "grams")
        small = grams.count() <= BROADCAST_SHINGLES
        texts = docs.where("text is not null").select(key.alias("doc_key"), "text")
        read = _read(texts, F.col("doc_key"))
        hits = read.select("doc_key", F.posexplode(_spelled(F.col("wh"), k)).alias("pos", "h")).join(F.broadcast(grams) if small else grams, "h")
        hits = hits.groupBy("doc_key", "words").agg(F.collect_set("pos").alias("at"), F.collect_set("h").alias("known"))
        hits = written(hits, "hits")
        # a table of keys alone is as small as its file says; the estimate for a column of ``hits`` counts its lists
        keys = written(hits.select("doc_key").distinct(), "keys")
        suspects = written(_read(texts.join(keys, "doc_key", "left_semi"), F.col("doc_key")), "suspects")
        near = suspects.join(hits, "doc_key")
        # window starts around each hit; a text shorter than the item is one window
        last = F.greatest(F.size("wh") - F.col("words"), F.lit(0))
        starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(
            F.least(last, F.greatest(F.lit(0), p - F.col("words") + k)), F.least(p, last)))))
        windows = near.select("doc_key", "words", "known", F.explode(F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.slice("wh", s + 1, F.col("words")).alias("wh"), F.slice("wn", s + 1, F.col("words")).alias("wn")))).alias("x"))
        windows = windows.select("doc_key", "words", "known", "x.start", _shingles(F.col("x.wh"), F.col("x.wn"), k).alias("shingles"))
        held = _weight(F.filter("shingles", lambda s: F.array_contains("known", s["h"])))
        windows = windows.where(held >= _weight(F.col("shingles")) * SIMILARITY).drop("known")
        windows = written(fingerprinted(windows), "windows")

        side = lambda df, *c: df.select(*c, "words", "fp", F.inline(_blocks(F.col("fp"))))
        other = side(mine, "item_id").withColumnRenamed("fp", "fp_item")
        close = side(windows, "doc_key", "start").join(other, ["words", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item"))) <= RADIUS)
        close = close.select("doc_key", "start", "words", "item_id").distinct()
        both = close.join(windows.select("doc_key", "start", "words", "shingles"), ["doc_key", "start", "words"]).join(
            mine.select("item_id", F.col("shingles").alias("item_shingles")), "item_id")
        shared = _weight(F.array_intersect("shingles", "item_shingles"))
        likeness = shared / (_weight(F.col("shingles")) + _weight(F.col("item_shingles")) - shared)
        found.append(both.select("doc_key", "item_id", likeness.alias("similarity")).where(F.col("similarity") >= SIMILARITY))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_key long, item_id long, similarity double")
    return written(reduce(DataFrame.union, found).groupBy("doc_key", "item_id").agg(F.max("similarity").alias("similarity")), "contaminated")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_items, item_ids, best_similarity, contaminated) per row of ``docs`` (doc_id, text); ``items`` hold item_id, text.

    Null and empty texts, and all texts if no item has words, are clean: no items, similarity null. Items that are null or
    empty match nothing. Null and repeated ids are judged row by row.
    """
    pairs = contaminated_pairs(docs, items)
    per = written(pairs.groupBy("doc_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity")), "per")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("doc_key"))
    out = rows.join(per, "doc_key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "best_similarity", F.col("best_similarity").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns."""
    name = unused(docs, "_bad")
    bad = contaminated_pairs(docs, items).select(F.col("doc_key").alias(name)).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    return docs.join(bad, key == F.col(name), "left_anti")
