"""Baselines, scoring, top-k recommendation, run selection and rollback."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clamp, split_list, stable_id
from .features import movie_stats
from .relational import error_metrics, train_test_split
from .scale import exact_quantiles, keep_first, stored, top_k_per_key


def mean_baseline(ratings: DataFrame) -> DataFrame:
    """Global mean with its in-sample RMSE and MAE."""
    mean = ratings.agg(F.avg("Rating")).scalar()
    scored = ratings.select("Rating", mean.alias("baseline_value"))
    return scored.agg(F.max("baseline_value").alias("baseline_value"), *error_metrics(F.col("baseline_value"), F.col("Rating")))


def fallback_score(user_avg: Column | str, movie_avg: Column | str) -> Column:
    """``clamp(movie_avg + (user_avg - 3) / 2, 0.5, 5)``."""
    u = F.col(user_avg) if isinstance(user_avg, str) else user_avg
    m = F.col(movie_avg) if isinstance(movie_avg, str) else movie_avg
    return clamp(m + (u - 3.0) * 0.5, 0.5, 5.0)


def batch_score(pairs: DataFrame, ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Score ``(UserID, MovieID)`` pairs with the fallback predictor and attach titles."""
    users = ratings.groupBy("UserID").agg(F.avg("Rating").alias("user_avg"))
    items = ratings.groupBy("MovieID").agg(F.avg("Rating").alias("movie_avg"))
    scored = pairs.join(users, "UserID", "left").join(items, "MovieID", "left")
    default = F.lit(3.0)
    score = fallback_score(F.coalesce("user_avg", default), F.coalesce("movie_avg", default))
    return scored.withColumn("score", score).join(movies.select("MovieID", "Title"), "MovieID", "left").select(
        "UserID", "MovieID", "Title", "score"
    )


def campaign(ratings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Totals per chosen movie over all users with ratings.

    The score depends on a user through their mean only, so users shrink to one row per
    distinct mean before the movies are attached; pairs are never listed.
    ``chosen``: at most a few hundred rows ``(MovieID, movie_avg)``.
    """
    means = ratings.groupBy("UserID").agg(F.avg("Rating").alias("user_avg")).groupBy("user_avg").agg(F.count(F.lit(1)).alias("users"))
    packed = chosen.agg(F.collect_list(F.struct("MovieID", "movie_avg"))).scalar()
    scored = means.withColumn("m", F.explode(packed)).select(
        F.col("m.MovieID"), "users", fallback_score(F.col("user_avg"), F.col("m.movie_avg")).alias("score")
    )
    return scored.groupBy("MovieID").agg(
        F.sum("users").alias("users"), (F.sum(F.col("users") * F.col("score")) / F.sum("users")).alias("avg_score"),
        F.sum(F.when(F.col("score") >= 4, F.col("users")).otherwise(0)).alias("likely_viewers"),
    )


def cold_start(ratings: DataFrame, movies: DataFrame, min_ratings: int = 100, k: int = 10) -> DataFrame:
    stats = movie_stats(ratings).filter(F.col("Popularity") >= min_ratings)
    best = stats.select("MovieID", "Popularity", F.round("AvgRating", 2).alias("avg_rating")).orderBy(
        F.desc("avg_rating"), F.desc("Popularity"), "MovieID"
    ).limit(k)
    return best.join(movies, "MovieID", "left").select("MovieID", "Title", "Genres", "Popularity", "avg_rating")


def history(ratings: DataFrame, movies: DataFrame, k: int) -> DataFrame:
    """The last ``k`` ratings of every user with movie details."""
    recent = top_k_per_key(ratings, ["UserID"], [F.desc("Timestamp"), "MovieID", "Rating"], k)
    return recent.join(movies, "MovieID", "left")


def favourite_genres(ratings: DataFrame, movies: DataFrame, k: int = 3) -> DataFrame:
    genres = movies.select("MovieID", F.explode(split_list("Genres")).alias("genre"))
    counts = ratings.select("UserID", "MovieID").join(genres, "MovieID").groupBy("UserID", "genre").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_key(counts, ["UserID"], [F.desc("n"), "genre"], k)


#: Item blocks up to which all meetings are held in one pass.
ONE_PASS = 4
#: Meetings of an item block that one task holds; a block that meets more user blocks is copied.
MEETINGS_A_TASK = 16
#: Items of a box, and users that are held against the boxes of a block at once.
BOX_ITEMS, USERS_AT_ONCE = 256, 512
#: Rows (user, item block) after which a task hands them on.
OPEN_ROWS = 100_000
SEEN = "array<struct<u: bigint, i: bigint>>"


@dataclass
class TopK:
    rows: DataFrame
    #: ``met`` and ``possible`` meetings of a user block with an item block, and the ``pruned_share``: by length alone, before boxes.
    report: DataFrame


def _packed(df: DataFrame, key: str, features: Sequence[str], block: str, keys: str, values: str, more: Sequence[str] = ()) -> DataFrame:
    """Rows packed by their block number, ids ascending inside a block."""
    row = F.struct(F.col(key).alias("id"), F.array(*features).alias("f"), *more)
    packed = df.groupBy(block).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return packed.select(block, F.col("_rows.id").alias(keys), F.flatten("_rows.f").alias(values), *[F.col(f"_rows.{m}").alias(m) for m in more])


def norm_blocks(items: DataFrame, item: str, features: Sequence[str], item_block: int) -> tuple[DataFrame, list[float]]:
    """``items`` with block ``ib`` in falling order of the vector's length, and the greatest length in each block.

    Blocks are cut at quantiles of the length; vectors of one length that fill several blocks are
    spread over them by id. One number for each block reaches the driver.
    """
    length = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    sized = stored(items.withColumn("_length", length), "lengths")
    blocks = max(1, math.ceil(sized.count() / item_block))
    shares = [1 - i / blocks for i in range(1, blocks)]
    found = sized.agg(F.percentile_approx("_length", shares, 10 * blocks + 1000)).first()[0] if shares else []
    cuts = -np.array(found or [], dtype="float64")  # rising

    @F.pandas_udf("int")
    def place(lengths: pd.Series, spread: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, -lengths.to_numpy(), "left"), np.searchsorted(cuts, -lengths.to_numpy(), "right")
        return pd.Series(low + spread.to_numpy() % (high - low + 1)).astype("int32")

    if blocks == 1:
        return sized.withColumn("ib", F.lit(0)), [0.0]
    placed = stored(sized.withColumn("ib", place("_length", F.pmod(F.xxhash64(item), F.lit(1 << 30)))), "norm_blocks")
    longest = {r.ib: r.n for r in placed.groupBy("ib").agg(F.max("_length").alias("n")).collect()}
    return placed, [longest.get(i, -1.0) for i in range(blocks)]


def box_cuts(f: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows in boxes of at most ``size`` rows: halves along the widest column, again and again."""
    todo, done = [np.arange(len(f))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        wide = np.ptp(f[at], axis=0).argmax()
        order = at[np.argsort(f[at, wide], kind="stable")]
        todo += [order[len(at) // 2:], order[: len(at) // 2]]
    return done


def boxed_blocks(item_blocks: DataFrame, dims: int, size: int) -> DataFrame:
    """Item blocks (ib, item_ids, item_f) with their items in boxes: ``starts`` of the boxes, their ``low`` and ``high`` corners.

    An item with a factor that is no finite number has no finite product with any user and is left out.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, f = np.asarray(row.item_ids), np.asarray(row.item_f, dtype="float64").reshape(-1, dims)
                fine = np.isfinite(f).all(axis=1)
                ids, f = ids[fine], f[fine]
                boxes = [at for at in box_cuts(f, size) if len(at)]
                order = np.concatenate([*boxes, np.zeros(0, int)]).astype(int)
                corners = [np.array([g(f[at], axis=0) for at in boxes]).ravel() for g in (np.min, np.max)]
                starts = np.cumsum([0, *map(len, boxes)])[:-1]
                yield pd.DataFrame({"ib": [row.ib], "item_ids": [ids[order]], "item_f": [f[order].ravel()], "starts": [starts.astype("int32")], "low": [corners[0]], "high": [corners[1]]})

    kind = dict(item_blocks.dtypes)["item_ids"]
    return item_blocks.mapInPandas(cut, f"ib int, item_ids {kind}, item_f array<double>, starts array<int>, low array<double>, high array<double>")


def may_reach(f: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Users x boxes: whether a vector between the corners of the box may have a rounded product of ``floor`` or more with the user's."""
    up, down = np.maximum(f, 0), np.minimum(f, 0)
    bound = up @ high.T + down @ low.T
    slack = 1e-12 * (np.abs(f) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return bound + slack >= floor[:, None]


def open_blocks(floored: DataFrame, boxed: DataFrame, features: Sequence[str], user: str, longest: Sequence[float]) -> DataFrame:
    """(user, factors, floor, ib): the item blocks after the first one that may hold an item for the user's first ``k``.

    A block is open where its greatest length and one of its boxes allow a product of the user's floor.
    The corners of all boxes go to every task: two numbers for each feature of ``BOX_ITEMS`` items.
    """
    dims, columns = len(features), [*features, "floor"]
    corners = {r.ib: [np.array(x).reshape(-1, dims) for x in (r.low, r.high)] for r in boxed.filter("ib > 0").select("ib", "low", "high").collect() if r.low}
    blocks = sorted(corners)
    lows, highs = (np.array([g(corners[b][n], axis=0) for b in blocks]).reshape(-1, dims) for n, g in ((0, np.min), (1, np.max)))
    # a block that holds a NaN has no length; its boxes have corners
    lengths = np.nan_to_num(np.array([longest[b] for b in blocks], dtype="float64"), nan=np.inf)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f, floor = pdf[list(features)].to_numpy(dtype="float64"), pdf["floor"].to_numpy(dtype="float64")
            whole = may_reach(f, lows, highs, floor) & (np.sqrt((f * f).sum(axis=1))[:, None] * lengths * (1 + 1e-12) + 1e-6 >= floor[:, None])
            at, ib, held = [], [], 0
            for n, b in enumerate(blocks):
                rows = np.nonzero(whole[:, n])[0]
                if len(rows):
                    rows = rows[may_reach(f[rows], *corners[b], floor[rows]).any(axis=1)]
                    at.append(rows)
                    ib.append(np.full(len(rows), b, "int32"))
                    held += len(rows)
                if held and (held >= OPEN_ROWS or n == len(blocks) - 1):
                    yield pdf.iloc[np.concatenate(at)].assign(ib=np.concatenate(ib))
                    at, ib, held = [], [], 0

    rows = floored.select(user, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInPandas(found, f"{user} {dict(floored.dtypes)[user]}, " + ", ".join(f"{c} double" for c in columns) + ", ib int")


def pruned_top_k(
    users: DataFrame, items: DataFrame, features: Sequence[str], k: int, seen: DataFrame | None = None,
    user: str = "UserID", item: str = "MovieID", user_block: int = 1024, item_block: int = 8192,
) -> TopK:
    """Exact top-k items per user by factor dot product, rounded to 6 digits, ties by item id.

    Item blocks fall in vector length. Every user block meets the first one, which gives each user a
    k-th best score so far. By Cauchy and Schwarz no product with a later block exceeds the
    user's length times the block's greatest length, which leaves some meetings of user blocks with item
    blocks; to these go only the users, one by one, for whom a box of items in the block may still hold a
    better one, and there a user is multiplied with the items of such boxes only.
    Users are dealt to tasks by item block, so what is shuffled grows with the blocks that a user is open to.
    Only ``k`` rows per user leave a task: pairs are never rows.
    ``seen`` pairs are found by the items of the first block, which is small, and then by the blocks that
    their users are open to.
    """
    dims = len(features)
    users = stored(users, "users")
    placed, longest = norm_blocks(items, item, features, item_block)
    n_user_blocks = F.lit(max(1, math.ceil(users.count() / user_block)))
    of_user = F.pmod(F.xxhash64(user), n_user_blocks).cast("int")
    item_blocks = _packed(placed, item, features, "ib", "item_ids", "item_f")
    several = len(longest) > ONE_PASS
    pairs = None
    if seen is not None:
        seen = seen.select(user, item)
        if several:
            seen = stored(seen, "seen")
            # one block: few rows whatever the number of items
            located = seen.join(F.broadcast(placed.filter("ib = 0").select(item, "ib")), item)
        else:
            located = seen.join(placed.select(item, "ib"), item)
        pairs = located.distinct().withColumn("ub", of_user).groupBy("ub", "ib").agg(F.collect_list(F.struct(F.col(user).alias("u"), F.col(item).alias("i"))).alias("seen"))
    types = dict(users.dtypes)[user], dict(items.dtypes)[item]
    schema = f"{user} {types[0]}, {item} {types[1]}, score double"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                u, i = np.asarray(row.user_ids), np.asarray(row.item_ids)
                f = np.asarray(row.user_f).reshape(-1, dims)
                scores = f @ np.asarray(row.item_f).reshape(-1, dims).T
                scores = np.floor(scores * 1e6 + 0.5) / 1e6
                if row.seen is not None and len(row.seen):
                    gone = pd.DataFrame(list(row.seen))
                    a, b = np.searchsorted(u, gone["u"]), np.searchsorted(i, gone["i"])
                    ok = (a < len(u)) & (b < len(i))
                    a, b, gone = a[ok], b[ok], gone[ok]
                    ok = (u[a] == gone["u"].to_numpy()) & (i[b] == gone["i"].to_numpy())
                    scores[a[ok], b[ok]] = -np.inf
                # every score that reaches the k-th best of its row, then exact order with ties by item id
                keep = min(k, scores.shape[1])
                floor = np.partition(scores, -keep, axis=1)[:, -keep]
                a, b = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
                s = scores[a, b]
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                top = place < k
                yield pd.DataFrame({user: u[a[top]], item: i[b[top]], "score": s[top]})

    def met(meetings: DataFrame, user_blocks: DataFrame, name: str) -> DataFrame:
        """Written top rows of (ub, ib) meetings."""
        load = meetings.groupBy("ib").agg(F.ceil(F.count(F.lit(1)) / MEETINGS_A_TASK).cast("int").alias("parts"))
        load = stored(load, "load")
        # fewer than the shuffle width would be dealt anew by the join, and then to a few tasks by their bytes
        tasks = max(load.agg(F.sum("parts")).first()[0] or 1, int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        copies = load.select("ib", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(item_blocks, "ib")
        with_seen = meetings.join(pairs, ["ub", "ib"], "left") if pairs is not None else meetings.withColumn("seen", F.array().cast(SEEN))
        dealt = with_seen.join(load, "ib").withColumn("part", F.pmod(F.xxhash64("ub"), F.col("parts")).cast("int"))
        dealt = dealt.join(user_blocks, "ub").repartition(tasks, "ib", "part")
        whole = dealt.join(copies.repartition(tasks, "ib", "part"), ["ib", "part"]).select("user_ids", "user_f", "item_ids", "item_f", "seen")
        return stored(whole.mapInPandas(best, schema), name)

    def better(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The first ``k`` scores of each user among the items of one block that reach the user's floor."""
        out = [pd.DataFrame({user: left[user][:0], item: np.zeros(0, "int64"), "score": np.zeros(0)})]
        if not len(left) or not len(right):
            return out[0]
        block = right.iloc[0]
        u, f, floor = left[user].to_numpy(), left[list(features)].to_numpy(dtype="float64"), left["floor"].to_numpy(dtype="float64")
        ids, g = np.asarray(block["item_ids"]), np.asarray(block["item_f"], dtype="float64").reshape(-1, dims)
        low, high = (np.asarray(block[c], dtype="float64").reshape(-1, dims) for c in ("low", "high"))
        bounds = [*block["starts"], len(ids)]
        names, code = np.unique(ids, return_inverse=True)
        for start in range(0, len(u), USERS_AT_ONCE):
            part = slice(start, start + USERS_AT_ONCE)
            reach, hits = may_reach(f[part], low, high, floor[part]), []
            for n in np.nonzero(reach.any(axis=0))[0]:
                rows, first = np.nonzero(reach[:, n])[0] + start, bounds[n]
                scores = np.floor(f[rows] @ g[first:bounds[n + 1]].T * 1e6 + 0.5) / 1e6
                a, b = np.nonzero((scores >= floor[rows][:, None]) & np.isfinite(scores))
                hits.append((rows[a], b + first, scores[a, b]))
            if not hits:
                continue
            a, b, s = map(np.concatenate, zip(*hits))
            gone = [(n, x) for n, x in enumerate(left["seen"].iloc[part], start) if x is not None and len(x)]
            if gone:
                rows = np.repeat([n for n, _ in gone], [len(x) for _, x in gone])
                at = np.searchsorted(names, np.concatenate([x for _, x in gone]).astype(names.dtype))
                fresh = ~np.isin(a * len(names) + code[b], rows * len(names) + at)
                a, b, s = a[fresh], b[fresh], s[fresh]
            order = np.lexsort((ids[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append(pd.DataFrame({user: u[a[top]], item: ids[b[top]], "score": s[top]}))
        return pd.concat(out[1:] or out)

    blocked = users.withColumn("ub", of_user)
    whole_blocks = _packed(blocked, user, features, "ub", "user_ids", "user_f")
    each = blocked.select("ub").distinct()
    if not several:
        # too few blocks for a second pass to pay
        all_met = each.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(len(longest) - 1))))
        report = all_met.agg(F.count(F.lit(1)).alias("met"), F.count(F.lit(1)).alias("possible"), F.lit(0.0).alias("pruned_share"))
        return TopK(top_k_per_key(met(all_met, whole_blocks, "all"), [user], [F.desc("score"), item], k), report)
    first = met(each.withColumn("ib", F.lit(0)), whole_blocks, "first")
    # the k-th best score so far, or none
    nothing = F.lit(float("-inf"))
    kth = first.groupBy(user).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    length = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    floored = stored(blocked.join(kth, user, "left").withColumn("floor", F.coalesce("floor", nothing)), "floored")

    boxed = stored(boxed_blocks(item_blocks, dims, BOX_ITEMS), "boxes")
    wanted = stored(open_blocks(floored, boxed, features, user, longest), "open")
    load = stored(wanted.groupBy("ib").agg(F.ceil(F.count(F.lit(1)) / (MEETINGS_A_TASK * user_block)).cast("int").alias("parts")), "load")
    if seen is None:
        dealt = wanted.withColumn("seen", F.lit(None).cast(f"array<{types[1]}>"))
    else:
        # pairs of a user and an item whose block the user is open to
        located = seen.join(placed.join(load, "ib", "left_semi").select(item, "ib"), item)
        gone = located.join(wanted.select(user, "ib"), [user, "ib"], "left_semi").groupBy(user, "ib").agg(F.collect_set(item).alias("seen"))
        dealt = wanted.join(gone, [user, "ib"], "left")
    dealt = dealt.join(load, "ib").withColumn("part", F.pmod(F.xxhash64(user), F.col("parts")).cast("int")).drop("parts")
    copies = load.select("ib", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(boxed, "ib")
    later = stored(dealt.groupBy("ib", "part").cogroup(copies.groupBy("ib", "part")).applyInPandas(better, schema), "later")

    least = F.when(length > 0, (F.col("floor") - 1e-6) / length / (1 + 1e-12)).otherwise(F.when(F.col("floor") <= 1e-6, nothing).otherwise(F.lit(float("inf"))))
    lengths = F.array(*[F.lit(float(n)) for n in longest[1:]])
    blocks = each.count()
    left = floored.groupBy("ub").agg(F.min(least).alias("least")).withColumn("met", F.size(F.filter(lengths, lambda n: n >= F.col("least"))) + 1)
    report = left.agg(F.coalesce(F.sum("met"), F.lit(0)).cast("bigint").alias("met")).withColumn("possible", F.lit(blocks * len(longest)).cast("bigint"))
    report = report.withColumn("pruned_share", 1 - F.try_divide(F.col("met").cast("double"), F.col("possible").cast("double")))
    return TopK(top_k_per_key(first.unionByName(later), [user], [F.desc("score"), item], k), report)


def top_k_items(
    users: DataFrame, items: DataFrame, features: Sequence[str], k: int, seen: DataFrame | None = None,
    user: str = "UserID", item: str = "MovieID", user_block: int = 1024, item_block: int = 8192,
) -> DataFrame:
    """The rows of ``pruned_top_k``."""
    return pruned_top_k(users, items, features, k, seen, user, item, user_block, item_block).rows


def with_recommendation_id(top: DataFrame, run_id: str, user: str = "UserID") -> DataFrame:
    return top.withColumn("recommendation_id", stable_id(F.lit(run_id), F.col(user)))


def offline_quality(scored: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """RMSE, MAE, coverage, exact p95 of the absolute error, and the one-sided share within one star."""
    e = F.col(prediction) - F.col(actual)
    p95 = exact_quantiles(scored.select(F.abs(e).alias("a")), [], "a", {"p95": 0.95}).scalar()
    one = scored.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col(prediction).isNotNull(), 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(F.when(e >= -1, 1.0).when(e < -1, 0.0)).alias("hit_within_1_star"),
    )
    return one.withColumn("p95_abs_error", p95)


# --- runs and versions


def comparable_runs(runs: DataFrame) -> DataFrame:
    """Runs with ``score = (rmse + mae) / 2``; either metric name counts, NaN counts as missing."""

    def metric(name: str) -> Column:
        clean = [F.when(~F.isnan(c), F.col(c)) for c in (name, f"baseline_{name}")]
        return F.coalesce(*clean)

    out = runs.withColumn("rmse", metric("rmse")).withColumn("mae", metric("mae"))
    return out.withColumn("score", (F.col("rmse") + F.col("mae")) / 2)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Best, worst and average score per experiment, with the number of runs that have none."""
    scored = comparable_runs(runs)
    return scored.groupBy("experiment").agg(
        F.min("score").alias("best_score"), F.max("score").alias("worst_score"), F.avg("score").alias("avg_score"),
        F.min_by("run_id", F.when(F.col("score").isNotNull(), F.struct("score", "run_id"))).alias("best_run"),
        F.count_if(F.col("score").isNull()).alias("unscored"),
    )


def select_best(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Best run and two runners-up per experiment with their registered version, if any."""
    ranked = top_k_per_key(comparable_runs(runs).filter(F.col("score").isNotNull()), ["experiment"], ["score", "run_id"], 3)
    newest = versions.groupBy("run_id").agg(F.max("version").alias("version"))
    role = F.when(F.col("rank") == 1, "selected").otherwise("runner_up")
    return ranked.join(newest, "run_id", "left").select("experiment", "run_id", "rmse", "mae", "score", "rank", role.alias("role"), "version")


def rollback_targets(versions: DataFrame) -> DataFrame:
    """Per model: the current Production version and the highest other version in Staging or Archived."""
    production = F.max(F.when(F.col("stage") == "Production", F.col("version")))
    target = F.max(F.when(F.col("stage").isin("Staging", "Archived"), F.col("version")))
    return versions.groupBy("model_name").agg(production.alias("production_version"), target.alias("rollback_version"))


def newest_first(log: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    return log.orderBy(*[F.desc(c) for c in order]).limit(limit)


def current_version(versions: DataFrame) -> DataFrame:
    return keep_first(versions.filter(F.col("stage") == "Production"), ["model_name"], [F.desc("version")])


# --- classifier


def forest_rows(rows: DataFrame, id_col: str, vector: str, label: str, seed: int = 42) -> DataFrame:
    """``split``, label and feature vector of the rows that have both; 80/20 by id hash."""
    data = train_test_split(rows.dropna(subset=[vector, label]), [id_col], seed=seed)
    return data.select("split", F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def forest_accuracy(rows: DataFrame, id_col: str, vector: str, label: str, trees: int = 100, depth: int = 8, seed: int = 42) -> DataFrame:
    """80/20 split by id hash, random forest, accuracy on the test part."""
    data = forest_rows(rows, id_col, vector, label)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data.filter(F.col("split") == "train"))
    scored = model.transform(data.filter(F.col("split") == "test"))
    return scored.agg(
        F.count(F.lit(1)).alias("test_rows"), F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy")
    )
