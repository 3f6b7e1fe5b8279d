"""Keyed state of (user, item) pairs: what the events of the last days say of each recommendation.

A pair's state holds the maximum of each signal by (recommendation, day). A micro-batch
merges its own events into the days they fall on and emits the pair's latest clicked
interaction; stored events are never read again. Days before the window are dropped when
the pair is touched, and by a timer when it is not, so that state is bounded by the window.

Pairs are dealt to ``BUCKETS`` keys by hash, so that a call of the processor serves many pairs: a call costs
milliseconds, whatever it holds. A bucket's state is a map by pair, of which only the touched pairs are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import feedback as fb
from ..operators.relational import since

DAY_MS = 86_400_000
#: Stands for a missing id in a state key.
NO_ID = "\x00"
SIGNALS = ["has_click", "max_completion", "has_like", "has_dislike", "has_not_interested", "explicit_rating", "is_synthetic", "last_interaction"]
#: Keys of the state. Fixed: state of a running stream lies by them.
BUCKETS = 4096


def _merged(one: list | None, two: list) -> list:
    """The greater of each signal; a missing one gives way."""
    return two if one is None else [b if a is None else a if b is None else max(a, b) for a, b in zip(one, two)]


class PairSignals(StatefulProcessor):
    """Signals per (recommendation, day) of the pairs of a bucket; ``first_day`` is the first day that counts."""

    def __init__(self, first_day: int, days: int):
        self.first_day, self.days = first_day, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the signals as JSON: [recommendation, day, signals] of each
        self.state = handle.getMapState("signals", "user_id string, item_id string", "signals string")

    def _held(self, pair: tuple[str, str]) -> dict[tuple[str, int], list]:
        """What the state holds of a pair on days that count."""
        held = self.state.getValue(pair)
        return {(r, day): v for r, day, v in json.loads(held[0]) if day >= self.first_day} if held else {}

    def _keep(self, pair: tuple[str, str], held: dict[tuple[str, int], list]) -> None:
        self.state.updateValue(pair, (json.dumps([[*at, v] for at, v in held.items()]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple[str, str], dict[tuple[str, int], list]] = {}
        for frame in rows:
            for row in frame[["user_id", "item_id", "recommendation_id", "day", *SIGNALS]].itertuples(index=False, name=None):
                days, at = fresh.setdefault((row[0], row[1]), {}), (row[2], int(row[3]))
                days[at] = _merged(days.get(at), [None if v is None or v != v else v for v in row[4:]])
        known, found = self.state.exists(), []
        for pair, days in fresh.items():
            held = self._held(pair) if known else {}
            new = {at: _merged(held.get(at), v) for at, v in days.items()}
            if any(held.get(at) != v for at, v in new.items()):
                self._keep(pair, held | new)
            whole: dict[str, list] = {}
            for (recommendation, _), v in (held | new).items():
                whole[recommendation] = _merged(whole.get(recommendation), v)
            clicked = [(v[-1], r, v) for r, v in whole.items() if v[0] == 1]
            if clicked:
                _, recommendation, v = max(clicked, key=lambda c: (c[0], c[1] != NO_ID, c[1]))
                found.append((*pair, recommendation, *v))
        last = max((day for days in fresh.values() for _, day in days), default=None)
        if last is not None:
            self.handle.registerTimer((last + self.days + 1) * DAY_MS)
        if found:
            out = pd.DataFrame(found, columns=["user_id", "item_id", "recommendation_id", *SIGNALS])
            yield out.astype({**{s: "float64" for s in SIGNALS[:-1]}, "last_interaction": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The last day that the timer knew of has left every window; days that came since have timers of their own."""
        gone = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - self.days
        for pair, (held,) in [(tuple(k), tuple(v)) for k, v in self.state.iterator()]:
            all_days = json.loads(held)
            left = {(r, day): v for r, day, v in all_days if day >= gone}
            if not left:
                self.state.removeKey(pair)
            elif len(left) < len(all_days):
                self._keep(pair, left)
        return iter(())

    def close(self) -> None:
        pass


def latest_interactions(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per micro-batch: the pairs it touches, each with the signals of its latest clicked recommendation.

    The watermark stays a whole window behind, so no event of the window is late.
    """
    time = dict(events.dtypes)["created_at"]
    signals = {n: c.cast("double") for n, c in fb.signals().items() if n != "last_interaction"}
    at = F.col("created_at").cast("timestamp")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NO_ID)).alias(c)
    rows = since(events, "created_at", as_of, days).select(
        F.pmod(F.xxhash64("user_id", "item_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), named("user_id"), named("item_id"), named("recommendation_id"),
        F.unix_date(F.to_date("created_at")).alias("day"), *[c.alias(n) for n, c in signals.items()], F.unix_micros(at).alias("last_interaction"), at.alias("at"),
    ).withWatermark("at", f"{days} days")
    first_day = (pd.Timestamp(as_of) - pd.Timestamp("1970-01-01")).days - days
    types = dict(events.dtypes)
    schema = "user_id string, item_id string, recommendation_id string, " + ", ".join(f"{s} double" for s in SIGNALS[:-1]) + ", last_interaction long"
    out = rows.groupBy("bucket").transformWithStateInPandas(PairSignals(first_day, days), schema, "Update", "EventTime")
    flags = {s: F.col(s).cast("int") for s in SIGNALS if s.startswith("has_") or s == "is_synthetic"}
    return out.withColumns({
        **flags, **{c: F.expr(f"nullif({c}, '{NO_ID}')").cast(types[c]) for c in ("user_id", "item_id", "recommendation_id")},
        "last_interaction": F.timestamp_micros("last_interaction").cast(time),
    })
