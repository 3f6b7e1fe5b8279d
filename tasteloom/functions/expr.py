"""Column expressions shared by the operators. All of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Col = Column | str


def as_col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Col, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(c)))


def ratio(num: Col, den: Col) -> Column:
    """``num / den``; NULL for a zero denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def percent(num: Col, den: Col, digits: int = 2) -> Column:
    return F.round(ratio(num, den) * 100, digits)


def right_closed_bin(c: Col, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; NULL outside all of them."""
    c = as_col(c)
    out = None
    for low, high, name in zip(edges, edges[1:], names):
        inside = c > low if high == float("inf") else (c > low) & (c <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def split_list(c: Col, sep: str = "|") -> Column:
    return F.split(as_col(c), f"[{sep}]")


def multi_hot(c: Col, vocabulary: Sequence[str], prefix: str, sep: str = "|") -> list[Column]:
    parts = split_list(c, sep)
    return [F.array_contains(parts, v).cast("int").alias(f"{prefix}_{v}") for v in vocabulary]


def one_hot(c: Col, vocabulary: Sequence, prefix: str) -> list[Column]:
    return [
        F.coalesce((as_col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in vocabulary
    ]


def whole_days(later: Col, earlier: Col) -> Column:
    """Full 24 h periods between two epoch-second columns."""
    return F.floor((as_col(later) - as_col(earlier)) / 86400).cast("bigint")


def off_step(c: Col, step: float) -> Column:
    """True where the value is no multiple of ``step``, with the same tolerance on both sides."""
    q = as_col(c) / F.lit(float(step))
    return F.abs(q - F.round(q)) >= 1e-6


def _marked(cols: Sequence[Col]) -> Column:
    """The values as one text: a null holds its place, and a mark inside a value is escaped, so that no two lists share a text."""
    def plain(c: Col) -> Column:
        text = as_col(c).cast("string")
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))

    return F.concat_ws("|", *[F.coalesce(plain(c), F.lit("\x00")) for c in cols])


def hash_bucket(cols: Sequence[Col], buckets: int) -> Column:
    """A bucket that any engine can reproduce: the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(_marked(cols)), 1, 8), 16, 10).cast("bigint") % buckets


def digest_order(cols: Sequence[Col]) -> Column:
    """A repeatable pseudo-random order."""
    return F.md5(_marked(cols))


def stable_id(*cols: Col) -> Column:
    """An identifier that a retried task computes again unchanged."""
    return F.sha2(_marked(cols), 256)


def r6(c: Col) -> Column:
    return F.round(as_col(c), 6)
