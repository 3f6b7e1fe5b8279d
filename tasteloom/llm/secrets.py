"""Secret scan by a trigram inverted index, in DataFrame functions only.

The Boolean trigram query of every rule is derived from its regular expression: an OR of sets
of trigrams that a match must hold. Only trigrams that some query names are indexed. A
document is posted under each it holds, the postings are intersected for each document, and
rules whose query holds are verified by their expression. A rule without mandatory trigrams
scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .common import session, unused, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java and Python agree on it
    base: bool = False
    group: int = 0  # the part whose length counts
    least: int = 0
    any_case: bool = False


# The base rules as contracted, then further key formats that their issuers publish.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", True),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of AND-sets of lower-case trigrams that every match holds; an empty set asks for nothing."""
    from re import _constants as C, _parser as P

    def simplest(queries):
        kept = []
        for q in sorted(set(queries), key=lambda q: (len(q), sorted(q))):
            if not any(k <= q for k in kept):
                kept.append(q)
        return kept

    def both(a, b):
        return simplest([x | y for x, y in product(a, b)])

    def walk(nodes):
        query, run = [frozenset()], ""

        def close(query, run):
            grams = frozenset(run[i:i + 3].lower() for i in range(len(run) - 2))
            return both(query, [grams])

        for op, arg in nodes:
            if op is C.LITERAL:
                run += chr(arg)
                continue
            query, run = close(query, run), ""
            if op is C.SUBPATTERN:
                query = both(query, walk(arg[3]))
            elif op is C.BRANCH:
                query = both(query, simplest([q for branch in arg[1] for q in walk(branch)]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                query = both(query, walk(arg[2]))
        return close(query, run)

    return walk(P.parse(pattern))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, number, kind, end), in code points."""
    body = ("(?i:" if rule.any_case else "(?:") + rule.pattern + ")"
    step = r"\G(?s:(.*?))(" + body + ")"
    with_lead = F.regexp_extract_all(text, F.lit(step), F.lit(0))
    match = F.regexp_extract_all(text, F.lit(step), F.lit(2))

    def found(w: Column, m: Column) -> Column:
        size = F.length(F.regexp_extract(m, body, rule.group)) if rule.group else F.length(m)
        return F.struct(F.length(w).alias("step"), F.length(m).alias("own"), size.alias("size"))

    def fold(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["step"]
        span = F.struct((end - x["own"]).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    spans = F.aggregate(F.zip_with(with_lead, match, found), start, fold, lambda acc: acc["spans"])
    return F.when(text.rlike(body), spans).otherwise(none)


def candidate_rules(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rules): the rules with trigram queries that each document of the index may match; others are absent."""
    asked = {r.kind: q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    grams = sorted({g for q in asked.values() for s in q for g in s})
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    index = docs.where("doc_id is not null").select("doc_id", low.alias("low")).select(F.explode(held).alias("gram"), "doc_id")
    postings = index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    holds = {k: reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.array_contains("grams", g) for g in sorted(s)]) for s in q])
             for k, q in asked.items()}
    return postings.select("doc_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()])).alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, number, kind, end), code points, end exclusive, by start then rule.

    Null texts have none. Rows with a null id are not in the index and are verified by every
    rule; rows that repeat an id share their candidates, and each is verified by its own text.
    Columns of ``docs`` pass through; one named ``secret_spans`` is replaced.
    """
    session(docs.sparkSession)
    free = {r.kind for r in rules if frozenset() in trigram_query(r.pattern)}
    id_, rules_ = unused(docs, "_id"), unused(docs, "_rules")
    marked = candidate_rules(docs, rules).select(F.col("doc_id").alias(id_), F.col("rules").alias(rules_))
    # the candidates are one short row for each document that may match: written, so that a hot text is split freely
    out = docs.drop("secret_spans").join(written(marked, "candidates"), F.col("doc_id") == F.col(id_), "left")
    text = F.coalesce("text", F.lit(""))
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(text, r, i)
        if r.kind not in free:
            wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains(rules_, r.kind), F.lit(False))
            spans = F.when(wanted, spans).otherwise(F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>"))
        parts.append(spans)
    return out.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop(id_, rules_)


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of scanned documents."""
    base = [r.kind for r in RULES if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    return scanned.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
                          F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def redacted(scanned: DataFrame, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mask``; null stays null."""
    text = F.col("text")

    def fold(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("secret_spans", start, fold, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size("secret_spans") == 0, text).otherwise(whole)
