"""The registered queries of the training-data operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from .common import table
from .debruijn import drop_repeats
from .epsgrid import near_vectors
from . import decontaminate, hmm, langid, lines, quality, resample, secrets, variants
from .minhash import near_duplicates
from .packing import pack
from .tokens import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def _rule_sql(number: int, rule: secrets.Rule) -> str:
    body = ("(?i:" if rule.any_case else "(?:") + rule.pattern.replace("'", "''") + ")"
    size = f"length(regexp_extract(m, '{body}', {rule.group}))" if rule.group else "length(m)"
    return f"""SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, ends - length(m) AS s, ends AS e, {size} AS size FROM (
        SELECT doc_id, m, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
          SELECT doc_id, unnest(w) AS w, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '(?s:(.*?))({body})', 0) AS w, regexp_extract_all(text, '(?s:(.*?))({body})', 2) AS m
            FROM documents WHERE text IS NOT NULL))) WHERE {size} >= {rule.least}"""


OP9_SQL = "WITH f AS (" + " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secrets.RULES)) + """),
t AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM f)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, number) FILTER (number < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, number), '') AS spans
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""


@query("op9_secret_scan", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op10_mixture_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (k) WHERE doc_id > least),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.p) AS t
         FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) u
         LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.p = u.p WHERE g.p IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op5_substring_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = e.vec_id
"""


@query("op7_embedding_near_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query("op2_hmm_lm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


#: The 256 remainders of the checksum as one list, and the checksum of a text's bytes by them.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
         FROM (SELECT unnest(range(0, 256)) AS b))"""
CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, CAST(length(hex(encode({text}))) // 2 AS BIGINT)),
         lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

OP11_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS w FROM d),
g AS (SELECT unnest(list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
b AS MATERIALIZED (SELECT w, {CRC.format(text="w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT bucket, count(*) AS n FROM f JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM g JOIN b USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM f) + 10000) AS DOUBLE)
           / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM g) + 10000) AS DOUBLE))) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT x.*, rank FROM x LEFT JOIN (SELECT * FROM r WHERE rank <= 10 * (SELECT count(*) FROM r) // 100) USING (doc_id)
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
t AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM l LEFT JOIN f USING (k) WHERE least IS NULL OR doc_id = least GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(t.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op12_line_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.with_bitmaps(table(spark, sf_dir, "documents")))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {CRC.format(text="(doc_id || ':' || w)")} AS h FROM runs, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS c FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN v b ON a.c = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN cut b ON b.c = a.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word),
q AS (SELECT word, count(*) AS n_near FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT word, near AS form, near_n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p) WHERE k = 1 AND near_n >= 10 * n),
r AS (SELECT word, form AS root, 1 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON r.root = f.word)
SELECT v.word, f.form, coalesce(last.root, v.word) AS root, v.n, coalesce(q.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN f USING (word) LEFT JOIN q USING (word) LEFT JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY 1) last USING (word)
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
