"""The registered queries of the subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdedup, htmltext, kneserney, langid, licenses, mixing, neardup, periodic, substring, topk, toxicity, whitening
from .common import WORD, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ids="ids", decoded="decoded")
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.decide(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), out="found")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score(docs, table(spark, sf_dir, "labels"), out="score")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", htmltext.extract(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents"))


@query
def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
    model = kneserney.train(docs.where("not held_out"))
    got = kneserney.score(docs, model, out="lm")
    return got.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                      F.round("lm.base_score", 6).alias("base_score"), F.round("lm.score", 6).alias("score"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    # In every tenth document the words from a on repeat the first p of them.
    words = docs.withColumn("w", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    words = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    words = words.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    docs = words.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(w, 1, int(a)), {tail}), ' '), text)").alias("text"))
    got = periodic.detect(docs)
    # Longest by length / period, compared as whole numbers; runs come by start and period, so the first of equals wins.
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                     F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


ORACLE["op9_exact_topk"] = """
WITH ok AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE["op8_source_mix"] = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), best AS (  -- water level: the capped sources are those of the smallest size a weight
  SELECT source, source_size, w, 2.0 * source_size / w AS ratio,
         coalesce(sum(2 * source_size) OVER o, 0) AS capped_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(water, ratio) FILTER (WHERE water <= ratio) AS water
  FROM (SELECT ratio, (1.5 * (SELECT sum(source_size) FROM s) - capped_before) / w_left AS water FROM best)
), t AS (
  SELECT source, source_size, CASE WHEN w * water > 2 * source_size THEN 2.0 * source_size ELSE w * water END AS target FROM s, level
), q AS (
  SELECT doc_id, d.source, size, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13), doc_id, size
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT doc_id, source, size, (upto + r * source_size - size / 2) / target AS finish FROM q, (VALUES (0), (1)) AS x(r) WHERE size > 0
), served AS (
  SELECT finish, sum(size) OVER (ORDER BY finish, source, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS served FROM turns
), cut AS (
  SELECT max(finish) AS f FROM served WHERE served <= 1.5 * (SELECT sum(size) FROM d)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN size > 0 THEN size * (((upto - size / 2) / target <= f)::INT + ((upto + source_size - size / 2) / target <= f)::INT) ELSE 0 END AS BIGINT) AS taken
FROM q, cut
"""

ORACLE["op6_license_scan"] = f"""
WITH {licenses.sql_forms("d", "SELECT doc_id, text AS t FROM documents")},
{licenses.sql_forms("k", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in licenses.KNOWN) + ") AS v(license, t)")},
known AS (
  SELECT min(license) AS license, digest
  FROM (SELECT license, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) AS digest FROM k
        UNION ALL SELECT * FROM (VALUES {", ".join(f"('{a}', '{x}')" for a, found in licenses.DIGESTS.items() for x in found)}) AS f(license, digest))
  GROUP BY digest
),
lines AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n_lines
  FROM (SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS line FROM d) AS x JOIN known ON digest = sha256(line) WHERE line <> '' GROUP BY doc_id
)
SELECT d.doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) AS digest, w.license,
       coalesce(line_licenses, '') AS line_licenses, coalesce(n_lines, 0) AS n_lines
FROM d LEFT JOIN known AS w ON digest = sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g')))
LEFT JOIN lines ON lines.doc_id = d.doc_id
"""

ORACLE["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

# crc32 of the id's digits: each byte is xored in and shifted out bit by bit.
CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0] for ch in string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda c, x: CASE WHEN x > 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""

ORACLE["op11_lm_score"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(xor({CRC}, 4294967295) % 7 = 2, false) AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10)) AS words
  FROM documents
), t AS (
  SELECT r, doc_id, held_out, unnest(list_prepend(chr(9), words[:-2])) AS v, unnest(words) AS w FROM d
), pairs AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w
), single AS (SELECT w, CAST(sum(c) AS DOUBLE) AS raw, CAST(count(*) AS DOUBLE) AS a FROM pairs GROUP BY w
), context AS (
  SELECT v, CAST(sum(c) AS DOUBLE) AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c >= 3) AS n3 FROM pairs GROUP BY v
), counts AS (
  SELECT 2 AS k, CAST(c AS DOUBLE) AS c FROM pairs UNION ALL SELECT 1, a FROM single
), many AS (
  SELECT k, CAST(count(*) FILTER (c = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (c = 2) AS DOUBLE) AS n2, CAST(count(*) FILTER (c = 3) AS DOUBLE) AS n3, CAST(count(*) FILTER (c = 4) AS DOUBLE) AS n4
  FROM counts GROUP BY k
), y AS (SELECT *, n1 > 0 AND n2 > 0 AS ok, n1 / (n1 + 2 * n2) AS y FROM many
), discount AS (
  SELECT k, CASE WHEN ok AND 1 - 2 * y * n2 / n1 > 0 THEN 1 - 2 * y * n2 / n1 ELSE 0.5 END AS d1,
         CASE WHEN ok AND n3 > 0 AND 2 - 3 * y * n3 / n2 > 0 THEN 2 - 3 * y * n3 / n2 ELSE 1.0 END AS d2,
         CASE WHEN ok AND n3 > 0 AND n4 > 0 AND 3 - 4 * y * n4 / n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END AS d3 FROM y
), whole AS (
  SELECT sum(raw) AS n, CAST(count(*) AS DOUBLE) AS v, sum(a) AS total, max(d1) AS d1, max(d2) AS d2, max(d3) AS d3,
         (max(d1) * count(*) FILTER (a = 1) + max(d2) * count(*) FILTER (a = 2) + max(d3) * count(*) FILTER (a >= 3)) / sum(a) AS weight
  FROM single, (SELECT * FROM discount WHERE k = 1) AS x
), each AS (
  SELECT t.r, t.doc_id, t.held_out, coalesce(s.raw, 0) AS raw, log10((coalesce(s.raw, 0) + 1) / (g.n + g.v + 1)) AS base,
         coalesce(s.a - CASE s.a WHEN 1 THEN g.d1 WHEN 2 THEN g.d2 ELSE g.d3 END, 0) / g.total + g.weight / (g.v + 1) AS p1,
         coalesce(p.c - CASE p.c WHEN 1 THEN e.d1 WHEN 2 THEN e.d2 ELSE e.d3 END, 0) AS top, x.total, (e.d1 * x.n1 + e.d2 * x.n2 + e.d3 * x.n3) / x.total AS weight, g.n
  FROM t CROSS JOIN whole AS g CROSS JOIN (SELECT * FROM discount WHERE k = 2) AS e
  LEFT JOIN single AS s ON s.w = t.w LEFT JOIN pairs AS p ON p.v = t.v AND p.w = t.w LEFT JOIN context AS x ON x.v = t.v
)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (raw > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(fsum(base), 6) AS base_score, round(fsum(log10(CASE WHEN total > 0 THEN top / total + weight * p1 ELSE p1 END)), 6) AS score
FROM each GROUP BY r
"""
