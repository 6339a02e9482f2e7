"""The registered queries of the text operators: each applies its operator to the
whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, idstore, language, linededup, neighbours, packing, periods, prefixjoin, quality, simhash, spelling, suffixes, webpages
from eventloom.llm.common import table, tokenizer_path
from eventloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, bits=3)


@query(
    """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
solid AS (
  SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE trim(s) <> ''),
win AS (
  SELECT doc_id, k, [s, lead(s) OVER w, lead(s, 2) OVER w] AS g, lead(k, 2) OVER w AS k3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
placed AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS n FROM win WHERE k3 IS NOT NULL),
gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM solid s JOIN placed p
  ON p.doc_id = s.doc_id AND p.n > 1 AND s.k BETWEEN p.k AND p.k + 2),
kept AS (
  SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS t,
         count(*) AS n, count(g.i) AS removed
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN removed = 0 THEN d.text ELSE coalesce(t, '') END AS text,
       CAST(n AS INTEGER) AS n_lines, CAST(removed AS INTEGER) AS n_removed
FROM documents d JOIN kept k ON k.doc_id = d.doc_id
"""
)
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = linededup.without_repeats(table(spark, sf, "documents"))
    return out.selectExpr("doc_id", "text", "_x_lines AS n_lines", "_x_removed AS n_removed")


#: score from which a document is kept
KEEP_FROM = 0.5


@query()
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.selectExpr("doc_id", "_x_score AS score", f"_x_score >= {KEEP_FROM} AS keep")


@query()
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = decontam.load_items(table(spark, sf, "benchmark"))
    found = decontam.with_hits(table(spark, sf, "documents").select("doc_id", "text"), items)
    return found.selectExpr("doc_id", "inline(_x_hits)")


@query()
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query()
def op5_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    idstore.write_ids(table(spark, sf, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return idstore.read_ids(spark, path, with_ids=False)


@query()
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf, "documents"))
    # a removed run may end inside a character
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


@query()
def op2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, nearest=20)


@query()
def op9_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language.scored(table(spark, sf, "documents"))


@query()
def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return webpages.extracted(pages).selectExpr("page_id", "url", "_x_text AS text", "_x_chars AS n_chars")


@query()
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periods.with_loops(table(spark, sf, "documents"))
    found = periods.periodic_runs(docs, least_words=6, least_times=4)
    longest = F.array_max(F.transform("_x_runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short"))))
    line = F.transform("_x_runs", lambda r: F.concat_ws("", F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("_x_runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("_x_text", 256).alias("collapsed_sha256"),
    )


@query()
def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"), least_letters=5, least_count=3, drop_every=97)


@query(
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
gram AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) FOR i IN range(1, len(w) - 2)] END) AS g
  FROM words),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common
  FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (
  SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b
  WHERE 100 * n_common >= 85 * (s.n + t.n - n_common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""
)
def op12_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return prefixjoin.similar_groups(table(spark, sf, "documents"), size=4, percent=85)
