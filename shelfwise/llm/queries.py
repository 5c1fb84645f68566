"""Registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import ann, bpe, exact_dedup, langid, line_dedup, lm_score, ngram_join, packing, periodic, secrets, toxicity, vector_codes, vector_dups
from shelfwise.llm.common import bounded_batches, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@register(
    "op1_exact_dedup",
    """
WITH d AS (
  SELECT doc_id, COALESCE(LENGTH(text), 0) AS n,
    SHA256(REGEXP_REPLACE(COALESCE(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  FIRST_VALUE(doc_id) OVER w AS keep_id,
  COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
  ROW_NUMBER() OVER w = 1 AS kept,
  text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings carry a digest of the value, not the value."""
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id", "start", F.char_length("value").cast("long").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret",
    )


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary)


@register("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_groups(table(spark, sf_dir, "documents"))
    return found.drop("text_key", "class_key")


@register(
    "op8_line_dedup",
    """
WITH docs AS (
  SELECT doc_id, text, STRING_SPLIT(text, CHR(10)) AS parts FROM documents WHERE text <> ''),
lines AS (
  SELECT doc_id, text, UNNEST(parts) AS line, UNNEST(RANGE(LEN(parts))) AS pos, LEN(parts) AS n FROM docs),
wide AS (
  SELECT doc_id, text, pos, n, bare AS a, LEAD(bare) OVER w AS b, LEAD(bare, 2) OVER w AS c
  FROM (SELECT *, TRIM(line, ' ' || CHR(9) || CHR(13)) AS bare FROM lines) AS bared WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
wins AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS nth
  FROM wide WHERE pos <= GREATEST(n - 3, 0) AND CONCAT(a, b, c) <> ''),
gone AS (
  SELECT DISTINCT doc_id, text, pos + k AS pos FROM wins, (SELECT UNNEST(RANGE(3)) AS k) AS ks WHERE nth > 1 AND pos + k < n),
kept AS (
  SELECT l.doc_id, l.text, STRING_AGG(line, CHR(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS cut, COUNT(*) AS lines, COUNT(g.pos) AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos
  GROUP BY l.doc_id, l.text)
SELECT d.doc_id, COALESCE(k.lines, 0) AS lines, COALESCE(k.removed, 0) AS removed_lines,
  SHA256(CASE WHEN k.lines IS NULL THEN COALESCE(d.text, '') ELSE COALESCE(k.cut, '') END) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
""",
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", F.col("lines").cast("long"), F.col("removed_lines").cast("long"), digest.alias("text_sha256"))


@register("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    made = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).alias("r")
    return table(spark, sf_dir, "documents").select("doc_id", made).select("doc_id", "r.*")


@register("op2_ann_search")
def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@register(
    "op11_embedding_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND LEN(embedding) > 0 AND LEN(embedding) = LEN(LIST_FILTER(embedding, lambda e: ISFINITE(e)))
    AND LEN(LIST_FILTER(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND LEN(a.x) = LEN(b.x)
  WHERE LIST_COSINE_SIMILARITY(a.x, b.x) >= 0.93),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
heads AS (SELECT id, MIN(other) AS head FROM reach GROUP BY id),
counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(c.n, 0) AS n_links, COALESCE(h.head, e.vec_id) AS component_id,
  COALESCE(h.head, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN heads h ON e.vec_id = h.id LEFT JOIN counts c ON e.vec_id = c.a
""",
)
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return vector_dups.near_duplicates(rows)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by h = crc32 of its id (a missing id as empty text), repeats its words
    from word a on with period p; its words are then joined by one space. Other texts stay."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    some = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).cast("int").alias("g"))
    some = some.withColumn("n", F.greatest(F.size("words"), F.lit(0)))  # 0 where nothing is planted
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    made = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(tail), F.lit(1), F.col("n") - F.col("a")))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # the longest, then the first, then the one of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))


def _code_sql(rounds: int = 6) -> str:
    """The rounds written out: every part against every entry, floors in whole numbers."""
    nearest = """
SELECT q.vec_id, q.p, ANY_VALUE(q.x) AS x, MIN(q.d * 16 + q.k) % 16 AS k, MIN(q.d) AS d FROM (
  SELECT a.vec_id, a.p, a.x, b.k,
    CAST(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM parts a JOIN {book} b ON a.p = b.p) q
GROUP BY q.vec_id, q.p"""
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT vec_id, label, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: ISFINITE(x))) = LEN(embedding)),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * LEN(v) // 8 + 1 : (p + 1) * LEN(v) // 8] AS x FROM kept, (SELECT UNNEST(RANGE(8)) AS p) AS ps),
book0 AS MATERIALIZED (
  SELECT p, x, ROW_NUMBER() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))"""
    ]
    for n in range(1, rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED ({nearest.format(book=f"book{n - 1}")}),
flat{n} AS (SELECT p, k, UNNEST(x) AS x, UNNEST(RANGE(LEN(x))) AS i FROM near{n}),
sums{n} AS (SELECT p, k, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM flat{n} GROUP BY p, k, i),
book{n} AS MATERIALIZED (
  SELECT b.p, b.k, COALESCE(m.x, b.x) AS x FROM book{n - 1} b LEFT JOIN (
    SELECT p, k, LIST((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{n} GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)"""
        )
    steps.append(f"near_last AS MATERIALIZED ({nearest.format(book=f'book{rounds}')})")
    steps.append(
        """coded AS (
  SELECT vec_id, STRING_AGG(PRINTF('%02x', k), '' ORDER BY p) AS code, CAST(SUM(d) AS BIGINT) AS error FROM near_last GROUP BY vec_id)"""
    )
    return (
        ",\n".join(steps)
        + f"""
SELECT c.vec_id, c.code, c.error, CAST(SUM(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT SHA256(STRING_AGG(ARRAY_TO_STRING(x, ','), ',' ORDER BY p, k)) FROM book{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id"""
    )


@register("op13_vector_codes", _code_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return vector_codes.vector_codes(rows).drop("label")
