"""Queries over text: product and note search, guards, call log, conversations, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import guard
from shelfwise.functions.notes import classify_batch
from shelfwise.operators import changelog, chat, gateway, postings, search, silver, sketches
from shelfwise.plans.frames import Retail
from shelfwise.plans.registry import query
from shelfwise.sources import fixtures as fx
from shelfwise.sources.scratch import scratch_dir, stage

# ---- product and note search

# Fixed values, written out: the twins do not share them with the operators they check.
CATALOG = """
SELECT p.*, most_on_hand,
  CONCAT_WS(' ', product_name, category, seasonality, CASE WHEN lower(seasonality) LIKE '%winter%'
    OR lower(category) LIKE '%outerwear%' OR regexp_matches(lower(product_name), 'parka|jacket|fleece|hoodie|coat')
    THEN 'warm insulated cold-weather layer for winter warmth' ELSE 'apparel' END) AS description
FROM raw_products p JOIN (SELECT product_id, MAX(on_hand_units) AS most_on_hand FROM positions GROUP BY 1) AS stock
USING (product_id)"""


@query("product_catalog_dedup",
       "product_id:i product_name:s category:s seasonality:s price_usd:2 most_on_hand:i", CATALOG)
def product_catalog_dedup(r: Retail) -> DataFrame:
    return search.product_catalog(r.position_by_product)


@query("product_search_text", "product_id:i description:s", CATALOG)
def product_search_text(r: Retail) -> DataFrame:
    return search.product_catalog(r.position_by_product)


def _and_match(terms: list[str], limit: str) -> str:
    hits = " + ".join(f"len([w FOR w IN words IF w = '{t}'])" for t in terms)
    every = " AND ".join(f"list_contains(words, '{t}')" for t in terms)
    return f"""SELECT *, most_on_hand AS on_hand_units, CAST({hits} AS DOUBLE) / len(words) AS rank
FROM (SELECT *, [w FOR w IN regexp_split_to_array(lower(CONCAT_WS(' ', product_name, description)), '[^a-z]+') IF w <> ''] AS words
  FROM ({CATALOG}) AS catalog) AS worded WHERE {every} ORDER BY rank DESC, product_id {limit}"""


PRODUCT_QUERY = "cold weather ring"


@query("fulltext_search",
       "product_id:i product_name:s category:s price_usd:2 on_hand_units:i rank:6",
       _and_match(["cold", "ring", "weather"], "LIMIT 10"))
def fulltext_search(r: Retail) -> DataFrame:
    return search.fulltext_search(search.product_catalog(r.position_by_product), PRODUCT_QUERY)


@query("search_onhand_join", "product_id:i product_name:s on_hand_units:i rank:6",
       _and_match(["bolt"], ""))
def search_onhand_join(r: Retail) -> DataFrame:
    return search.fulltext_search(search.product_catalog(r.position_by_product), "bolt", limit=None)


NOTE_QUERY = "license thanedble tiontion onbleea einlich the"
TERMS = search.query_terms(NOTE_QUERY)

_COUNTS = ", ".join(f"CAST(len([w FOR w IN words IF w = '{t}']) AS DOUBLE) AS tf{i}" for i, t in enumerate(TERMS))
_IDF = ", ".join(f"COUNT(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(
    f"LN(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE "
    f"/ (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))"
    for i in range(len(TERMS))
)
BM25 = f"""
SELECT doc_id, {_SCORE} AS bm25 FROM (
  SELECT doc_id, CAST(len(words) AS DOUBLE) AS length, {_COUNTS} FROM (
    SELECT doc_id, [w FOR w IN regexp_split_to_array(lower(text), '[^a-z]+') IF w <> ''] AS words FROM documents) AS worded
) AS stats CROSS JOIN (
  SELECT COUNT(*) AS n, AVG(length) AS avg_length, {_IDF} FROM (
    SELECT CAST(len(words) AS DOUBLE) AS length, {_COUNTS} FROM (
      SELECT [w FOR w IN regexp_split_to_array(lower(text), '[^a-z]+') IF w <> ''] AS words FROM documents) AS worded
  ) AS stats) AS corpus"""


def note_stats(r: Retail, extra: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Token counts of all documents, written once: the texts are read and split one time for
    both the corpus numbers and the scores."""
    source = r.table("documents") if docs is None else docs
    return stage(search.text_stats(source, TERMS, extra), "text-stats")


@query("bm25_score", "doc_id:i bm25:6", f"SELECT * FROM ({BM25}) AS scored_docs WHERE bm25 > 0")
def bm25_score(r: Retail) -> DataFrame:
    return search.bm25(note_stats(r), TERMS).where(F.col("bm25") > 0)


def note_index(r: Retail) -> postings.Index:
    return postings.build(r.table("documents"), "doc_id", F.col("text"), scratch_dir(r.spark, "note-index"))


@query("bm25_postings", "doc_id:i bm25:6", f"SELECT * FROM ({BM25}) AS scored_docs WHERE bm25 > 0")
def bm25_postings(r: Retail) -> DataFrame:
    """The scores of bm25_score from the postings of the query's terms."""
    return postings.bm25(note_index(r), TERMS).withColumnRenamed("doc", "doc_id")


@query("bm25_topk", "doc_id:i bm25:6",
       f"SELECT * FROM ({BM25}) AS scored_docs WHERE bm25 > 0 ORDER BY ROUND(bm25, 9) DESC, doc_id LIMIT 20")
def bm25_topk(r: Retail) -> DataFrame:
    """The best twenty documents; blocks that cannot hold one are not read."""
    return postings.bm25_topk(note_index(r), TERMS, 20).withColumnRenamed("doc", "doc_id")


@query("fulltext_postings",
       "product_id:i product_name:s category:s price_usd:2 on_hand_units:i rank:6",
       _and_match(["cold", "ring", "weather"], "LIMIT 10"))
def fulltext_postings(r: Retail) -> DataFrame:
    """The products of fulltext_search from postings, from the rarest word on."""
    catalog = stage(search.product_catalog(r.position_by_product), "catalog")
    text = F.concat_ws(" ", "product_name", "description")
    index = postings.build(catalog, "product_id", text, scratch_dir(r.spark, "product-index"))
    found = postings.every_term(index, search.query_terms(PRODUCT_QUERY))
    best = found.select(F.col("doc").alias("product_id"), (F.col("hits") / F.col("length")).alias("rank"))
    best = best.orderBy(F.desc("rank"), "product_id").limit(10)
    return catalog.join(F.broadcast(best), "product_id").withColumn("on_hand_units", F.coalesce("most_on_hand", F.lit(0)))


COSINE = """list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"""


def wanted_vector(r: Retail) -> Column:
    vectors = r.table("embeddings")
    return vectors.where(F.col("vec_id") == 0).select("embedding").scalar()


@query("cosine_topk", "doc_id:i similarity:5",
       f"SELECT vec_id AS doc_id, {COSINE} AS similarity FROM embeddings ORDER BY similarity DESC, doc_id LIMIT 8")
def cosine_topk(r: Retail) -> DataFrame:
    vectors = r.table("embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.cosine_topk(vectors, wanted_vector(r), 8)


@query("hybrid_search", "doc_id:i bm25:5 similarity:5 hybrid_score:4",
       f"""SELECT * FROM (SELECT s.doc_id, s.bm25, v.similarity,
  ROUND(0.4::DOUBLE * (s.bm25 / NULLIF((SELECT MAX(bm25) FROM ({BM25}) AS top_docs), 0)) + 0.6::DOUBLE * v.similarity, 4) AS hybrid_score
FROM ({BM25}) s JOIN (SELECT vec_id AS doc_id, {COSINE} AS similarity FROM embeddings) v ON v.doc_id = s.doc_id) AS blended
WHERE hybrid_score > 0.2 ORDER BY hybrid_score DESC, doc_id LIMIT 8""")
def hybrid_search(r: Retail) -> DataFrame:
    vectors = r.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    scored = search.bm25(note_stats(r), TERMS).join(vectors, "doc_id", "left")
    return search.hybrid_search(scored, wanted_vector(r))


@query("note_search", "store_id:i product_id:i on_hand_units:i merch_note_text:s",
       """SELECT * FROM current_stock WHERE merch_note_text LIKE '%no movement%' OR merch_note_text LIKE '%full racks%'""")
def note_search(r: Retail) -> DataFrame:
    from shelfwise.operators.position import current_snapshot

    return search.note_search(
        current_snapshot(r.silver_inventory, r.newest), ["no movement", "full racks"]
    )


@query("python_classifier", "merch_note_text:s markdown_risk_score:1", "SELECT * FROM note_flags")
def python_classifier(r: Retail) -> DataFrame:
    return silver.note_flags(r.inventory, classify_batch)


# ---- guards and personal data

# Fixed values, written out as above.
ALL_DATA = (
    "all customers|every account|entire dataset|read everything|unfiltered|no filter|select \\*|list all customers|"
    "all rows|entire table|all data|every record|dump the table"
)
KEYWORDS = """regexp_matches(lower(prompt), 'select \\*|select all rows|all data|entire table|dump the table|every record|'
  || 'read all rows|all rows from|select everything|no where clause')"""


@query("guard_all_data", "event_id:i blocked:b",
       f"SELECT event_id, regexp_matches(lower(prompt), '{ALL_DATA}') AS blocked FROM gateway_log")
def guard_all_data(r: Retail) -> DataFrame:
    return r.gateway_log.withColumn("blocked", guard.blocks_all_data(F.col("prompt")))


@query("sql_udf_guard", "event_id:i blocked:b",
       f"SELECT event_id, regexp_matches(lower(prompt), '{ALL_DATA}') AS blocked FROM gateway_log")
def sql_udf_guard(r: Retail) -> DataFrame:
    guard.register_guard(r.spark)
    return r.gateway_log.withColumn("blocked", F.expr(f"{guard.GUARD_FUNCTION}(prompt)"))


@query("guard_keywords", "event_id:i blocked:b", f"SELECT event_id, {KEYWORDS} AS blocked FROM gateway_log")
def guard_keywords(r: Retail) -> DataFrame:
    return r.gateway_log.withColumn("blocked", guard.blocks_keywords(F.col("prompt")))


@query("guard_conversations", "role:s turns:i all_data:i keywords:i",
       f"""SELECT role, COUNT(*) AS turns, COUNT(*) FILTER (WHERE regexp_matches(lower(prompt), '{ALL_DATA}')) AS all_data,
  COUNT(*) FILTER (WHERE {KEYWORDS}) AS keywords FROM (SELECT role, text AS prompt FROM conversations) AS prompts GROUP BY role""")
def guard_conversations(r: Retail) -> DataFrame:
    text = F.col("content")
    return r.messages.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(guard.blocks_all_data(text)).alias("all_data"),
        F.count_if(guard.blocks_keywords(text)).alias("keywords"),
    )


_TAGS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL_ADDRESS>"),
    ("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "<CREDIT_CARD>"),
    ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "[SSN_REDACTED]"),
]
_PII = " OR ".join(f"regexp_matches(text, '{p}')" for p, _ in _TAGS)
_REDACTED = "text"
for _pattern, _tag in _TAGS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_tag}', 'g')"


@query("pii_flag", "doc_id:i has_pii:b", f"SELECT doc_id, {_PII} AS has_pii FROM documents")
def pii_flag(r: Retail) -> DataFrame:
    return r.table("documents").withColumn("has_pii", guard.has_pii(F.col("text")))


@query("pii_redact", "doc_id:i digest:s",
       f"SELECT doc_id, md5({_REDACTED}) AS digest FROM documents WHERE {_PII}")
def pii_redact(r: Retail) -> DataFrame:
    text = F.col("text")
    found = r.table("documents").where(guard.has_pii(text))
    return found.withColumn("digest", F.md5(guard.redact(text)))


@query("pii_redact_conversations", "conversation_id:i position:i digest:s",
       f"""SELECT conv_id AS conversation_id, turn AS position, md5({_REDACTED}) AS digest FROM conversations""")
def pii_redact_conversations(r: Retail) -> DataFrame:
    return r.messages.withColumn("digest", F.md5(guard.redact(F.col("content"))))


# ---- model-call log


@query("gateway_outcome", "event_id:i outcome:s", "SELECT event_id, outcome FROM call_outcomes")
def gateway_outcome(r: Retail) -> DataFrame:
    return r.gateway_log.withColumn("outcome", guard.call_outcome(F.col("response")))


_BLOCKS = """COUNT(*) FILTER (WHERE response LIKE '%REQUEST_LIMIT_EXCEEDED%') AS threshold_blocks,
  COUNT(*) FILTER (WHERE response LIKE '%guardrail%') AS guardrail_blocks"""


@query("gateway_usage_by_requester", "requester:s calls:i threshold_blocks:i guardrail_blocks:i",
       f"SELECT requester, COUNT(*) AS calls, {_BLOCKS} FROM gateway_log GROUP BY requester")
def gateway_usage_by_requester(r: Retail) -> DataFrame:
    return gateway.usage_by_requester(r.gateway_log).orderBy(F.desc("calls"), "requester")


@query("gateway_totals", "total_calls:i principals:i threshold_blocks:i guardrail_blocks:i",
       f"SELECT COUNT(*) AS total_calls, COUNT(DISTINCT requester) AS principals, {_BLOCKS} FROM gateway_log")
def gateway_totals(r: Retail) -> DataFrame:
    return gateway.totals(r.gateway_log)


@query("gateway_principals_by_month", "month:d calls:i principals:i close:b",
       """SELECT date_trunc('month', request_time) AS month, COUNT(*) AS calls, COUNT(DISTINCT requester) AS principals, TRUE AS close
FROM gateway_log GROUP BY 1""")
def gateway_principals_by_month(r: Retail) -> DataFrame:
    """Sketches per day, united to months; the estimates beside exact counts, close: within 2 %."""
    month = F.trunc("day", "month")
    days = sketches.daily_sketches(r.gateway_log, F.col("request_time"), ["requester"])
    guess = sketches.united(days, ["requester"], month, "month").select("month", F.col("requester").alias("guess"))
    exact = r.gateway_log.groupBy(F.trunc(F.col("request_time").cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("requester").alias("principals")
    )
    return exact.join(guess, "month").withColumn("close", sketches.within(F.col("guess"), F.col("principals"), 0.02))


@query("llm_tokens_by_requester", "requester:s calls:i total_tokens:i",
       """SELECT requester, COUNT(*) AS calls,
  COALESCE(SUM(CAST(json_extract_string(response, '$.usage.total_tokens') AS BIGINT)), 0) AS total_tokens
FROM gateway_log GROUP BY requester""")
def tokens_by_requester(r: Retail) -> DataFrame:
    return gateway.tokens_by_requester(r.gateway_log)


@query("outcomes_per_minute", "minute:t outcome:s n:i",
       "SELECT date_trunc('minute', request_time) AS minute, outcome, COUNT(*) AS n FROM call_outcomes GROUP BY 1, 2")
def outcomes_per_minute(r: Retail) -> DataFrame:
    return gateway.outcomes_per_minute(r.gateway_log)


@query("rate_limit_windows", "window_start:t calls:i refused:i",
       """SELECT date_trunc('minute', request_time) AS window_start, COUNT(*) AS calls, COUNT(*) - 2 AS refused
FROM gateway_log GROUP BY 1 HAVING COUNT(*) > 2""")
def rate_limit_windows(r: Retail) -> DataFrame:
    return gateway.windows_over_limit(r.gateway_log, 2, [])


@query("rate_limit_refused_calls", "event_id:i requester:s window_start:t",
       """SELECT * FROM (SELECT *, date_trunc('hour', request_time) AS window_start, ROW_NUMBER() OVER (
    PARTITION BY requester, date_trunc('hour', request_time) ORDER BY request_time, event_id) AS place
  FROM gateway_log) AS placed WHERE place > 1""")
def rate_limit_refused_calls(r: Retail) -> DataFrame:
    return gateway.refused_calls(r.gateway_log, 1, ["requester"], "hour")


@query("gateway_cost_by_store", "store_id:i requesters:i calls:i call_share:4",
       """SELECT store_id, COUNT(*) AS requesters, SUM(calls) AS calls, SUM(CAST(calls AS DOUBLE) / stores) AS call_share
FROM (SELECT DISTINCT approved_by AS requester, store_id FROM actions WHERE approved_by IS NOT NULL) a
JOIN (SELECT requester, COUNT(*) AS calls FROM gateway_log GROUP BY requester) c ON c.requester = a.requester
JOIN (SELECT approved_by AS requester, COUNT(DISTINCT store_id) AS stores FROM actions GROUP BY 1) n ON n.requester = a.requester
GROUP BY store_id""")
def gateway_cost_by_store(r: Retail) -> DataFrame:
    return gateway.cost_by_store(r.gateway_log, r.actions)


# ---- conversations


@query("conversation_list", "user_email:s conversation_id:i title:s updated_at:t", "SELECT * FROM conversation_heads")
def conversation_list(r: Retail) -> DataFrame:
    return chat.conversation_list(r.heads)


@query("message_positions", "conversation_id:i position:i role:s",
       """SELECT conversation_id, role, ROW_NUMBER() OVER (PARTITION BY conversation_id ORDER BY position)
  + (SELECT COALESCE(MAX(m.position), -1) FROM messages m WHERE m.conversation_id = n.conversation_id) AS position
FROM messages n""")
def message_positions(r: Retail) -> DataFrame:
    """Every conversation is continued with a copy of itself."""
    new = r.messages.withColumnRenamed("position", "arrival")
    return chat.append_positions(r.messages, new, "arrival")


@query("conversation_with_messages", "conversation_id:i title:s position:i role:s content:s",
       """SELECT m.*, h.title FROM messages m JOIN conversation_heads h ON h.conversation_id = m.conversation_id""")
def conversation_with_messages(r: Retail) -> DataFrame:
    nested = chat.with_messages(r.heads, r.messages)
    return nested.select("conversation_id", "title", F.explode("messages").alias("m")).select(
        "conversation_id", "title", "m.*"
    )


@query("get_or_create_singleton", "user_email:s conversation_id:i title:s created:b",
       """SELECT u.user_email, COALESCE(d.conversation_id, -1 - CAST('0x' || LEFT(md5(u.user_email), 15) AS BIGINT)) AS conversation_id,
  COALESCE(h.title, 'Assistant') AS title, d.conversation_id IS NULL AS created
FROM (SELECT DISTINCT user_email FROM conversation_heads) u
LEFT JOIN (SELECT user_email, MIN(conversation_id) AS conversation_id FROM conversation_heads
  WHERE kind = 'demo_dock' GROUP BY user_email) d ON d.user_email = u.user_email
LEFT JOIN conversation_heads h ON h.conversation_id = d.conversation_id""")
def get_or_create_singleton(r: Retail) -> DataFrame:
    return chat.get_or_create_dock(r.heads, r.heads.select("user_email"))


@query("cascade_delete", "dataset:s row_count:i",
       """SELECT 'conversations' AS dataset, COUNT(*) AS row_count FROM conversation_heads WHERE kind <> 'demo_dock'
UNION ALL SELECT 'messages', COUNT(*) FROM messages m JOIN conversation_heads h ON h.conversation_id = m.conversation_id WHERE kind <> 'demo_dock'
UNION ALL SELECT 'feedback', COUNT(*) FROM feedback f JOIN conversation_heads h ON h.conversation_id = f.conversation_id WHERE kind <> 'demo_dock'""")
def cascade_delete(r: Retail) -> DataFrame:
    from shelfwise.sources.tables import row_counts

    own = r.heads.where(F.col("kind") == "demo_dock").select("user_email", "conversation_id")
    foreign = r.heads.where(F.col("kind") != "demo_dock").select(
        F.lit("somebody_else").alias("user_email"), "conversation_id"
    )
    return row_counts(chat.cascade_delete(own.unionByName(foreign), r.heads, r.messages, r.feedback))


@query("rename_if_default", "conversation_id:i title:s",
       """SELECT conversation_id, CASE WHEN title = 'New conversation' THEN CONCAT('About ', user_email) ELSE title END AS title
FROM conversation_heads""")
def rename_if_default(r: Retail) -> DataFrame:
    return chat.rename_if_default(r.heads, F.concat(F.lit("About "), F.col("user_email")))


@query("feedback_summary", "conversation_id:i up:i down:i",
       """SELECT conversation_id, COUNT(*) FILTER (WHERE value = 'up') AS up, COUNT(*) FILTER (WHERE value = 'down') AS down
FROM feedback GROUP BY conversation_id""")
def feedback_summary(r: Retail) -> DataFrame:
    return chat.feedback_summary(r.feedback)


@query("tool_trace_unnest", "conversation_id:i position:i call_id:s name:s args:s output:s",
       """SELECT conversation_id, position, CONCAT(conversation_id, '-', position) AS call_id,
  CASE WHEN position % 4 = 1 THEN 'find_shortfall' ELSE 'rank_recovery_moves' END AS name, '{}' AS args,
  CONCAT('rows=', position) AS output FROM messages WHERE role = 'assistant'""")
def tool_trace_unnest(r: Retail) -> DataFrame:
    return chat.tool_trace(fx.thinking(r.messages)).withColumnRenamed("callId", "call_id")


TRIGGERS = {2: ["short", "the thing", "tion the"], 3: ["transfer", "recover", "license"]}


@query("script_trigger", "conversation_id:i position:i step:i",
       " UNION ALL ".join(
           f"SELECT conversation_id, position, {step} AS step FROM messages WHERE role = 'assistant' AND ("
           + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"
           for step, words in TRIGGERS.items()
       ))
def script_trigger(r: Retail) -> DataFrame:
    return chat.script_steps(r.messages, TRIGGERS)


# ---- change feed


@query("changelog_current", "id:i lsn:i change_ts:t change_type:s status:s",
       """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY lsn DESC, sort_by DESC) AS rn
FROM changelog WHERE change_type <> 'update_preimage') AS newest WHERE rn = 1 AND change_type <> 'delete'""")
def changelog_current(r: Retail) -> DataFrame:
    return changelog.current_state(r.changelog)


@query("scd2_history", "id:i lsn:i status:s valid_from:t valid_to:t is_current:b",
       """SELECT *, valid_to IS NULL AS is_current FROM (
  SELECT id, lsn, status, change_type, change_ts AS valid_from,
    LEAD(change_ts) OVER (PARTITION BY id ORDER BY lsn, sort_by) AS valid_to
  FROM changelog WHERE change_type <> 'update_preimage') AS intervals WHERE change_type <> 'delete'""")
def scd2_history(r: Retail) -> DataFrame:
    return changelog.history(r.changelog, lsn_per_bucket=1_000)
