"""Queries of the write-back side: actions, events, audit, mirrors, scenarios, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import actions as act
from shelfwise.operators import mirror, queue, scenario
from shelfwise.operators import position as pos
from shelfwise.operators import recovery as rec
from shelfwise.plans.frames import Retail
from shelfwise.plans.registry import query
from shelfwise.sources import fixtures as fx
from shelfwise.sources import sinks, tables
from shelfwise.sources.scratch import scratch_dir, stage

AT = "2024-02-01 08:00:00"
OPEN = "position_status IN ('stockout', 'at_risk')"
WORST = "ORDER BY lost_sales_exposure_usd DESC NULLS LAST, store_id, product_id"


def at() -> Column:
    return F.lit(AT).cast("timestamp")


ACTION_SPEC = (
    "id:s store_id:i product_id:i move_type:s source_store_id:i units:i drafted_request:s "
    "predicted_recaptured_usd:2 status:s approved_by:s created_at:t decided_at:t"
)


@query("latest_action", ACTION_SPEC, "SELECT * FROM latest_actions")
def latest_action(r: Retail) -> DataFrame:
    return queue.latest_actions(r.actions)


@query("distinct_keys", "store_id:i product_id:i", "SELECT * FROM acted_keys")
def distinct_keys(r: Retail) -> DataFrame:
    return queue.acted_keys(r.actions)


@query("acted_anti", "store_id:i product_id:i position_status:s lost_sales_exposure_usd:2",
       f"""SELECT p.* FROM positions p LEFT JOIN acted_keys a ON a.store_id = p.store_id AND a.product_id = p.product_id
WHERE {OPEN} AND a.store_id IS NULL""")
def acted_anti(r: Retail) -> DataFrame:
    return r.flagged.where(pos.is_open()).join(queue.acted_keys(r.actions), queue.KEY, "left_anti")


@query("acted_semi", "store_id:i product_id:i position_status:s lost_sales_exposure_usd:2",
       f"""SELECT p.* FROM positions p JOIN acted_keys a ON a.store_id = p.store_id AND a.product_id = p.product_id
WHERE {OPEN}""")
def acted_semi(r: Retail) -> DataFrame:
    return r.flagged.where(pos.is_open()).join(queue.acted_keys(r.actions), queue.KEY, "left_semi")


@query("action_audit_join",
       "action_id:s store_id:i product_id:i move_type:s status:s units:i entry:i at:t by:s action:s tool:s",
       "SELECT u.*, a.move_type, a.status, a.units FROM audit u JOIN actions a ON a.id = u.action_id")
def action_audit_join(r: Retail) -> DataFrame:
    return act.action_audit(r.actions, act.audit_timeline(r.actions))


@query("recent_activity",
       "id:s store_id:i product_id:i at:t by:s move_type:s status:s units:i predicted_recaptured_usd:2 notes:s",
       """SELECT *, COALESCE(decided_at, created_at) AS "at", COALESCE(approved_by, 'system') AS "by", drafted_request AS notes
FROM actions ORDER BY COALESCE(decided_at, created_at) DESC NULLS LAST, id LIMIT 20""")
def recent_activity(r: Retail) -> DataFrame:
    return act.recent_activity(r.actions, queue.clamp_limit(None, 20, 100))


@query("action_timeline", "action_id:s store_id:i product_id:i entry:i at:t by:s action:s tool:s",
       "SELECT * FROM audit")
def action_timeline(r: Retail) -> DataFrame:
    return act.audit_timeline(r.actions).orderBy(F.desc("at"), "action_id", "entry")


@query("audit_append", "action_id:s store_id:i product_id:i entry:i at:t by:s action:s tool:s",
       f"""SELECT action_id, store_id, product_id, entry, "at", "by", action, tool FROM audit
UNION ALL SELECT id, store_id, product_id, 2, TIMESTAMP '{AT}', 'ops_lead', 'executed', 'warehouse' FROM actions
WHERE status = 'approved' AND move_type <> 'markdown_hold'""")
def audit_append(r: Retail) -> DataFrame:
    entry = F.struct(
        at().alias("at"), F.lit("ops_lead").alias("by"), F.lit("executed").alias("action"),
        F.lit("warehouse").alias("tool"),
    )
    keep = (F.col("status") == "approved") & (F.col("move_type") != "markdown_hold")
    return act.audit_timeline(act.append_audit(r.actions, keep, entry))


@query("status_transition", "id:s status:s approved_by:s changed:b",
       """SELECT id, CASE WHEN status = 'proposed' THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'proposed' THEN 'ops_lead' ELSE approved_by END AS approved_by, status = 'proposed' AS changed
FROM actions""")
def status_transition(r: Retail) -> DataFrame:
    requests = r.actions.select(
        "id", F.lit("proposed").alias("expected"), F.lit("approved").alias("wanted"), F.lit("ops_lead").alias("by")
    )
    return act.transition(r.actions, requests)


@query("status_transition_in_place", "id:s status:s approved_by:s",
       """SELECT id, CASE WHEN status = 'proposed' AND product_id % 5 = 0 THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'proposed' AND product_id % 5 = 0 THEN 'ops_lead' ELSE approved_by END AS approved_by FROM actions""")
def status_transition_in_place(r: Retail) -> DataFrame:
    """A kept table of actions after requests for some of them, and the same requests again."""
    path = scratch_dir(r.spark, "kept-actions")
    act.keep_actions(r.actions, path)
    requests = r.actions.where(F.col("product_id") % 5 == 0).select(
        "id", F.lit("proposed").alias("expected"), F.lit("approved").alias("wanted"), F.lit("ops_lead").alias("by")
    )
    for _ in range(2):
        act.transition_in_place(r.spark, path, requests)
    return r.spark.read.parquet(path)


def approvals(recommended: DataFrame) -> DataFrame:
    """Every recommendation approved by the manager of its store."""
    return recommended.select(
        "store_id", "product_id", F.col("recommended_move").alias("move_type"),
        F.col("recommended_units").alias("units"),
        F.col("nearest_surplus_store_id").alias("source_store_id"),
        F.concat_ws(" ", "recommended_move", "recommended_units", F.lit("units")).alias("drafted_request"),
        "predicted_recaptured_usd",
        F.concat(F.lit("manager_"), F.col("store_id").cast("string")).alias("user_email"),
    )


_ID = f"md5(CONCAT({{store}}, '|', product_id, '|', {{move}}, '|', '{AT}'))"
_MAIN_ID = _ID.format(store="store_id", move="recommended_move")
_HOLD_ID = _ID.format(store="nearest_surplus_store_id", move="'markdown_hold'")
_PAIRED = "recommended_move = 'transfer' AND nearest_surplus_store_id IS NOT NULL"
_APPROVED = f"""
SELECT {_MAIN_ID} AS id, store_id, product_id, recommended_move AS move_type, nearest_surplus_store_id AS source_store_id,
  recommended_units AS units, CONCAT(recommended_move, ' ', recommended_units, ' units') AS drafted_request,
  predicted_recaptured_usd, 'approved' AS status, CONCAT('manager_', store_id) AS approved_by,
  TIMESTAMP '{AT}' AS created_at, TIMESTAMP '{AT}' AS decided_at, 'approved' AS audit_action
FROM recommended
UNION ALL
SELECT {_HOLD_ID}, nearest_surplus_store_id, product_id, 'markdown_hold', store_id, 0,
  CONCAT('Markdown hold on surplus feeding ', store_id, ' transfer'), 0, 'approved', CONCAT('manager_', store_id),
  TIMESTAMP '{AT}', TIMESTAMP '{AT}', 'markdown_hold'
FROM recommended WHERE {_PAIRED}"""


@query("apply_approvals", ACTION_SPEC + " audit_action:s", _APPROVED)
def apply_approvals(r: Retail) -> DataFrame:
    rows = act.apply_approvals(approvals(r.recommended), at())
    return rows.withColumn("audit_action", F.element_at("audit_trail", 1)["action"])


@query("decision_events",
       "event_type:s source:s store_id:i product_id:i action_id:s move_type:s units:i source_store_id:i "
       "approved_by:s markdown_hold_id:s",
       f"""SELECT 'decision_committed' AS event_type, 'user' AS source, store_id, product_id, {_MAIN_ID} AS action_id,
  recommended_move AS move_type, recommended_units AS units, nearest_surplus_store_id AS source_store_id,
  CONCAT('manager_', store_id) AS approved_by, CASE WHEN {_PAIRED} THEN {_HOLD_ID} END AS markdown_hold_id
FROM recommended""")
def decision_events(r: Retail) -> DataFrame:
    names = ["move_type", "units", "source_store_id", "approved_by", "markdown_hold_id"]
    return act.decision_events(approvals(r.recommended), at()).select(
        "event_type", "source", "store_id", "product_id", "action_id", F.json_tuple("payload", *names).alias(*names)
    )


@query("view_scored_event",
       "event_type:s source:s store_id:i product_id:i action_id:s open_shortfall_count:i created_at:t",
       f"""SELECT 'view_scored' AS event_type, 'schedule' AS source, store_id, product_id, NULL AS action_id,
  (SELECT COUNT(*) FROM positions WHERE {OPEN}) AS open_shortfall_count, TIMESTAMP '{AT}' AS created_at
FROM positions WHERE {OPEN} {WORST} LIMIT 1""")
def view_scored_event(r: Retail) -> DataFrame:
    events = act.view_scored_events(queue.view_score(r.flagged), "schedule", at())
    count = F.get_json_object("payload", "$.open_shortfall_count")
    return events.withColumn("open_shortfall_count", count)


@query("decision_chain",
       "store_id:i product_id:i action_id:s move_type:s units:i status:s store_name:s product_name:s "
       "position_status:s recommended_move:s predicted_net_value_usd:2",
       f"""SELECT r.store_id, r.product_id, {_ID.format(store='r.store_id', move='recommended_move').replace(" product_id,", " r.product_id,")} AS action_id, recommended_move AS move_type,
  recommended_units AS units, 'approved' AS status, p.store_name, p.product_name, p.position_status, recommended_move,
  predicted_net_value_usd
FROM recommended r JOIN positions p ON p.store_id = r.store_id AND p.product_id = r.product_id""")
def decision_chain(r: Retail) -> DataFrame:
    made = approvals(r.recommended_table)
    return act.decision_chain(
        act.decision_events(made, at()), act.apply_approvals(made, at()), r.flagged, r.recommended_table
    )


# ---- scenarios and priorities


@query("what_if_units", "store_id:i product_id:i move:s recaptured:9 cost:9 net:9 move_rank:i", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, product_id ORDER BY net DESC, listed) AS move_rank FROM (
  SELECT o.store_id, o.product_id, o.listed, o.move, o.recaptured * f AS recaptured, o.cost * f AS cost, o.net * f AS net
  FROM (SELECT m.*, CASE WHEN m.move = 'transfer' AND s.transfer_units > 0
      THEN CAST(50 AS DOUBLE) / s.transfer_units ELSE CAST(1 AS DOUBLE) END AS f
    FROM move_options m JOIN scored s ON s.store_id = m.store_id AND s.product_id = m.product_id) o
) AS scaled""")
def what_if_units(r: Retail) -> DataFrame:
    return scenario.what_if_units(r.recommended, F.lit(50.0))


@query("demand_scenario",
       "factor:1 place:i store_id:i product_id:i lost_sales_exposure_usd:2 scenario_exposure_usd:2 urgency:2",
       """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY urgency DESC NULLS LAST, store_id, product_id) AS place
FROM (SELECT *, CAST(lost_sales_exposure_usd AS DOUBLE) * factor AS scenario_exposure_usd,
    CASE WHEN on_hand_units > 0 THEN CAST(lost_sales_exposure_usd AS DOUBLE) * factor / on_hand_units
      ELSE CAST(lost_sales_exposure_usd AS DOUBLE) * factor END AS urgency
  FROM shortfalls CROSS JOIN (SELECT unnest([1.5, 2.0, 3.0])::DOUBLE AS factor) AS factors) AS scaled) AS placed
WHERE place <= 10""")
def demand_scenario(r: Retail) -> DataFrame:
    return scenario.demand_scenario(r.shortfalls, [1.5, 2.0, 3.0])


_BAND = """CASE WHEN predicted_recaptured_usd >= 2000 THEN 1 WHEN predicted_recaptured_usd >= 1000 THEN 2
  WHEN predicted_recaptured_usd >= 500 THEN 3 WHEN predicted_recaptured_usd >= 100 THEN 4 ELSE 5 END"""


@query("priority_band", "store_id:i product_id:i predicted_recaptured_usd:2 priority:i",
       f"SELECT *, {_BAND} AS priority FROM recommended")
def priority_band(r: Retail) -> DataFrame:
    banded = r.recommended.withColumn("priority", queue.priority_band(F.col("predicted_recaptured_usd")))
    return banded.orderBy("priority", F.desc("predicted_recaptured_usd"))


@query("schema_evolve_default", "id:s status:s predicted_recaptured_usd:2 default_priority:i priority:i",
       f"SELECT *, 3 AS default_priority, {_BAND} AS priority FROM actions")
def schema_evolve_default(r: Retail) -> DataFrame:
    evolved = queue.add_priority(r.actions).withColumn("default_priority", F.col("priority"))
    return queue.backfill_priority(evolved)


# ---- sources, sinks, mirrors

_RAW = ["raw_stores", "raw_products", "raw_sales", "raw_inventory", "raw_transfers", "raw_store_traffic"]
_RAW_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, COUNT(*) AS row_count FROM {n}" for n in _RAW
)


@query("scan_raw", "dataset:s row_count:i",
       " UNION ALL ".join(f"SELECT '{n}' AS dataset, COUNT(*) AS row_count FROM {n}" for n in fx.TABLES))
def scan_raw(r: Retail) -> DataFrame:
    return tables.row_counts(tables.load(r.spark, {n: fx.table_path(r.sf_dir, n) for n in fx.TABLES}))


def raw_frames(r: Retail) -> dict[str, DataFrame]:
    return dict(zip(_RAW, [r.stores, r.products, r.sales, r.inventory, r.transfers, r.traffic]))


@query("sink_overwrite", "dataset:s row_count:i", _RAW_COUNTS)
def sink_overwrite(r: Retail) -> DataFrame:
    out = None
    for name, df in raw_frames(r).items():
        counted = sinks.save(df, scratch_dir(r.spark, name), name)
        out = counted if out is None else out.unionByName(counted)
    return out


@query("sink_clustered", "product_id:i positions:i on_hand_units:i",
       "SELECT product_id, COUNT(*) AS positions, SUM(on_hand_units) AS on_hand_units FROM positions GROUP BY product_id")
def sink_clustered(r: Retail) -> DataFrame:
    path = scratch_dir(r.spark, "position-by-product")
    back = sinks.save_clustered(r.position, path, "product_id", ["store_id"])
    return back.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("on_hand_units").alias("on_hand_units")
    )


_SOLD = {
    "product": "product_id < 100",
    "year": "sale_date >= DATE '1997-01-01' AND sale_date < DATE '1998-01-01'",
    "both": "product_id BETWEEN 100 AND 300 AND sale_date >= DATE '1996-01-01' AND sale_date < DATE '1996-07-01'",
}


@query("sink_z_ordered", "filter:s row_count:i units:i",
       " UNION ALL ".join(
           f"SELECT '{n}' AS filter, COUNT(*) AS row_count, SUM(units_sold) AS units FROM silver_sales WHERE {w}"
           for n, w in _SOLD.items()
       ))
def sink_z_ordered(r: Retail) -> DataFrame:
    """Sales clustered by product and date together, read by either and by both."""
    back = sinks.save_z_ordered(r.silver_sales, scratch_dir(r.spark, "sales-z"), ["product_id", "sale_date"])
    out = None
    for name, where in _SOLD.items():
        found = back.where(where).agg(F.count(F.lit(1)).alias("row_count"), F.sum("units_sold").alias("units"))
        found = found.withColumn("filter", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query("param_table_query",
       "store_name:s city:s product_name:s on_hand:i avg_daily_velocity:2 lost_sales_exposure_usd:2",
       f"SELECT *, on_hand_units AS on_hand FROM positions WHERE {OPEN} {WORST} LIMIT 20")
def param_table_query(r: Retail) -> DataFrame:
    r.position.createOrReplaceTempView("shelfwise_positions")
    text = """
        SELECT store_name, city, product_name, on_hand_units AS on_hand, avg_daily_velocity, lost_sales_exposure_usd
        FROM IDENTIFIER(:prefix || '_positions')
        WHERE array_contains(:statuses, position_status)
        ORDER BY lost_sales_exposure_usd DESC NULLS LAST, store_id, product_id
        LIMIT 20"""
    statuses = F.array(*[F.lit(s) for s in pos.OPEN_STATUSES])
    return tables.run_sql(r.spark, text, {"prefix": "shelfwise", "statuses": statuses})


@query("snapshot_replace", "store_id:i product_id:i lost_sales_exposure_usd:2 nearest_surplus_store_id:i",
       "SELECT * FROM shortfalls")
def snapshot_replace(r: Retail) -> DataFrame:
    return sinks.snapshot(r.shortfalls, scratch_dir(r.spark, "shortfall-snapshot"), queue.KEY)


@query("snapshot_versions", "store_id:i product_id:i lost_sales_exposure_usd:2 nearest_surplus_store_id:i",
       "SELECT * FROM shortfalls")
def snapshot_versions(r: Retail) -> DataFrame:
    """A target that was replaced: first by the positions out of stock, then by all shortfalls. A
    source whose key repeats fails and changes nothing."""
    path = scratch_dir(r.spark, "shortfall-versions")
    rows = stage(r.shortfalls, "shortfalls")
    sinks.replace_version(rows.where(F.col("on_hand_units") == 0), path, queue.KEY)
    sinks.replace_version(rows, path, queue.KEY)
    try:
        sinks.replace_version(rows.unionAll(rows), path, queue.KEY)
    except ValueError:
        pass
    return sinks.read_current(r.spark, path)


@query("mirror_insert_absent", "id:s store_id:i product_id:i on_hand_units:i snapshot_date:d origin:s",
       """SELECT CONCAT(store_id, ':', product_id) AS id, store_id, product_id, on_hand_units,
  (SELECT mx FROM newest_sale) AS snapshot_date, 'kept' AS origin FROM positions WHERE position_status <> 'healthy'
UNION ALL
SELECT CONCAT(i.store_id, ':', i.product_id), i.store_id, i.product_id, i.on_hand_units, i.snapshot_date, 'inserted'
FROM raw_inventory i JOIN positions p ON p.store_id = i.store_id AND p.product_id = i.product_id
WHERE p.position_status = 'healthy' AND i.snapshot_date = (SELECT MIN(snapshot_date) FROM raw_inventory)""")
def mirror_insert_absent(r: Retail) -> DataFrame:
    target = r.flagged.select(
        "store_id", "product_id", "on_hand_units", r.newest.alias("snapshot_date"), F.lit("kept").alias("origin")
    )
    source = r.inventory.select(
        "store_id", "product_id", "on_hand_units", "snapshot_date", F.lit("inserted").alias("origin")
    )
    merged = mirror.insert_absent(target, source, queue.KEY, ["snapshot_date"])
    return merged.withColumn("id", mirror.mirror_key())


@query("mirror_normalize",
       "id:s store_id:i product_id:i price_usd:2 lost_sales_exposure_usd:2 position_status:s",
       """SELECT *, CONCAT(store_id, ':', product_id) AS id FROM (
SELECT * EXCLUDE (position_status), CASE WHEN position_status = 'at_risk' THEN 'healthy' ELSE position_status END AS position_status
FROM positions) AS known""")
def mirror_normalize(r: Retail) -> DataFrame:
    status = F.col("position_status")
    foreign = r.position.withColumn(
        "position_status", F.when(status == "at_risk", "running_low").otherwise(status)
    )
    return mirror.normalize(foreign)


@query("mirror_reset", "dataset:s row_count:i",
       """SELECT 'ops_actions' AS dataset, 0 AS row_count
UNION ALL SELECT 'messages', 0
UNION ALL SELECT 'store_sku_position', COUNT(*) FROM positions
UNION ALL SELECT 'open_shortfalls', COUNT(*) FROM shortfalls""")
def mirror_reset(r: Retail) -> DataFrame:
    after = mirror.reset(
        {"ops_actions": r.actions, "messages": r.messages},
        {"store_sku_position": r.position, "open_shortfalls": r.shortfalls},
    )
    return tables.row_counts(after)


@query("optional_source", "dataset:s row_count:i",
       """SELECT 'shelfwise_orders' AS dataset, COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'shelfwise_not_there', 0""")
def optional_source(r: Retail) -> DataFrame:
    orders = r.table("orders")
    orders.createOrReplaceTempView("shelfwise_orders")
    found = {
        name: tables.optional_table(r.spark, name, orders.schema)
        for name in ("shelfwise_orders", "shelfwise_not_there")
    }
    return tables.row_counts(found)


@query("parse_move_ranking", "kind:s texts:i moves:i",
       """SELECT 'ranking' AS kind, COUNT(*) AS texts, 3 * COUNT(*) AS moves FROM recommended
UNION ALL SELECT 'cut short', COUNT(*), 0 FROM recommended
UNION ALL SELECT 'not an array', COUNT(*), 0 FROM gateway_log""")
def parse_move_ranking(r: Retail) -> DataFrame:
    ranking = r.recommended_table.select(
        F.lit("ranking").alias("kind"), F.to_json(rec.move_ranking()).alias("text")
    )
    cut = ranking.select(F.lit("cut short").alias("kind"), F.substring("text", 1, 20).alias("text"))
    objects = r.gateway_log.select(F.lit("not an array").alias("kind"), F.col("response").alias("text"))
    parsed = tables.parse_move_ranking(F.col("text"))
    texts = ranking.unionByName(cut).unionByName(objects)
    return texts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.size(parsed)).alias("moves")
    )


@query("numeric_coerce", "product_id:i product_name:s subcategory:s price_usd:2 seasonality:s",
       "SELECT * FROM raw_products")
def numeric_coerce(r: Retail) -> DataFrame:
    as_text = r.products.select(*[F.col(c).cast("string").alias(c) for c in r.products.columns])
    return tables.coerce_numeric(as_text)


@query("union_by_name", "store_id:i product_id:i sale_date:d units_sold:i channel:s",
       """SELECT * FROM raw_sales WHERE channel = 'in_store'
UNION ALL SELECT * FROM raw_sales WHERE channel <> 'in_store'""")
def union_by_name(r: Retail) -> DataFrame:
    walk_in = r.sales.where(F.col("channel") == "in_store")
    online = r.sales.where(F.col("channel") != "in_store")
    return walk_in.unionByName(online.select(*sorted(online.columns)))
