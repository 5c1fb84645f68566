"""Write-back as batch jobs: approvals, decision events, audit trail, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.scratch import stage

KEY = ["store_id", "product_id"]
ACTION_COLUMNS = [
    "id", *KEY, "move_type", "source_store_id", "units", "drafted_request", "predicted_recaptured_usd",
    "status", "approved_by", "audit_trail", "created_at", "decided_at",
]


def _action_id(move: Column, store: Column, at: Column) -> Column:
    """Deterministic id, so that a rerun of the job writes the same rows."""
    return F.md5(F.concat_ws("|", store, "product_id", move, F.date_format(at, "yyyy-MM-dd HH:mm:ss")))


def _entry(at: Column, by: Column, action: str, notes: Column) -> Column:
    return F.array(
        F.struct(
            at.alias("at"), by.alias("by"), F.lit(action).alias("action"), notes.alias("notes"),
            F.lit("execute_recovery_action").alias("tool"),
        )
    )


def apply_approvals(approvals: DataFrame, at: Column) -> DataFrame:
    """Action rows of approved moves, and for every transfer with a source a markdown hold on the
    source store. Approvals carry store, product, move_type, units, source_store_id,
    drafted_request, predicted_recaptured_usd, user_email."""
    who, source, store = F.col("user_email"), F.col("source_store_id"), F.col("store_id")
    hold_move = F.lit("markdown_hold")
    hold_note = F.concat(
        F.lit("Markdown hold on surplus feeding "), store.cast("string"), F.lit(" transfer")
    )
    primary = F.struct(
        _action_id(F.col("move_type"), store, at).alias("id"),
        store.alias("store_id"),
        F.col("move_type").alias("move_type"),
        source.alias("source_store_id"),
        F.col("units").cast("bigint").alias("units"),
        F.col("drafted_request").alias("drafted_request"),
        F.col("predicted_recaptured_usd").cast("double").alias("predicted_recaptured_usd"),
        _entry(at, who, "approved", F.lit("Recovery move recorded")).alias("audit_trail"),
    )
    hold = F.struct(
        _action_id(hold_move, source, at).alias("id"),
        source.alias("store_id"),
        hold_move.alias("move_type"),
        store.alias("source_store_id"),
        F.lit(0).cast("bigint").alias("units"),
        hold_note.alias("drafted_request"),
        F.lit(0.0).alias("predicted_recaptured_usd"),
        _entry(at, who, "markdown_hold", hold_note).alias("audit_trail"),
    )
    paired = (F.col("move_type") == "transfer") & source.isNotNull()
    records = F.explode(F.when(paired, F.array(primary, hold)).otherwise(F.array(primary))).alias("a")
    return approvals.select("product_id", who.alias("approved_by"), records).select(
        F.col("a.id").alias("id"), F.col("a.store_id").alias("store_id"), "product_id", "a.move_type",
        "a.source_store_id", "a.units", "a.drafted_request", "a.predicted_recaptured_usd",
        F.lit("approved").alias("status"), "approved_by", "a.audit_trail",
        at.alias("created_at"), at.alias("decided_at"),
    )


def decision_events(approvals: DataFrame, at: Column) -> DataFrame:
    """One event per approved move, with the decision as JSON payload."""
    paired = (F.col("move_type") == "transfer") & F.col("source_store_id").isNotNull()
    hold_id = F.when(paired, _action_id(F.lit("markdown_hold"), F.col("source_store_id"), at))
    payload = F.to_json(
        F.struct(
            "move_type", "units", "source_store_id", "predicted_recaptured_usd",
            F.col("user_email").alias("approved_by"), hold_id.alias("markdown_hold_id"),
        )
    )
    return approvals.select(
        F.lit("decision_committed").alias("event_type"), F.lit("user").alias("source"), *KEY,
        _action_id(F.col("move_type"), F.col("store_id"), at).alias("action_id"),
        payload.alias("payload"), at.alias("created_at"),
    )


def view_scored_events(score: DataFrame, source: str, at: Column) -> DataFrame:
    """The scored view as an event; the source is ``system`` at start, else ``schedule``."""
    return score.select(
        F.lit("view_scored").alias("event_type"), F.lit(source).alias("source"), *KEY,
        F.lit(None).cast("string").alias("action_id"), "payload", at.alias("created_at"),
    )


def append_audit(actions: DataFrame, keep: Column, entry: Column) -> DataFrame:
    """Add an entry to the audit trail of the kept actions."""
    grown = F.when(keep, F.array_append("audit_trail", entry)).otherwise(F.col("audit_trail"))
    return actions.withColumn("audit_trail", grown)


def audit_timeline(actions: DataFrame) -> DataFrame:
    """One row per audit entry."""
    return actions.select(
        F.col("id").alias("action_id"), *KEY, F.posexplode("audit_trail").alias("entry", "audit")
    ).select("action_id", *KEY, "entry", "audit.*")


def action_audit(actions: DataFrame, audit: DataFrame) -> DataFrame:
    """Actions with their audit rows, oldest first."""
    facts = actions.select(F.col("id").alias("action_id"), "move_type", "status", "units")
    return facts.join(audit, "action_id").orderBy("at", "action_id", "entry")


def transition(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """Set a new status where the current one is still the expected one. Requests: id,
    expected, wanted, by (one per id)."""
    current = F.col("status") == F.col("expected")
    return (
        actions.join(requests, "id", "left")
        .withColumn("changed", F.coalesce(current, F.lit(False)))
        .withColumn("status", F.when(F.col("changed"), F.col("wanted")).otherwise(F.col("status")))
        .withColumn("approved_by", F.when(F.col("changed"), F.col("by")).otherwise(F.col("approved_by")))
        .drop("expected", "wanted", "by")
    )


ACTION_PARTS = 64


def action_part() -> Column:
    """The folder of an action in a kept table: by its id, so that no store or day fills one."""
    return F.pmod(F.xxhash64("id"), F.lit(ACTION_PARTS)).cast("int")


def keep_actions(actions: DataFrame, path: str) -> None:
    """Write the actions as a table that transition_in_place() can change."""
    actions.withColumn("part", action_part()).write.mode("overwrite").partitionBy("part").parquet(path)


def transition_in_place(spark: SparkSession, path: str, requests: DataFrame) -> None:
    """transition() on a kept table: only the folders of the requested ids are read, and only those
    in which a status changes are written again. The new rows are staged first, so a run that fails
    before its commit leaves the table as it was, and one that runs again changes nothing more."""
    asked = stage(requests, "requests")
    parts = [r.part for r in asked.select(action_part().alias("part")).distinct().collect()]  # 64 at most
    rows = spark.read.parquet(path).where(F.col("part").isin(parts))
    new = stage(transition(rows, asked), "changed-actions")
    changed = [r.part for r in new.where("changed").select("part").distinct().collect()]
    if changed:
        rewritten = new.where(F.col("part").isin(changed)).drop("changed")
        rewritten = rewritten.repartition("part").select(*[c for c in rows.columns if c != "part"], "part")
        rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def recent_activity(actions: DataFrame, limit: int) -> DataFrame:
    at = F.coalesce("decided_at", "created_at")
    return (
        actions.withColumns(
            {"at": at, "by": F.coalesce("approved_by", F.lit("system")), "notes": F.col("drafted_request")}
        )
        .orderBy(F.desc_nulls_last("at"), "id")
        .limit(limit)
    )


def decision_chain(
    events: DataFrame, actions: DataFrame, position: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """Event to action to position to recommendation."""
    act = actions.select(F.col("id").alias("action_id"), "move_type", "units", "status")
    where = position.select(*KEY, "store_name", "product_name", "position_status")
    advice = recommendations.select(*KEY, "recommended_move", "predicted_net_value_usd")
    return (
        events.where(F.col("event_type") == "decision_committed")
        .select(*KEY, "action_id")
        .join(act, "action_id")
        .join(where, KEY)
        .join(advice, KEY)
    )
