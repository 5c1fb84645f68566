"""Data-quality checks. Each returns rows of check_name, value, pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.metrics import measure
from shelfwise.operators.position import STATUSES, is_open

ZONES = ["North", "South", "Mixed"]
KEY = ["store_id", "product_id"]


def _rows(one_row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(name).alias("check_name"), value.cast("double").alias("value"),
            F.coalesce(ok, F.lit(False)).alias("pass"),
        )
        for name, (value, ok) in checks.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def _zero(name: str) -> tuple[Column, Column]:
    return F.col(name), F.col(name) == 0


def hero_shortfall(position: DataFrame, store: Column, sku: Column) -> DataFrame:
    hero = position.where((F.col("store_id") == store) & (F.col("product_id") == sku)).agg(
        F.max("on_hand_units").alias("on_hand"), F.min("avg_daily_velocity").alias("velocity"),
        F.min((F.col("position_status") == "stockout").cast("int")).alias("stockout"),
        F.min("lost_sales_exposure_usd").alias("exposure"),
    )
    return _rows(
        hero,
        {
            "on_hand_is_zero": _zero("on_hand"),
            "velocity_positive": (F.round("velocity", 4), F.col("velocity") > 0),
            "is_stockout": (F.col("stockout"), F.col("stockout") == 1),
            "exposure_positive": (F.round("exposure", 2), F.col("exposure") > 0),
        },
    )


def surplus_covers_need(economics: DataFrame) -> DataFrame:
    sourced = F.col("nearest_surplus_store_id").isNotNull()
    covers = sourced & (F.col("nearest_surplus_on_hand") >= F.col("units_needed"))
    counts = economics.agg(F.count_if(sourced).alias("sourced"), F.count_if(covers).alias("covering"))
    return _rows(
        counts,
        {
            "shortfalls_with_source": (F.col("sourced"), F.col("sourced") > 0),
            "sources_that_cover_need": (F.col("covering"), F.col("covering") == F.col("sourced")),
        },
    )


def _share(position: DataFrame, group: Column, ok: Column) -> DataFrame:
    """Share of each status within a group; the window runs over the few counted rows."""
    counts = position.groupBy(group.alias("grp"), "position_status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("grp"))).select(
        F.concat_ws("/", "grp", "position_status").alias("check_name"),
        F.round(F.col("n") / F.col("total"), 6).alias("value"),
        ok.alias("pass"),
    )


def zone_split(position: DataFrame, affected: Column) -> DataFrame:
    """Status shares per zone among the affected products; short positions should be a minority
    of the South."""
    share = F.col("n") / F.col("total")
    ok = ~((F.col("grp") == "South") & F.col("position_status").isin("stockout", "at_risk")) | (share < 0.5)
    return _share(position.where(affected), F.col("climate_zone"), ok)


def anomaly_confined(position: DataFrame, affected: Column) -> DataFrame:
    """Status shares of affected and other products; others should be mostly healthy."""
    group = F.when(affected, "affected").otherwise("other")
    share = F.col("n") / F.col("total")
    ok = ~((F.col("grp") == "other") & (F.col("position_status") == "healthy")) | (share > 0.5)
    return _share(position, group, ok)


def exposure_band(position: DataFrame, targets: dict[str, float], width: float = 0.2) -> DataFrame:
    totals = position.agg(
        F.sum("lost_sales_exposure_usd").cast("double").alias("lost_sales"),
        F.sum("markdown_exposure_usd").cast("double").alias("markdown"),
    )
    return _rows(
        totals,
        {
            f"{name}_near_target": (
                F.round(name, 2), F.col(name).between(target * (1 - width), target * (1 + width)),
            )
            for name, target in targets.items()
        },
    )


def risk_separates(position: DataFrame) -> DataFrame:
    def mean(status: str) -> Column:
        risk = F.col("markdown_risk_score").cast("double")
        return F.round(F.avg(F.when(F.col("position_status") == status, risk)), 6)

    row = position.agg(mean("overstock").alias("overstock"), mean("healthy").alias("healthy"))
    return _rows(
        row,
        {
            "overstock_risk_high": (F.col("overstock"), F.col("overstock") >= 0.6),
            "healthy_risk_low": (F.col("healthy"), F.col("healthy") <= 0.2),
        },
    )


def note_dedup(inventory: DataFrame, flags: DataFrame) -> DataFrame:
    counts = inventory.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("merch_note_text").alias("notes")
    ).withColumn("flags", flags.agg(F.count(F.lit(1))).scalar())
    return _rows(
        counts,
        {
            "flags_match_distinct_notes": (F.col("flags"), F.col("flags") == F.col("notes")),
            "notes_far_fewer_than_rows": (F.col("notes"), F.col("notes") * 10 < F.col("rows")),
        },
    )


def outcomes_separate(outcomes: DataFrame) -> DataFrame:
    def rate(move: str) -> Column:
        value = F.col("units_moved") * F.col("price_usd").cast("double")
        return F.round(F.avg(F.when(F.col("move_type") == move, F.col("recaptured_sales_usd") / value)), 4)

    row = outcomes.agg(*[rate(m).alias(m) for m in ("transfer", "expedite", "substitute")])
    return _rows(
        row,
        {
            "transfer_beats_substitute": (F.col("transfer"), F.col("transfer") > F.col("substitute")),
            "expedite_beats_substitute": (F.col("expedite"), F.col("expedite") > F.col("substitute")),
            "substitute_lowest": (
                F.col("substitute"), F.col("substitute") < F.least("transfer", "expedite"),
            ),
        },
    )


def velocity_ramp(trend: DataFrame, max_ratio: float = 3.0) -> DataFrame:
    """The newest week must not dwarf the weeks before it. Trend: week, units_sold."""
    weekly = trend.groupBy("week").agg(F.sum("units_sold").alias("units"))
    row = weekly.agg(
        F.max_by("units", "week").cast("double").alias("last_week"),
        F.sum("units").alias("units"), F.count(F.lit(1)).alias("weeks"),
    ).withColumn("before", (F.col("units") - F.col("last_week")) / F.nullif(F.col("weeks") - 1, F.lit(0)))
    ratio = F.col("last_week") / F.nullif(F.col("before"), F.lit(0.0))
    return _rows(row, {"no_last_week_cliff": (F.round(ratio, 4), ratio <= max_ratio)})


def smoke(position: DataFrame) -> DataFrame:
    bad = {
        "bad_zone": ~F.col("climate_zone").isin(ZONES),
        "bad_geo": F.col("store_lat").isNull()
        | F.col("store_lng").isNull()
        | ~F.col("store_lat").between(-90, 90)
        | ~F.col("store_lng").between(-180, 180),
        "bad_status": ~F.col("position_status").isin(STATUSES),
        "negative_weeks": F.coalesce(F.col("weeks_of_supply") < 0, F.lit(False)),
    }
    return _rows(position.agg(*[F.count_if(c).alias(n) for n, c in bad.items()]), {n: _zero(n) for n in bad})


def pk_unique(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    row = copies.agg(F.count_if(F.col("copies") > 1).alias("repeated_keys"))
    return _rows(row, {"repeated_keys": _zero("repeated_keys")})


def metric_parity(position: DataFrame, keep: Column) -> DataFrame:
    """The metric layer and a direct sum agree on a slice."""
    layer = measure(position, [], ["lost_sales_exposure", "markdown_exposure"], keep)
    direct = position.agg(
        F.struct(
            F.sum(F.when(keep, F.col("lost_sales_exposure_usd"))).alias("lost"),
            F.sum(F.when(keep, F.col("markdown_exposure_usd"))).alias("markdown"),
        )
    ).scalar()
    return _rows(
        layer.withColumn("direct", direct).select("*", "direct.*"),
        {
            "lost_sales_parity": (
                F.round("lost_sales_exposure", 2), F.col("lost_sales_exposure").eqNullSafe(F.col("lost")),
            ),
            "markdown_parity": (
                F.round("markdown_exposure", 2), F.col("markdown_exposure").eqNullSafe(F.col("markdown")),
            ),
        },
    )


def move_mix(recommendations: DataFrame, position: DataFrame) -> DataFrame:
    moves = recommendations.agg(
        F.countDistinct("recommended_move").alias("kinds"),
        F.sum("predicted_recaptured_usd").alias("recaptured"),
    )
    lost = position.where(is_open()).agg(F.sum("lost_sales_exposure_usd").cast("double")).scalar()
    ratio = F.col("recaptured") / F.nullif(F.col("lost"), F.lit(0.0))
    return _rows(
        moves.withColumn("lost", lost),
        {
            "several_moves": (F.col("kinds"), F.col("kinds") > 1),
            "recaptured_within_exposure": (F.round(ratio, 4), ratio <= 1.0),
        },
    )


def null_scores(silver_inventory: DataFrame) -> DataFrame:
    row = silver_inventory.agg(F.count_if(F.col("markdown_risk_score").isNull()).alias("null_scores"))
    return _rows(row, {"null_scores": _zero("null_scores")})
