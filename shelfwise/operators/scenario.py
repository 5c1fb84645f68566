"""What-if work on recommendations and shortfalls; the base tables stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.recovery import KEY, MOVES, rank_options


def _money(value: Column) -> Column:
    return F.round(value, 2).cast("double")


def what_if_units(recommended: DataFrame, units: Column, move: str = "transfer") -> DataFrame:
    """Scale one move linearly to other units (its published recaptured and cost), keep the other
    moves, and rank the three anew. Transfers without a source stay as they are."""
    base = F.col(f"{move}_units") if move == "transfer" else F.col("units_needed")
    share = F.when(base > 0, units / base).otherwise(F.lit(1.0))

    def option(name: str) -> Column:
        factor = share if name == move else F.lit(1.0)
        cost = F.lit(0.0) if name == "substitute" else _money(F.col(f"{name}_cost"))
        return F.struct(
            F.lit(name).alias("move"),
            (_money(F.col(f"{name}_recaptured")) * factor).alias("recaptured"),
            (cost * factor).alias("cost"),
            (_money(F.col(f"{name}_net")) * factor).alias("net"),
        )

    ranked = recommended.select(*KEY, rank_options(F.array(*[option(m) for m in MOVES])))
    return ranked.select(*KEY, "ranked.option.*", (F.col("place") + 1).alias("move_rank"))


def demand_scenario(shortfalls: DataFrame, factors: list[float], limit: int | None = 10) -> DataFrame:
    """Exposure and urgency under demand factors, the most urgent first per factor. Urgency is
    exposure per unit on hand, or the exposure itself when there is none."""
    factor = F.explode(F.array(*[F.lit(f) for f in factors]))
    grown = F.col("lost_sales_exposure_usd") * F.col("factor")
    on_hand = F.col("on_hand_units")
    order = Window.partitionBy("factor").orderBy(F.desc_nulls_last("urgency"), *KEY)
    scored = (
        shortfalls.withColumn("factor", factor)
        .withColumn("scenario_exposure_usd", grown)
        .withColumn(
            "urgency",
            F.when(on_hand > 0, F.col("scenario_exposure_usd") / on_hand).otherwise(
                F.col("scenario_exposure_usd")
            ),
        )
    )
    if limit is None:
        return scored
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
