"""Open shortfalls, their nearest surplus, substitutes, and the three recovery moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.geo import nearest_points
from shelfwise.operators.position import HORIZON_DAYS, is_open

KEY = ["store_id", "product_id"]

# Fixed values of the move heuristic.
TRANSFER_RATE = "0.9"
TRANSFER_REACH_KM = "5000.0"
TRANSFER_BASE_COST = 60
TRANSFER_KM_COST = "1.1"
EXPEDITE_RATE = "0.82"
EXPEDITE_UNIT_COST = 9
EXPEDITE_BASE_COST = 400
SUBSTITUTE_RATE = "0.35"
UNIT_MARGIN_RATE = "0.58"
SUBSTITUTE_MARGIN_LOSS = "0.45"
SUBSTITUTE_SEASON = "cold_weather"

MOVES = ["transfer", "expedite", "substitute"]


def _one_row_per_key(position: DataFrame) -> DataFrame:
    """The worst row of a repeated store and product, by aggregation."""
    values = [c for c in position.columns if c not in KEY]
    worst = F.max_by(F.struct(*values), F.struct("lost_sales_exposure_usd", "on_hand_units")).alias("_row")
    return position.groupBy(*KEY).agg(worst).select(*KEY, "_row.*")


def shortfalls(position: DataFrame) -> DataFrame:
    return _one_row_per_key(
        position.where(is_open()).select(
            *KEY, "store_lat", "store_lng", "region", "on_hand_units", "avg_daily_velocity",
            "price_usd", "lost_sales_exposure_usd",
        )
    )


def surplus_points(position: DataFrame) -> DataFrame:
    """Overstocked stores per product and region, one row per store."""
    return (
        position.where(F.col("position_status") == "overstock")
        .groupBy(
            "product_id", "region", F.col("store_id").alias("surplus_store_id"),
            F.col("store_lat").alias("lat"), F.col("store_lng").alias("lng"),
        )
        .agg(F.max("on_hand_units").alias("surplus_on_hand"))
    )


def knn_surplus(position: DataFrame, k: int) -> DataFrame:
    """The k nearest overstocked stores of the same product and region, per open shortfall.
    A shortfall without any keeps one row of NULLs."""
    short = shortfalls(position)
    near = nearest_points(
        short.select(*KEY, "region", F.col("store_lat").alias("lat"), F.col("store_lng").alias("lng")),
        surplus_points(position),
        on=["product_id", "region"],
        probe_key=KEY,
        point_key="surplus_store_id",
        k=k,
    )
    found = near.select(
        *KEY,
        F.col("surplus_store_id").alias("nearest_surplus_store_id"),
        F.col("surplus_on_hand").alias("nearest_surplus_on_hand"),
        F.col("distance_km").alias("nearest_surplus_distance_km"),
        "nth",
    )
    return short.join(found, KEY, "left")


def open_shortfalls(position: DataFrame) -> DataFrame:
    return knn_surplus(position, 1).drop("nth")


def available_products(position: DataFrame) -> DataFrame:
    """Products with stock in at least one store."""
    return (
        position.groupBy("product_id")
        .agg(F.max("on_hand_units").alias("any_on_hand"))
        .where(F.col("any_on_hand") > 0)
    )


def substitute_candidates(products: DataFrame, available: DataFrame) -> DataFrame:
    """Products that may stand in for another one of their subcategory."""
    return (
        products.where(F.col("seasonality") == SUBSTITUTE_SEASON)
        .join(available.select("product_id"), "product_id", "left_semi")
        .select("product_id", "subcategory", "price_usd")
    )


def closest_substitutes(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per wanted (product_id, subcategory, price_usd): the other candidate of its subcategory
    with the smallest price gap, ties to the smaller id.

    Candidates shrink to their price levels, each with its two smallest ids (two, so that a
    product can skip itself). On the sorted levels the closest other price is the one before
    or the one after, so no pairs are formed.
    """
    by_level = Window.partitionBy("subcategory", "price_usd").orderBy("product_id")
    levels = (
        candidates.withColumn("_n", F.row_number().over(by_level))
        .where(F.col("_n") <= 2)
        .groupBy("subcategory", "price_usd")
        .agg(
            F.max(F.when(F.col("_n") == 1, F.col("product_id"))).alias("first_id"),
            F.max(F.when(F.col("_n") == 2, F.col("product_id"))).alias("second_id"),
        )
    )
    asked = wanted.select("subcategory", "price_usd").distinct()
    scale = levels.unionByName(asked, allowMissingColumns=True)
    scale = scale.groupBy("subcategory", "price_usd").agg(
        F.max("first_id").alias("first_id"), F.max("second_id").alias("second_id")
    )
    level = F.when(F.col("first_id").isNotNull(), F.struct(F.col("price_usd").alias("at"), "first_id"))
    rows_before = (Window.unboundedPreceding, -1)
    by_price = Window.partitionBy("subcategory")
    below = by_price.orderBy("price_usd").rowsBetween(*rows_before)
    above = by_price.orderBy(F.desc("price_usd")).rowsBetween(*rows_before)
    scale = scale.withColumn("below", F.last(level, ignorenulls=True).over(below)).withColumn(
        "above", F.last(level, ignorenulls=True).over(above)
    )
    same = F.when(F.col("first_id") != F.col("product_id"), F.col("first_id")).otherwise(F.col("second_id"))
    # array_min orders by gap, then id; absent neighbours are NULL and drop out
    options = F.array(
        F.when(same.isNotNull(), F.struct(F.lit(0).cast("double").alias("gap"), same.alias("id"))),
        F.when(
            F.col("below").isNotNull(),
            F.struct(
                (F.col("price_usd") - F.col("below.at")).cast("double").alias("gap"),
                F.col("below.first_id").alias("id"),
            ),
        ),
        F.when(
            F.col("above").isNotNull(),
            F.struct(
                (F.col("above.at") - F.col("price_usd")).cast("double").alias("gap"),
                F.col("above.first_id").alias("id"),
            ),
        ),
    )
    picked = F.array_min(F.filter(options, lambda o: o.isNotNull()))
    return (
        wanted.join(scale, ["subcategory", "price_usd"])
        .withColumn("_pick", picked)
        .where(F.col("_pick").isNotNull())
        .select(
            "product_id", "subcategory", "price_usd",
            F.col("_pick.id").alias("substitute_product_id"), F.col("_pick.gap").alias("price_gap"),
        )
    )


def substitute_pick(short: DataFrame, products: DataFrame, available: DataFrame) -> DataFrame:
    """Best substitute per shortfall; shortfalls without one do not appear."""
    wanted = (
        short.select("product_id", "price_usd")
        .distinct()
        .join(products.select("product_id", "subcategory"), "product_id")
    )
    picks = closest_substitutes(wanted, substitute_candidates(products, available))
    return short.select(*KEY, "price_usd").join(
        picks.drop("subcategory"), ["product_id", "price_usd"]
    ).drop("price_usd")


def need_units(velocity: Column) -> Column:
    return F.ceil(velocity * HORIZON_DAYS).cast("int")


def with_economics(short: DataFrame) -> DataFrame:
    """Units, recaptured sales, cost and margin loss of the three moves. Needs the shortfall
    columns with ``nearest_surplus_*``; the substitute is priced at the short product."""
    need, price = F.col("units_needed"), F.col("price_usd")
    km = F.coalesce("nearest_surplus_distance_km", F.lit(0.0))
    decay = F.greatest(F.lit(0.0), F.lit(1.0) - km / F.lit(float(TRANSFER_REACH_KM)))
    return (
        short.withColumn("units_needed", need_units(F.col("avg_daily_velocity")))
        .withColumn(
            "transfer_units", F.least(need, F.coalesce("nearest_surplus_on_hand", F.lit(0))).cast("int")
        )
        .withColumns(
            {
                "transfer_recaptured": F.col("transfer_units") * price * F.expr(TRANSFER_RATE) * decay,
                "transfer_cost": F.lit(TRANSFER_BASE_COST) + km * F.lit(float(TRANSFER_KM_COST)),
                "expedite_recaptured": need * price * F.expr(EXPEDITE_RATE),
                "expedite_cost": need * EXPEDITE_UNIT_COST + EXPEDITE_BASE_COST,
                "substitute_recaptured": need * price * F.expr(SUBSTITUTE_RATE),
                "substitute_margin_impact": need
                * (price * F.expr(UNIT_MARGIN_RATE))
                * F.expr(SUBSTITUTE_MARGIN_LOSS),
            }
        )
    )


def with_scores(economics: DataFrame) -> DataFrame:
    """Net value of each move: recaptured less cost less margin loss."""
    return economics.withColumns(
        {
            "transfer_net": F.col("transfer_recaptured") - F.col("transfer_cost"),
            "expedite_net": F.col("expedite_recaptured") - F.col("expedite_cost"),
            "substitute_net": F.col("substitute_recaptured") - F.col("substitute_margin_impact"),
        }
    )


def with_recommended_move(scored: DataFrame) -> DataFrame:
    """Best net value; ties go to transfer, then expedite. A transfer needs a source with units."""
    t, e, s = F.col("transfer_net"), F.col("expedite_net"), F.col("substitute_net")
    can_transfer = F.col("nearest_surplus_store_id").isNotNull() & (F.col("transfer_units") > 0)
    move = (
        F.when((t >= e) & (t >= s) & can_transfer, "transfer").when(e >= s, "expedite").otherwise("substitute")
    )
    chosen = F.col("recommended_move")
    recaptured = F.round(F.col("substitute_recaptured"), 2).cast("double")
    for name in ("expedite", "transfer"):
        value = F.round(F.col(f"{name}_recaptured"), 2).cast("double")
        recaptured = F.when(chosen == name, value).otherwise(recaptured)
    nets = [F.round(F.col(f"{name}_net"), 2).cast("double") for name in MOVES]
    return scored.withColumn("recommended_move", move).withColumns(
        {
            "recommended_units": F.when(chosen == "transfer", F.col("transfer_units")).otherwise(
                F.col("units_needed")
            ),
            "predicted_recaptured_usd": recaptured,
            "predicted_net_value_usd": F.greatest(*nets),
        }
    )


def _move_struct(name: str) -> Column:
    cost = F.lit(0.0) if name == "substitute" else F.round(F.col(f"{name}_cost"), 2).cast("double")
    return F.struct(
        F.lit(name).alias("move"),
        F.round(F.col(f"{name}_recaptured"), 2).cast("double").alias("recaptured"),
        F.round(F.col(f"{name}_net"), 2).cast("double").alias("net"),
        cost.alias("cost"),
    )


def move_ranking() -> Column:
    """The three moves in fixed order, as an array; ``to_json`` of it is the stored text."""
    return F.array(*[_move_struct(m) for m in MOVES])


def recommend(short: DataFrame, products: DataFrame, available: DataFrame) -> DataFrame:
    """From open shortfalls to scored and recommended moves, with all working columns."""
    picks = substitute_pick(short, products, available).select(*KEY, "substitute_product_id")
    known = short.join(products.select("product_id"), "product_id", "left_semi")
    scored = with_scores(with_economics(known.join(picks, KEY, "left")))
    return with_recommended_move(scored)


RECOMMENDATION_COLUMNS = [
    *KEY, "recommended_move", "recommended_source_store_id", "recommended_substitute_product_id",
    "recommended_units", "predicted_recaptured_usd", "predicted_net_value_usd", "move_ranking",
]


def recovery_recommendations(short: DataFrame, products: DataFrame, available: DataFrame) -> DataFrame:
    """The published table. Source store and substitute are given whichever move wins."""
    return (
        recommend(short, products, available)
        .withColumn("recommended_source_store_id", F.col("nearest_surplus_store_id"))
        .withColumn("recommended_substitute_product_id", F.col("substitute_product_id"))
        .withColumn("move_ranking", F.to_json(move_ranking()))
        .select(*RECOMMENDATION_COLUMNS)
        .withColumn("scored_at", F.current_timestamp())
    )


def strict_recommendations(recommendations: DataFrame) -> DataFrame:
    """Variant: source store only for a transfer, substitute only for a substitution."""
    move = F.col("recommended_move")
    return recommendations.withColumns(
        {
            "recommended_source_store_id": F.when(
                move == "transfer", F.col("recommended_source_store_id")
            ),
            "recommended_substitute_product_id": F.when(
                move == "substitute", F.col("recommended_substitute_product_id")
            ),
        }
    )


def rank_options(options: Column) -> Column:
    """Explode an array of move structs best net value first, with their rank; ties keep the
    given order. The ranking happens within the array, so nothing is shuffled."""
    keyed = F.transform(
        options, lambda o, i: F.struct((-o["net"]).alias("minus_net"), i.alias("listed"), o.alias("option"))
    )
    return F.posexplode(F.array_sort(keyed)).alias("place", "ranked")


def ranked_moves(recommended: DataFrame) -> DataFrame:
    """Long form: one row per shortfall and move, ranked by net value (ties as in MOVES)."""
    ranked = recommended.select(*KEY, rank_options(move_ranking()))
    return ranked.select(*KEY, "ranked.option.*", (F.col("place") + 1).alias("move_rank"))
