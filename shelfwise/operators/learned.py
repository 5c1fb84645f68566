"""Learned recovery model: predict recaptured sales of a move, rank the moves of a shortfall."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.position import HORIZON_DAYS
from shelfwise.operators.recovery import KEY, MOVES

NUMERIC = [
    "distance_km", "units_needed", "source_on_hand", "to_velocity", "days_to_fulfill", "price_usd",
    "margin_pct", "same_region",
]
LABEL = "recaptured_sales_usd"
# Expected lead time of a planned move in days.
LEAD_DAYS = {"transfer": 1.5, "expedite": 4.0, "substitute": 0.0}


def _number(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def training_rows(moves: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Past moves with outcome, regions and the features known at move time; ``keep`` names more
    columns to carry along."""
    margin = (F.col("price_usd") - F.col("product_cost_usd")) / F.nullif(F.col("price_usd"), F.lit(0))
    same = F.coalesce(F.col("from_region") == F.col("to_region"), F.lit(False))
    return moves.select(
        "move_type",
        _number(F.col("distance_km")).alias("distance_km"),
        _number(F.col("units_moved")).alias("units_needed"),
        _number(F.col("from_on_hand_at_move")).alias("source_on_hand"),
        _number(F.col("to_velocity_at_move")).alias("to_velocity"),
        _number(F.col("days_to_fulfill")).alias("days_to_fulfill"),
        _number(F.col("price_usd")).alias("price_usd"),
        _number(margin).alias("margin_pct"),
        same.cast("double").alias("same_region"),
        _number(F.col(LABEL)).alias(LABEL),
        *(keep or []),
    )


def train(rows: DataFrame, trees: int = 10, depth: int = 5, seed: int = 7, label: str = LABEL) -> PipelineModel:
    stages = [
        StringIndexer(inputCol="move_type", outputCol="move_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=["move_index", *NUMERIC], outputCol="features"),
        GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows)


def candidates(recommended: DataFrame, products: DataFrame) -> DataFrame:
    """Three moves per shortfall with features, cost and margin loss; transfers need a source.
    The need is the sales horizon less the stock on hand."""
    need = F.greatest(F.lit(0), F.ceil(F.col("avg_daily_velocity") * HORIZON_DAYS) - F.col("on_hand_units"))
    item = products.select("product_id", "cost_usd")

    def option(move: str) -> Column:
        transfer = move == "transfer"
        distance = _number(F.col("nearest_surplus_distance_km")) if transfer else F.lit(0.0)
        stock = _number(F.col("nearest_surplus_on_hand")) if transfer else F.lit(0.0)
        units = F.least(F.col("need"), stock) if transfer else F.col("need").cast("double")
        margin_loss = _number(F.col("substitute_margin_impact")) if move == "substitute" else F.lit(0.0)
        cost = F.lit(0.0) if move == "substitute" else _number(F.col(f"{move}_cost"))
        return F.struct(
            F.lit(move).alias("move_type"), distance.alias("distance_km"), units.alias("units_needed"),
            stock.alias("source_on_hand"), F.lit(LEAD_DAYS[move]).alias("days_to_fulfill"),
            F.lit(1.0 if transfer else 0.0).alias("same_region"), cost.alias("cost"),
            margin_loss.alias("margin_loss"),
        )

    return (
        recommended.join(item, "product_id")
        .withColumn("need", need.cast("double"))
        .withColumn("o", F.explode(F.array(*[option(m) for m in MOVES])))
        .where((F.col("o.move_type") != "transfer") | (F.col("o.source_on_hand") > 0))
        .select(
            *KEY, "o.*", _number(F.col("avg_daily_velocity")).alias("to_velocity"),
            _number(F.col("price_usd")).alias("price_usd"),
            _number((F.col("price_usd") - F.col("cost_usd")) / F.nullif(F.col("price_usd"), F.lit(0))).alias(
                "margin_pct"
            ),
        )
    )


def score(model: PipelineModel, options: DataFrame) -> DataFrame:
    """Predicted recaptured sales and net value per option, ranked per shortfall."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("predicted_net_value_usd"), "move_type")
    return (
        model.transform(options)
        .withColumn("predicted_recaptured_usd", F.greatest(F.lit(0.0), F.col("prediction")))
        .withColumn(
            "predicted_net_value_usd", F.col("predicted_recaptured_usd") - F.col("cost") - F.col("margin_loss")
        )
        .withColumn("move_rank", F.row_number().over(order))
    )


# ---- judged on later moves


def with_share(rows: DataFrame) -> DataFrame:
    """The value that a move put at stake, and the share of it that came back."""
    value = F.col("units_needed") * F.col("price_usd")
    return rows.withColumn("value", value).withColumn("share", F.col(LABEL) / F.nullif(F.col("value"), F.lit(0.0)))


def later_errors(rows: DataFrame, date: str, since: Column) -> DataFrame:
    """Per move type, and over all (move_type NULL): moves after a date, their mean recaptured sales,
    and the mean absolute error of a model and of plain rates, both learned from the moves up to that
    date. The model learns the share of the value that comes back, so that large orders do not
    outweigh all others; the rate is the mean share of the move type."""
    known = with_share(rows).where(F.col("share").isNotNull())
    past, later = known.where(F.col(date) <= since), known.where(F.col(date) > since)
    rates = past.groupBy("move_type").agg(F.avg("share").alias("rate"))  # a row for each kind of move
    model = train(past, trees=20, label="share")
    judged = model.transform(later).join(F.broadcast(rates), "move_type")
    error = lambda share: F.avg(F.abs(share * F.col("value") - F.col(LABEL)))
    return judged.rollup("move_type").agg(
        F.count(F.lit(1)).alias("moves"), F.avg(LABEL).alias("mean_usd"),
        error(F.col("rate")).alias("rate_error"), error(F.col("prediction")).alias("model_error"),
    )
