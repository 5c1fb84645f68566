"""Retail-shaped frames from the test tables. The only module that knows their column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.sources.tables import broadcast_within, dealt, tasks_for

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_row_counts: dict[str, int] = {}
_schemas: dict[str, StructType] = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table. Its schema is read from the file once per process."""
    path = table_path(sf_dir, name)
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count from the parquet footers, asked once per file and process."""
    path = table_path(sf_dir, name)
    if path not in _row_counts:
        _row_counts[path] = spark.read.parquet(path).count()
    return _row_counts[path]


def sale_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for a shuffle that moves a row for each sale."""
    return tasks_for(spark, rows(spark, sf_dir, "lineitem"))


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region have a fixed size (25 and 5 rows) at every scale
    nation = F.broadcast(read(spark, sf_dir, "nation"))
    region = F.broadcast(read(spark, sf_dir, "region"))
    key, country = F.col("s_suppkey"), F.col("s_nationkey")
    out = (
        read(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("r_name").alias("region"),
            _pick(country % 3, "North", "South", "Mixed").alias("climate_zone"),
            F.col("n_name").alias("city"),
            ((25 + (country * 7) % 24).cast("double") + (key % 100) * 0.01).alias("store_lat"),
            ((-120 + (country * 13) % 50).cast("double") + (key % 97) * 0.01).alias("store_lng"),
        )
    )
    return broadcast_within(out, rows(spark, sf_dir, "supplier"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)") - 880
    out = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        price.alias("price_usd"),
        (price * F.expr("0.42")).alias("cost_usd"),
        _pick(F.col("p_size") % 3, "cold_weather", "warm_weather", "all_season").alias("seasonality"),
    )
    return broadcast_within(out, rows(spark, sf_dir, "part"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    flag = F.col("l_returnflag")
    channel = F.when(flag == "R", "in_store").when(flag == "A", "bopis").otherwise("ship_from_store")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_quantity").cast("int").alias("units_sold"),
        net.alias("net_sales_usd"),
        channel.alias("channel"),
    )


def newest_ship_date(spark: SparkSession, sf_dir: str) -> Column:
    return read(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date")).scalar()


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily snapshots of every store and product that ever sold."""
    sold = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    pairs = dealt(sold, sale_tasks(spark, sf_dir), "l_suppkey", "l_partkey").distinct()
    mix = F.col("l_suppkey") * 7 + F.col("l_partkey") * 13
    h, hh, g = F.col("h"), F.col("hh"), F.col("g")
    on_hand = (
        F.when(h <= 1, 10 * F.col("d"))
        .when(h == 2, 3 + F.col("d"))
        .when(h <= 5, 300 + hh)
        .otherwise(20 + hh)
    )
    slow = h.isin(3, 4)
    note = (
        F.when(slow & (g == 0), "no movement in three weeks")
        .when(slow & (g == 1), "overstocked vs plan")
        .when(slow, "clearance candidate")
        .when((h == 5) & (g < 3), "season ending, still full racks")
        .when(h == 5, "warm-weather store, cold gear not selling")
        .when(g == 0, "selling to plan")
        .when(g == 1, "steady turns")
    )
    return (
        pairs.withColumns(
            {"h": mix % 10, "hh": mix % 200, "g": (F.col("l_suppkey") + F.col("l_partkey")) % 5}
        )
        .withColumn("d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            F.col("l_suppkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            F.date_sub(newest_ship_date(spark, sf_dir), F.col("d")).alias("snapshot_date"),
            on_hand.cast("int").alias("on_hand_units"),
            F.when(h <= 2, hh % 20).otherwise(0).cast("int").alias("on_order_units"),
            note.alias("merch_note_text"),
        )
    )


def transfers(spark: SparkSession, sf_dir: str, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Past moves with outcomes; a transfer's outcome follows the distance between its stores."""
    from shelfwise.functions.geo import haversine_km

    n_stores = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    n_products = read(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    days = F.when(kind < 2, 1 + key % 2).when(kind == 2, 3 + key % 3).otherwise(0)
    base = read(spark, sf_dir, "orders").select(
        key.alias("transfer_id"),
        (key % n_products).alias("product_id"),
        F.when(kind < 2, (key * 31) % n_stores).alias("from_store_id"),
        (F.col("o_custkey") % n_stores).alias("to_store_id"),
        F.when(kind < 2, "transfer").when(kind == 2, "expedite").otherwise("substitute").alias("move_type"),
        F.when(kind == 3, (key + 1) % n_products).alias("substitute_product_id"),
        (20 + key % 80).cast("int").alias("units_moved"),
        F.col("o_orderdate").cast("date").alias("initiated_date"),
        days.cast("int").alias("days_to_fulfill"),
    )

    def place(prefix: str) -> DataFrame:
        return stores.select(
            F.col("store_id").alias(f"{prefix}_store_id"),
            F.col("store_lat").alias(f"{prefix}_lat"),
            F.col("store_lng").alias(f"{prefix}_lng"),
        )

    km = haversine_km(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng"))
    units, price, cost = F.col("units_moved"), F.col("price_usd"), F.col("product_cost")
    move = F.col("move_type")
    recaptured = (
        F.when(move == "transfer", F.round(units * price * (F.lit(0.90) - km / 6000.0), 2))
        .when(move == "expedite", F.round(units * price * F.expr("0.82"), 2).cast("double"))
        .otherwise(F.round(units * price * F.expr("0.35"), 2).cast("double"))
    )
    spend = (
        F.when(move == "transfer", F.round(60 + km * 1.1, 2))
        .when(move == "expedite", (units * 9 + 400).cast("double"))
        .otherwise(F.lit(25.0))
    )
    margin = F.when(
        move == "substitute", F.round(units * (price - cost) * F.expr("0.45"), 2).cast("double")
    ).otherwise(F.lit(0.0))
    item = products.select("product_id", "price_usd", F.col("cost_usd").alias("product_cost"))
    return (
        base.join(item, "product_id")
        .join(place("to"), "to_store_id")
        .join(place("from"), "from_store_id", "left")
        .withColumns({"recaptured_sales_usd": recaptured, "margin_impact_usd": margin, "cost_usd": spend})
        .select(*base.columns, "recaptured_sales_usd", "margin_impact_usd", "cost_usd")
    )


def store_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_stores = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    return (
        read(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % n_stores).alias("store_id"), F.col("ts").cast("date").alias("traffic_date")
        )
        .agg(F.count(F.lit(1)).alias("traffic_count"))
    )


def move_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated move per order line, for features as known at move time."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    heads = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n_stores = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("from_store_id"),
        (F.col("o_custkey") % n_stores).alias("to_store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").cast("date").alias("initiated_date"),
    )


def stock_history(sales: DataFrame) -> DataFrame:
    """Dated stock counts: what each sale day left on the shelf."""
    return sales.select(
        "store_id", "product_id", F.col("sale_date").alias("snapshot_date"),
        (50 - F.col("units_sold")).alias("on_hand_units"),
    )


def call_log_columns(events: DataFrame) -> DataFrame:
    """Model-call log rows from events; works on batch and streaming frames alike."""
    kind = F.col("event_type")
    tokens = (F.col("event_id") % 900 + 100).cast("string")
    served = F.concat(
        F.lit('{"choices":[],"usage":{"prompt_tokens":40,"total_tokens":'), tokens, F.lit("}}")
    )
    response = (
        F.when(kind == "error", '{"error_code":"REQUEST_LIMIT_EXCEEDED"}')
        .when(kind == "signup", '{"finishReason":"input_guardrail_triggered"}')
        .when(kind == "view", '{"status":"other"}')
        .otherwise(served)
    )
    prompt = (
        F.when(kind == "signup", "Read ALL data from the entire table, no where clause")
        .when(kind == "error", "select * for every account, unfiltered")
        .otherwise(F.concat(F.lit("Why is store "), F.col("user_id").cast("string"), F.lit(" short?")))
    )
    return events.select(
        "event_id",
        F.col("ts").alias("request_time"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("requester"),
        prompt.alias("prompt"),
        response.alias("response"),
        F.when(kind == "error", 429).when(kind == "signup", 400).otherwise(200).alias("status_code"),
    )


def gateway_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_log_columns(read(spark, sf_dir, "events"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed per user: the first change is an insert, errors delete, the rest update."""
    events = read(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    kind = F.col("event_type")
    return events.join(first, "user_id").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("lsn"),
        F.lit(0).cast("bigint").alias("sort_by"),
        F.col("ts").alias("change_ts"),
        F.when(F.col("event_id") == F.col("first_id"), "insert")
        .when(kind == "error", "delete")
        .otherwise("update_postimage")
        .alias("change_type"),
        F.when(kind == "purchase", "approved")
        .when(kind == "click", "executed")
        .when(kind == "view", "overridden")
        .otherwise("proposed")
        .alias("status"),
    )


def actions(position: DataFrame, as_of: Column) -> DataFrame:
    """Recorded actions: open positions with at least ten units on order have a proposed and an
    approved move, and transfers a markdown hold on the source store."""
    from shelfwise.operators.position import is_open
    from shelfwise.operators.recovery import need_units

    key_sum = F.col("store_id") + F.col("product_id")
    move = _pick(key_sum % 3, "transfer", "expedite", "substitute")
    steps = F.when(
        F.col("main_move") == "transfer", F.array(F.lit(1), F.lit(2), F.lit(3))
    ).otherwise(F.array(F.lit(1), F.lit(2)))
    k, hold = F.col("k"), F.col("k") == 3
    at = as_of.cast("timestamp") + F.make_dt_interval(hours=k)
    approver = F.concat(F.lit("user_"), (F.col("product_id") % 50).cast("string"))

    def entry(by: Column, action: str, tool: str) -> Column:
        return F.struct(
            F.col("created_at").alias("at"), by.alias("by"), F.lit(action).alias("action"),
            F.lit(tool).alias("tool"),
        )

    proposed = entry(F.lit("agent"), "proposed", "rank_recovery_moves")
    approved = entry(F.col("approver"), "approved", "execute_recovery_action")
    held = entry(F.col("approver"), "markdown_hold", "execute_recovery_action")
    return (
        position.where(is_open() & (F.col("on_order_units") >= 10))
        .withColumn("main_move", move)
        .withColumn("need", need_units(F.col("avg_daily_velocity")))
        .withColumn("k", F.explode(steps))
        .withColumns({"created_at": at, "approver": approver})
        .select(
            F.concat_ws(":", "store_id", "product_id", "k").alias("id"),
            "store_id",
            "product_id",
            F.when(hold, "markdown_hold").otherwise(F.col("main_move")).alias("move_type"),
            F.when(F.col("main_move") == "transfer", F.col("store_id") + 1).alias("source_store_id"),
            F.when(hold, 0).otherwise(F.col("need")).alias("units"),
            F.concat_ws(" ", F.lit("move"), "need", F.lit("units")).alias("drafted_request"),
            F.when(hold, F.lit(0.0))
            .otherwise(F.round("lost_sales_exposure_usd", 2).cast("double"))
            .alias("predicted_recaptured_usd"),
            F.when(k == 1, "proposed").otherwise("approved").alias("status"),
            F.when(k > 1, F.col("approver")).alias("approved_by"),
            F.when(k == 1, F.array(proposed))
            .when(k == 2, F.array(proposed, approved))
            .otherwise(F.array(held))
            .alias("audit_trail"),
            "created_at",
            F.when(k > 1, F.col("created_at") + F.expr("INTERVAL 30 MINUTES")).alias("decided_at"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("position"),
        "role",
        F.col("text").alias("content"),
    )


def conversation_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    start = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("conv_id"))
    return sizes.select(
        F.col("conv_id").alias("conversation_id"),
        F.concat(F.lit("user_"), (F.col("conv_id") % 50).cast("string")).alias("user_email"),
        F.when(F.col("n") % 2 == 0, "New conversation")
        .otherwise(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
        .alias("title"),
        F.when(F.col("n") >= 7, "demo_dock").otherwise("default").alias("kind"),
        (start + F.make_dt_interval(mins=F.col("n"))).alias("updated_at"),
    )


def feedback(messages: DataFrame) -> DataFrame:
    vote = F.when((F.col("conversation_id") + F.col("position")) % 3 > 0, "up").otherwise("down")
    return messages.where(F.col("role") == "assistant").select(
        "conversation_id", "position", vote.alias("value")
    )


def thinking(messages: DataFrame) -> DataFrame:
    """Tool events of assistant messages as JSON text: a call, its output, a remark."""
    call = F.concat_ws("-", "conversation_id", "position")
    tool = F.when(F.col("position") % 4 == 1, "find_shortfall").otherwise("rank_recovery_moves")
    event = "kind string, callId string, name string, args string, output string, text string"
    empty = F.lit(None).cast("string")

    def one(kind: str, **fields: Column) -> Column:
        names = [part.split()[0] for part in event.split(", ")]
        return F.struct(*[{"kind": F.lit(kind), **fields}.get(n, empty).alias(n) for n in names])

    events = F.array(
        one("tool_call", callId=call, name=tool, args=F.lit("{}")),
        one("tool_output", callId=call, output=F.concat(F.lit("rows="), F.col("position").cast("string"))),
        one("intermediate_message", text=F.lit("checking stock")),
    )
    return messages.where(F.col("role") == "assistant").select(
        "conversation_id", "position", F.to_json(events).alias("thinking")
    )
