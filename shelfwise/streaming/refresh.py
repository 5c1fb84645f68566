"""Gold as a stream: daily sales sums for the mirror, and the scored view of each whole snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from shelfwise.operators import position
from shelfwise.sources.tables import dealt
from shelfwise.streaming import runner

KEY = ["store_id", "product_id"]
DAY = "1 day"

STOCK = ["on_hand_units", "price_usd", "markdown_risk_score"]  # what a position is made of, beside the sales
PIECES = 512  # of a snapshot


def _start_of(date: str) -> Column:
    return F.col(date).cast("timestamp")


# ---- the mirror: recent sales per key that expire by themselves


def daily_sales(sales: DataFrame, lateness: str = f"{position.WINDOW_DAYS} days") -> DataFrame:
    """Units and sales per store, product and day: of a stream as running state, in update mode, of a
    micro-batch its own sums. Late sales count as long as their day can still be in a window; older
    days leave the state, so that a key without sales holds none."""
    return (
        sales.withColumn("day", _start_of("sale_date"))
        .withWatermark("day", lateness)
        .groupBy("day", *KEY)
        .agg(F.sum("units_sold").alias("units"), F.sum("net_sales_usd").alias("net_sales"))
        .select(*KEY, "units", "net_sales", F.col("day").cast("date").alias("sale_date"))
    )


def in_window(rows: DataFrame, days: int = position.WINDOW_DAYS) -> DataFrame:
    """The rows of the last days up to the newest sale among them."""
    return rows.where(F.col("sale_date") > F.date_sub(rows.agg(F.max("sale_date")).scalar(), days))


def window_sums(log: DataFrame, days: int = position.WINDOW_DAYS, tasks: int | None = None) -> DataFrame:
    """Recent sales per key from the log of daily sums, each micro-batch with its own: all sums of
    each of the last days before the newest day in it, added."""
    return dealt(in_window(log, days), tasks, *KEY).groupBy(*KEY).agg(
        F.sum("units").alias("recent_units_7d"), F.sum("net_sales").alias("recent_net_sales_7d")
    )


def refreshed_positions(inventory: DataFrame, log: DataFrame, tasks: int | None = None) -> DataFrame:
    """The spine of the newest day in the log, with the newest snapshot up to it. ``tasks``: snapshot
    and sums meet in so many tasks (dealt both, as Spark takes the number of the side that is not)."""
    day = log.agg(F.max("sale_date")).scalar()
    up_to_day = inventory.where(F.col("snapshot_date") <= day)
    snapshot = dealt(position.current_snapshot(up_to_day), tasks, *KEY)
    joined = position.join_recent_sales(snapshot, window_sums(log, tasks=tasks))
    spine = position.with_status(position.with_exposures(position.with_metrics(joined)))
    return spine.withColumn("as_of", day)


def keep_mirror(
    sales: DataFrame | list[DataFrame], inventory: DataFrame, name: str, every: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Follow a stream of sales (or its turns): after each micro-batch the open shortfalls of the newest
    day are written anew. Returns the last mirror of each day (as_of).

    The daily sums are kept as a log on disk, not as state in memory: a micro-batch adds the sums of
    its own rows, without the days that no window from its newest day on holds, so a first batch
    with years of sales takes no more than a scan. ``tasks``: see refreshed_positions()."""
    streams = runner.turns_of(sales)
    spark = streams[0].sparkSession

    def work(batch: DataFrame, batch_id: int, folder: str) -> None:
        root = folder.rsplit("/", 1)[0]
        daily_sales(in_window(batch)).write.mode("overwrite").parquet(f"{root}/daily/batch_id={batch_id}")
        log = spark.read.option("basePath", f"{root}/daily").schema(logged).parquet(f"{root}/daily")
        # a batch that is run again must not see what came after it
        seen = log.where(F.col("batch_id") <= batch_id)
        if batch_id and in_window(seen).where(F.col("batch_id") == batch_id).isEmpty():
            return  # all its sales come too late for a window
        mirror = refreshed_positions(inventory, seen, tasks).where(position.is_open())
        mirror.write.mode("overwrite").parquet(f"{root}/mirror/batch_id={batch_id}")

    logged = daily_sales(streams[0]).schema.add("batch_id", "long")
    path = runner.each_batch(streams, name, work, "append", every)
    mirrors = spark.read.option("basePath", f"{path}/mirror").parquet(f"{path}/mirror")
    newest = mirrors.groupBy("as_of").agg(F.max("batch_id").alias("batch_id"))
    return mirrors.join(newest, ["as_of", "batch_id"])


# ---- the scored view: snapshots and sales both as streams


def _bytes_of(table: pa.Table) -> bytes:
    """In order of the key, whose numbers then differ little from row to row, and compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.sort_by([(k, "ascending") for k in reversed(KEY)]).combine_chunks())
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """The rows of each micro-batch by instant (`closes`) and hash of the key, as one row with all of
    them packed in a column. A stream's state holds few such rows, of a few bytes for each of theirs."""
    kinds = StructType([rows.schema["closes"], StructField("piece", IntegerType()), StructField(name, BinaryType())])
    held = [c for c in rows.columns if c != "closes"]

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        when, piece = (pa.array([x.as_py()], x.type) for x in key)
        return pa.table([when, piece, pa.array([_bytes_of(table.select(held))], pa.binary())], names=kinds.names)

    placed = rows.withColumn("piece", F.pmod(F.xxhash64(*KEY), F.lit(PIECES)).cast("int"))
    return placed.groupBy("closes", "piece").applyInArrow(pack, kinds)


def _met(stock: DataFrame, sums: DataFrame) -> DataFrame:
    """Streams of stock rows and of finished sums: every stock row with the sums of its key and
    instant, or NULLs. The rows wait packed. All sums of an instant come in one micro-batch, once the
    watermark has passed it, so that no stock row can meet two of their pieces."""
    added = [f for f in sums.schema.fields if f.name not in (*KEY, "closes")]
    kinds = StructType([*stock.schema.fields, *added])  # `closes` keeps its watermark by the metadata of its field

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for when, left, right in zip(*(batch[c] for c in ("closes", "stock", "sums")), strict=True):
                rows = pa.ipc.open_stream(left.as_buffer()).read_all()
                if right.is_valid:
                    rows = rows.join(pa.ipc.open_stream(right.as_buffer()).read_all(), KEY, join_type="left outer", use_threads=False)
                else:
                    for f in added:
                        rows = rows.append_column(f.name, pa.nulls(len(rows), to_arrow_type(f.dataType)))
                rows = rows.append_column("closes", pa.repeat(when, len(rows)))
                yield from rows.select(kinds.names).to_batches(max_chunksize=10_000)

    runner.bounded_batches(stock.sparkSession)
    pairs = _packed(stock, "stock").join(_packed(sums, "sums"), ["closes", "piece"], "left")
    return pairs.mapInArrow(meet, kinds)


def scored_snapshots(inventory: DataFrame, sales: DataFrame, lateness: str = DAY, since: Column | None = None) -> DataFrame:
    """One row per whole snapshot: how many positions are open, their exposure, and the worst.

    Both sides are streams. Sales become sums of the seven days up to each day; a snapshot's rows
    meet the sums of their day, or none. A snapshot is whole once both watermarks have passed the
    end of its day; then its row comes out, once. ``inventory`` has the columns of silver inventory
    and, from before its joins, `closes` with its watermark (see closing()). ``since`` names the day of
    the first snapshot, where it is known: windows that end before it meet no snapshot, so the
    sales that lie in no other need not pass through the state."""
    days = f"{position.WINDOW_DAYS} days"
    meets = F.lit(True) if since is None else F.col("sale_date") > F.date_sub(since, position.WINDOW_DAYS)
    sums = (
        sales.where(meets)
        .withColumn("day", _start_of("sale_date"))
        .withWatermark("day", lateness)
        .groupBy(F.window("day", days, DAY), *KEY)
        .agg(F.sum("units_sold").alias("recent_units_7d"), F.sum("net_sales_usd").alias("recent_net_sales_7d"))
        .select(F.window_time("window").alias("closes"), *KEY, "recent_units_7d", "recent_net_sales_7d")
    )
    joined = _met(inventory.select(*KEY, "closes", *STOCK), sums).withColumns(
        {
            "recent_units_7d": F.coalesce("recent_units_7d", F.lit(0).cast("bigint")),
            "recent_net_sales_7d": F.coalesce("recent_net_sales_7d", F.lit(0)),
        }
    )
    scored = position.with_status(position.with_exposures(position.with_metrics(joined)))
    open_rows, lost = position.is_open(), F.col("lost_sales_exposure_usd")
    worst = F.struct((-F.coalesce(lost, F.lit(0))).alias("minus"), *KEY)
    return (
        scored.groupBy("closes")
        .agg(
            F.min(F.when(open_rows, worst)).alias("worst"),
            F.count_if(open_rows).alias("open_shortfall_count"),
            F.sum(F.when(open_rows, lost)).alias("open_exposure_usd"),
        )
        .select(
            F.col("closes").cast("date").alias("scored_date"), "worst.store_id", "worst.product_id",
            (-F.col("worst.minus")).alias("worst_exposure_usd"), "open_shortfall_count", "open_exposure_usd",
        )
    )


def closing(snapshots: DataFrame, lateness: str = DAY) -> DataFrame:
    """Snapshot rows with `closes`, the last instant of their day, as event time."""
    end = _start_of("snapshot_date") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return snapshots.withColumn("closes", end).withWatermark("closes", lateness)
