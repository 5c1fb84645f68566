"""Frames by name for one data folder, each built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import position as pos
from shelfwise.operators import recovery as rec
from shelfwise.operators import silver
from shelfwise.sources import fixtures as fx
from shelfwise.sources.scratch import stage


class Retail:
    """Lazy frames from raw tables to recommendations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fx.read(self.spark, self.sf_dir, name)

    @cached_property
    def stores(self) -> DataFrame:
        return fx.stores(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        return fx.products(self.spark, self.sf_dir)

    @cached_property
    def sales(self) -> DataFrame:
        return fx.sales(self.spark, self.sf_dir)

    @cached_property
    def inventory(self) -> DataFrame:
        return fx.inventory(self.spark, self.sf_dir)

    @cached_property
    def transfers(self) -> DataFrame:
        return fx.transfers(self.spark, self.sf_dir, self.stores, self.products)

    @cached_property
    def traffic(self) -> DataFrame:
        return fx.store_traffic(self.spark, self.sf_dir)

    @cached_property
    def newest(self) -> Column:
        return fx.newest_ship_date(self.spark, self.sf_dir)

    @cached_property
    def silver_sales(self) -> DataFrame:
        return silver.silver_sales(self.sales, self.stores, self.products)

    @cached_property
    def silver_inventory(self) -> DataFrame:
        return silver.silver_inventory(self.inventory, self.stores, self.products)

    @cached_property
    def silver_transfers(self) -> DataFrame:
        return silver.silver_transfers(self.transfers, self.stores, self.products)

    @cached_property
    def outcomes(self) -> DataFrame:
        return silver.transfer_outcomes(self.silver_transfers)

    @cached_property
    def position(self) -> DataFrame:
        """The spine, computed where it is used. For plans that read it once. Snapshots and sales
        end on the same day, so one cheap subquery over the raw dates serves as both anchors."""
        return pos.store_sku_position(
            self.silver_inventory, self.silver_sales, as_of=self.newest, sales_as_of=self.newest
        )

    @cached_property
    def position_by_product(self) -> DataFrame:
        """The spine in tasks by product, whose size does not grow with the tables. For plans that
        group it by product."""
        tasks = fx.sale_tasks(self.spark, self.sf_dir)
        inventory = silver.silver_inventory(self.inventory, self.stores, self.products, tasks=tasks)
        return pos.store_sku_position(inventory, self.silver_sales, as_of=self.newest, sales_as_of=self.newest)

    @cached_property
    def flagged(self) -> DataFrame:
        """The positions that need attention (all but healthy), written once. The recovery chain
        reads them several times: as shortfalls, as surplus and as acted positions."""
        return stage(self.position.where(F.col("position_status") != "healthy"), "flagged")

    @cached_property
    def available(self) -> DataFrame:
        """Products in stock. Needs the snapshot only: no sales join remains in its plan."""
        return rec.available_products(self.position)

    @cached_property
    def shortfalls(self) -> DataFrame:
        return rec.open_shortfalls(self.flagged)

    @cached_property
    def recommended(self) -> DataFrame:
        return rec.recommend(self.shortfalls, self.products, self.available)

    @cached_property
    def recommended_table(self) -> DataFrame:
        """The same as a written table, one row per shortfall. For plans that read it more than
        once."""
        return stage(self.recommended, "recommended")

    @cached_property
    def recommendations(self) -> DataFrame:
        return rec.recovery_recommendations(self.shortfalls, self.products, self.available)

    @cached_property
    def actions(self) -> DataFrame:
        return fx.actions(self.flagged, self.newest)

    @cached_property
    def gateway_log(self) -> DataFrame:
        return fx.gateway_log(self.spark, self.sf_dir)

    @cached_property
    def changelog(self) -> DataFrame:
        return fx.changelog(self.spark, self.sf_dir)

    @cached_property
    def messages(self) -> DataFrame:
        return fx.messages(self.spark, self.sf_dir)

    @cached_property
    def heads(self) -> DataFrame:
        return fx.conversation_heads(self.spark, self.sf_dir)

    @cached_property
    def feedback(self) -> DataFrame:
        return fx.feedback(self.messages)
