"""Move economics goldens; nearest surplus and substitutes against brute force."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.geo import nearest_points
from shelfwise.operators import recovery as rec
from shelfwise.operators import scenario

SHORT = (
    "store_id long, product_id long, avg_daily_velocity decimal(27,6), price_usd decimal(12,2), "
    "on_hand_units int, nearest_surplus_store_id long, nearest_surplus_on_hand int, "
    "nearest_surplus_distance_km double"
)


def hero(spark, km=99.917):
    return spark.createDataFrame([(214, 4412, Decimal("7.571429"), Decimal("249.00"), 0, 377, 833, km)], SHORT)


def chain(df):
    return rec.with_recommended_move(rec.with_scores(rec.with_economics(df)))


def test_hero_economics(spark):
    row = chain(hero(spark)).first()
    assert row["units_needed"] == 228 and row["transfer_units"] == 228
    assert float(row["transfer_recaptured"]) == pytest.approx(50073.76, abs=1)
    assert float(row["transfer_net"]) == pytest.approx(49903.85, abs=1)
    assert round(row["expedite_recaptured"], 2) == Decimal("46553.04")
    assert round(row["expedite_net"], 2) == Decimal("44101.04")
    assert round(row["substitute_recaptured"], 2) == Decimal("19870.20")
    assert round(row["substitute_net"], 2) == Decimal("5052.71")
    assert row["recommended_move"] == "transfer" and row["recommended_units"] == 228


def test_what_if_flips_the_order(spark):
    scored = chain(hero(spark)).withColumn("transfer_units", F.lit(228))
    rows = {r["move"]: r for r in scenario.what_if_units(scored, F.lit(150.0)).collect()}
    assert rows["transfer"]["recaptured"] == pytest.approx(32943.26, abs=1)
    assert rows["transfer"]["net"] == pytest.approx(32831.48, abs=1)
    assert [r["move"] for r in sorted(rows.values(), key=lambda r: r["move_rank"])][0] == "expedite"


def test_no_source_and_far_source(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, Decimal("1.000000"), Decimal("100.00"), 0, None, None, None),
            (2, 1, Decimal("1.000000"), Decimal("100.00"), 0, 9, 50, 6000.0),
            (3, 1, Decimal("0.100000"), Decimal("20.00"), 0, None, None, None),
        ],
        SHORT,
    )
    got = {r["store_id"]: r for r in chain(rows).collect()}
    assert got[1]["recommended_move"] != "transfer" and got[1]["transfer_units"] == 0
    assert got[2]["transfer_recaptured"] == 0.0 and got[2]["recommended_move"] == "expedite"
    assert got[3]["recommended_move"] == "substitute"  # freight outweighs a small need


def test_demand_scenario(spark):
    row = spark.createDataFrame([(6, 1, 70431.42537, 0), (7, 1, 100.0, 4)],
                                "store_id long, product_id long, lost_sales_exposure_usd double, on_hand_units int")
    got = {r["store_id"]: r for r in scenario.demand_scenario(row, [2.0]).collect()}
    assert round(got[6]["scenario_exposure_usd"], 2) == 140862.85 == round(got[6]["urgency"], 2)
    assert got[7]["urgency"] == 50.0 and got[7]["place"] == 2


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    dx = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371 * 2 * math.asin(min(1.0, math.sqrt(dx)))


def clouds(kind, n, rng):
    if kind == "spread":
        return [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(n)]
    if kind == "one town":
        return [(39 + rng.random() * 0.3, -105 + rng.random() * 0.3) for _ in range(n)]
    if kind == "same spot":
        return [(39.5, -105.5)] * n
    return [(rng.uniform(-1, 1), rng.choice([179.5, -179.5]) + rng.uniform(-0.4, 0.4)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["spread", "one town", "same spot", "date line"])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_points_equal_brute_force(spark, kind, k):
    rng = random.Random(kind + str(k))
    probes = [(g, i, *p) for g in (1, 2) for i, p in enumerate(clouds("spread" if kind == "one town" else kind, 12, rng))]
    points = [(1, j, *p) for j, p in enumerate(clouds(kind, 40, rng))]  # group 2 has none
    got = nearest_points(
        spark.createDataFrame(probes, "grp int, probe int, lat double, lng double"),
        spark.createDataFrame(points, "grp int, point int, lat double, lng double"),
        on=["grp"], probe_key=["grp", "probe"], point_key="point", k=k,
    ).collect()
    found = {}
    for r in got:
        found.setdefault((r["grp"], r["probe"]), []).append((r["nth"], r["distance_km"]))
    assert all(g == 1 for g, _ in found)
    for g, i, lat, lng in probes:
        if g == 1:
            want = sorted(km((lat, lng), p[2:]) for p in points)[:k]
            have = [d for _, d in sorted(found[(g, i)])]
            assert have == pytest.approx(want, abs=1e-6)


def test_repeated_positions_collapse(spark):
    rows = [
        (1, 7, "West", 39.0, -105.0, 0, 0, "1.0", 30.0, "stockout"),
        (1, 7, "West", 39.0, -105.0, 1, 0, "2.0", 60.0, "stockout"),
        (2, 7, "West", 39.5, -105.0, 400, 0, "0.0", 0.0, "overstock"),
        (2, 7, "West", 39.5, -105.0, 500, 0, "0.0", 0.0, "overstock"),
        (3, 7, "East", 39.1, -105.0, 500, 0, "0.0", 0.0, "overstock"),
    ]
    df = spark.createDataFrame(
        rows,
        "store_id long, product_id long, region string, store_lat double, store_lng double, on_hand_units int, "
        "on_order_units int, avg_daily_velocity string, lost_sales_exposure_usd double, position_status string",
    ).withColumns({"avg_daily_velocity": F.col("avg_daily_velocity").cast("decimal(27,6)"),
                   "price_usd": F.lit("10.00").cast("decimal(12,2)")})
    got = rec.open_shortfalls(df).collect()
    assert len(got) == 1
    assert got[0]["lost_sales_exposure_usd"] == 60.0
    assert (got[0]["nearest_surplus_store_id"], got[0]["nearest_surplus_on_hand"]) == (2, 500)


def test_closest_substitutes_equal_brute_force(spark):
    rng = random.Random(3)
    goods = [(i, f"sub{rng.randrange(3)}", Decimal(rng.randrange(100, 130)) / 4) for i in range(120)]
    candidates = [g for g in goods if g[0] % 2]
    schema = "product_id long, subcategory string, price_usd decimal(12,2)"
    got = {
        r["product_id"]: r["substitute_product_id"]
        for r in rec.closest_substitutes(
            spark.createDataFrame(goods, schema), spark.createDataFrame(candidates, schema)
        ).collect()
    }
    for pid, sub, price in goods:
        options = sorted((abs(c[2] - price), c[0]) for c in candidates if c[1] == sub and c[0] != pid)
        assert got.get(pid) == (options[0][1] if options else None)


def test_lone_candidate_is_not_its_own_substitute(spark):
    one = spark.createDataFrame([(1, "a", Decimal("5.00"))], "product_id long, subcategory string, price_usd decimal(12,2)")
    assert rec.closest_substitutes(one, one).count() == 0


def test_learned_model_prefers_the_near_transfer(spark):
    from shelfwise.operators import learned

    rng = random.Random(11)
    rows = []
    for i in range(300):
        move = ("transfer", "expedite", "substitute")[i % 3]
        units, price = rng.randrange(20, 100), 100.0
        rate = {"transfer": 0.9, "expedite": 0.82, "substitute": 0.35}[move]
        rows.append((move, 100.0 if move == "transfer" else None, units, 500, 7.0, 1, price, 42.0, "West", "West",
                     units * price * rate))
    moves = spark.createDataFrame(
        rows, "move_type string, distance_km double, units_moved int, from_on_hand_at_move int, to_velocity_at_move double, "
        "days_to_fulfill int, price_usd double, product_cost_usd double, from_region string, to_region string, "
        "recaptured_sales_usd double")
    model = learned.train(learned.training_rows(moves), trees=5, depth=4)
    short = chain(spark.createDataFrame(
        [(1, 1, Decimal("2.000000"), Decimal("100.00"), 0, 9, 500, 100.0), (2, 1, Decimal("2.000000"), Decimal("100.00"), 0, None, None, None)],
        SHORT))
    item = spark.createDataFrame([(1, Decimal("42.00"))], "product_id long, cost_usd decimal(12,2)")
    got = learned.score(model, learned.candidates(short, item)).collect()
    first = {r["store_id"]: r["move_type"] for r in got if r["move_rank"] == 1}
    assert first == {1: "transfer", 2: "expedite"}
    assert sum(r["store_id"] == 2 for r in got) == 2  # no source, no transfer on offer
