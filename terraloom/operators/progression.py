"""Upgrades, vehicles and experience: folds, eligibility, purchase replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.levels import level_of, percent_to_next, threshold_array, xp_to_next
from ..scratch import cut, cut_with
from .fleet import VEHICLES, effect
from .ranking import dense_positions, running_sum
from .sampling import CATEGORY_MIN_TIER

CATEGORIES = list(CATEGORY_MIN_TIER)
UPGRADE_SCHEMA = (
    "upgrade_id string, requires array<string>, levels map<string,int>, cost double, "
    "kind string, effect string, amount double"
)
# Every upgrade as (id, requires, levels, cost, kind, effect, amount).
UPGRADES = [
    ("unlock_pannier_bike", [], {"total": 3}, 20, "set", "vehicleLevelMax", 1),
    ("unlock_e_bike", ["unlock_pannier_bike"], {"total": 6}, 60, "set", "vehicleLevelMax", 2),
    ("unlock_cargo_bike", ["unlock_e_bike"], {"total": 10}, 150, "set", "vehicleLevelMax", 3),
    ("unlock_scooter", ["unlock_cargo_bike"], {"total": 15}, 400, "set", "vehicleLevelMax", 4),
    ("unlock_motorbike_125", ["unlock_scooter"], {"total": 22}, 900, "set", "vehicleLevelMax", 5),
    ("unlock_compact_car", ["unlock_motorbike_125"], {"total": 30}, 2000, "set", "vehicleLevelMax", 6),
    ("unlock_small_van", ["unlock_compact_car"], {"total": 40}, 4500, "set", "vehicleLevelMax", 7),
    ("unlock_cargo_van", ["unlock_small_van"], {"total": 50}, 10000, "set", "vehicleLevelMax", 8),
    ("unlock_box_truck", ["unlock_cargo_van"], {"total": 60}, 22000, "set", "vehicleLevelMax", 9),
    ("unlock_tipper_truck", ["unlock_box_truck"], {"total": 70}, 48000, "set", "vehicleLevelMax", 10),
    ("unlock_tanker", ["unlock_tipper_truck"], {"total": 80}, 100000, "set", "vehicleLevelMax", 11),
    ("unlock_hazmat_truck", ["unlock_tanker"], {"total": 90}, 210000, "set", "vehicleLevelMax", 12),
    ("unlock_hazmat_semi", ["unlock_hazmat_truck"], {"total": 99}, 450000, "set", "vehicleLevelMax", 13),
    ("taxi_license", [], {"total": 20}, 500, "increment", "categoryUnlock", 1),
    ("certified_courier", [], {"total": 35}, 1000, "increment", "categoryUnlock", 1),
    ("tough_guy", [], {"total": 50}, 4000, "increment", "categoryUnlock", 1),
    ("slightly_tipsy", [], {"total": 70}, 2000, "increment", "categoryUnlock", 1),
    ("hazmat_suit", [], {"total": 90}, 8000, "increment", "categoryUnlock", 1),
    ("roadspeed_cap", ["unlock_compact_car", "speed_5"], {"total": 99}, 150000, "increment", "roadSpeedMin", 120),
    ("speed_1", [], {"total": 6}, 120, "multiply", "speed", 1.3),
    ("speed_2", ["speed_1"], {"total": 22}, 480, "multiply", "speed", 1.3),
    ("speed_3", ["speed_2"], {"total": 55}, 2500, "multiply", "speed", 1.25),
    ("speed_4", ["speed_3"], {"total": 80}, 12000, "multiply", "speed", 1.3),
    ("speed_5", ["speed_4"], {"total": 99}, 60000, "multiply", "speed", 1.25),
    ("capacity_1", [], {"FURNITURE": 8}, 140, "multiply", "capacity", 1.25),
    ("capacity_2", ["capacity_1"], {"FURNITURE": 20, "total": 25}, 520, "multiply", "capacity", 1.25),
    ("capacity_3", ["capacity_2"], {"FURNITURE": 35, "total": 40}, 1900, "multiply", "capacity", 1.2),
    ("capacity_4", ["capacity_3"], {"FURNITURE": 70, "total": 75}, 10000, "multiply", "capacity", 1.25),
    ("capacity_5", ["capacity_4"], {"FURNITURE": 99, "total": 99}, 55000, "multiply", "capacity", 1.2),
    ("xp_1", [], {"PEOPLE": 8}, 160, "multiply", "xpMultiplier", 1.35),
    ("xp_2", ["xp_1"], {"PEOPLE": 22, "total": 28}, 650, "multiply", "xpMultiplier", 1.35),
    ("xp_3", ["xp_2"], {"PEOPLE": 45, "total": 55}, 2900, "multiply", "xpMultiplier", 1.3),
    ("xp_4", ["xp_3"], {"PEOPLE": 75, "total": 80}, 15000, "multiply", "xpMultiplier", 1.35),
    ("xp_5", ["xp_4"], {"PEOPLE": 99, "total": 99}, 80000, "multiply", "xpMultiplier", 1.3),
    ("money_dist_1", [], {"GROCERIES": 8}, 130, "multiply", "moneyDistanceFactor", 1.3),
    ("money_dist_2", ["money_dist_1"], {"GROCERIES": 22, "total": 28}, 520, "multiply", "moneyDistanceFactor", 1.3),
    ("money_dist_3", ["money_dist_2"], {"GROCERIES": 45, "total": 55}, 2400, "multiply", "moneyDistanceFactor", 1.25),
    ("money_dist_4", ["money_dist_3"], {"GROCERIES": 75, "total": 80}, 12000, "multiply", "moneyDistanceFactor", 1.3),
    ("money_dist_5", ["money_dist_4"], {"GROCERIES": 99, "total": 99}, 65000, "multiply", "moneyDistanceFactor", 1.25),
    ("discount_1", [], {"PACKAGES": 10, "total": 12}, 220, "multiply", "upgradeDiscount", 0.9),
    ("discount_2", ["discount_1"], {"PACKAGES": 25, "total": 30}, 900, "multiply", "upgradeDiscount", 0.9),
    ("discount_3", ["discount_2"], {"PACKAGES": 55, "total": 60}, 4500, "multiply", "upgradeDiscount", 0.9),
    ("discount_4", ["discount_3"], {"PACKAGES": 80, "total": 85}, 25000, "multiply", "upgradeDiscount", 0.9),
    ("discount_5", ["discount_4"], {"PACKAGES": 99, "total": 99}, 150000, "multiply", "upgradeDiscount", 0.9),
    ("start_lvl_1", [], {"total": 18}, 600, "increment", "employeeLevelStart", 10),
    ("start_lvl_2", ["start_lvl_1"], {"total": 40}, 2500, "increment", "employeeLevelStart", 20),
    ("start_lvl_3", ["start_lvl_2"], {"total": 75}, 12000, "increment", "employeeLevelStart", 40),
    ("start_lvl_4", ["start_lvl_3"], {"total": 99}, 80000, "increment", "employeeLevelStart", 60),
    ("start_veh_1", ["unlock_scooter"], {"total": 22}, 650, "increment", "vehicleLevelMin", 1),
    ("start_veh_2", ["start_veh_1"], {"total": 50}, 3200, "increment", "vehicleLevelMin", 2),
    ("start_veh_3", ["start_veh_2"], {"total": 75}, 12000, "increment", "vehicleLevelMin", 3),
    ("start_veh_4", ["start_veh_3"], {"total": 99}, 80000, "increment", "vehicleLevelMin", 4),
    ("more_jobs_1", [], {"total": 25}, 600, "increment", "jobsPerTier", 1),
    ("more_jobs_2", ["more_jobs_1"], {"total": 55}, 3000, "increment", "jobsPerTier", 1),
    ("more_jobs_3", ["more_jobs_2"], {"total": 85}, 18000, "increment", "jobsPerTier", 1),
    ("fast_travel_1", [], {"total": 30}, 900, "multiply", "freeTravel", 0.9),
    ("fast_travel_2", ["fast_travel_1"], {"total": 60}, 5000, "multiply", "freeTravel", 0.85),
    ("fast_travel_3", ["fast_travel_2"], {"total": 90}, 35000, "multiply", "freeTravel", 0.75),
]


def upgrade_rows() -> list[tuple]:
    return [(u, needs, levels, float(cost), kind, name, float(amount)) for u, needs, levels, cost, kind, name, amount in UPGRADES]


def upgrade_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(upgrade_rows(), UPGRADE_SCHEMA)


def level_table(spark: SparkSession) -> DataFrame:
    """level, xp_to_reach_next, total_xp for levels 0..120."""
    levels = spark.range(1).select(F.posexplode(threshold_array()).alias("level", "total_xp"))
    return levels.withColumn(
        "step_xp", F.floor((F.col("level") + F.lit(300.0) * F.pow(F.lit(2.0), F.col("level") / 7.0)) / 4.0).cast("long")
    )


def with_level(df: DataFrame, xp_col: str, name: str = "level") -> DataFrame:
    return df.withColumn(name, level_of(xp_col))


def xp_report(games: DataFrame) -> DataFrame:
    """Level, share and XP to the next level, per category and in total.

    ``category`` is null on the total row.
    """
    per = games.select("game_id", F.explode("xp").alias("category", "xp"))
    total = games.select("game_id", F.lit(None).cast("int").alias("category"), total_xp("xp").alias("xp"))
    return per.unionByName(total).select(
        "game_id", "category", "xp", level_of("xp").alias("level"),
        percent_to_next("xp").alias("percent"), xp_to_next("xp").alias("xp_to_next"),
    )


def total_xp(xp: str) -> Column:
    return F.aggregate(F.map_values(xp), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)).cast("long"))


def effects(purchases: DataFrame, upgrades: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Effect values per game after all purchases in ``seq`` order.

    Multiplying starts from 1, adding from 0, setting replaces. Every step is
    a map x -> a*x + b, so runs of ``chunk`` purchases are folded on their
    own and then joined in order; one game's history is never one list.
    """
    steps = purchases.join(upgrades.select("upgrade_id", "kind", "effect", "amount"), "upgrade_id")
    placed = dense_positions(steps, [F.col("seq"), F.col("upgrade_id")], ["game_id", "effect"], "_at")
    a = F.when(F.col("kind") == "multiply", F.col("amount")).when(F.col("kind") == "increment", 1.0).otherwise(0.0)
    b = F.when(F.col("kind") == "multiply", 0.0).otherwise(F.col("amount"))
    start = F.when(F.col("kind") == "multiply", 1.0).otherwise(0.0)
    rows = placed.withColumn("_part", F.floor(F.col("_at") / chunk))

    def fold(items: Column) -> Column:
        return F.aggregate(
            F.array_sort(items),
            F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, s: F.struct((acc["a"] * s["a"]).alias("a"), (acc["b"] * s["a"] + s["b"]).alias("b")),
        )

    parts = rows.groupBy("game_id", "effect", "_part").agg(
        fold(F.collect_list(F.struct(F.col("_at").alias("at"), a.alias("a"), b.alias("b")))).alias("f"),
        F.min(F.struct(F.col("_at"), start.alias("x"))).alias("s"),
    )
    whole = parts.groupBy("game_id", "effect").agg(
        fold(F.collect_list(F.struct(F.col("_part").alias("at"), F.col("f.a").alias("a"), F.col("f.b").alias("b")))).alias("f"),
        F.min("s").alias("s"),
    )
    return whole.select("game_id", "effect", (F.col("f.a") * F.col("s.x") + F.col("f.b")).alias("value"))


def levels_by_name(xp: str) -> Column:
    """Level per category name and of the total, which no row of a request needs anew."""
    names = [F.lit("total"), *[F.lit(c) for c in CATEGORIES]]
    per = [level_of(F.coalesce(F.try_element_at(F.col(xp), F.lit(i)).cast("long"), F.lit(0).cast("long"))) for i in range(len(CATEGORIES))]
    return F.map_from_arrays(F.array(*names), F.array(level_of(total_xp(xp)), *per))


def levels_reached(levels: Column, have: str) -> Column:
    """All level requirements hold; unknown category names are ignored."""
    def ok(e: Column) -> Column:
        level = F.try_element_at(F.col(have), e["key"])
        return F.when(level.isNull(), F.lit(True)).otherwise(level >= e["value"])

    return F.forall(F.map_entries(levels), ok)


def levels_met(levels: Column, xp: str) -> Column:
    """All level requirements hold; unknown category names are ignored."""
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    total = level_of(total_xp(xp))

    def ok(e: Column) -> Column:
        no = F.try_element_at(numbers, e["key"])
        have = level_of(F.coalesce(F.try_element_at(F.col(xp), no).cast("long"), F.lit(0).cast("long")))
        return F.when(e["key"] == "total", total >= e["value"]).when(no.isNull(), F.lit(True)).otherwise(have >= e["value"])

    return F.forall(F.map_entries(levels), ok)


def upgrade_eligibility(games: DataFrame, upgrades: DataFrame) -> DataFrame:
    """Status of every upgrade for every game, one game row at a time.

    The definitions travel as one array value, so no join is needed. Use
    ``upgrade_order`` to sort what a game is shown.
    """
    fields = ["upgrade_id", "requires", "levels", "cost", "kind", "effect", "amount"]
    every = upgrades.agg(F.array_sort(F.collect_list(F.struct(
        "upgrade_id", "requires", F.map_entries("levels").alias("levels"), "cost", "kind", "effect", "amount"
    ))).alias("u")).scalar()
    rows = games.select("game_id", "money", "xp", "upgrades", F.explode(every).alias("u"))
    rows = rows.select("game_id", "money", "xp", "upgrades", *[F.col(f"u.{f}").alias(f) for f in fields])
    missing = F.array_except("requires", F.coalesce("upgrades", F.array().cast("array<string>")))
    rows = rows.withColumn("missing", missing).withColumn("dependencies_met", F.size("missing") == 0)
    rows = rows.withColumn("levels_met", levels_met(F.map_from_entries("levels"), "xp"))
    rows = rows.withColumn("enough_money", F.col("money") >= F.col("cost"))
    rows = rows.withColumn("owned", F.array_contains("upgrades", F.col("upgrade_id")))
    rows = rows.withColumn("requirements_met", F.col("dependencies_met") & F.col("levels_met"))
    rows = rows.withColumn("can_purchase", F.col("requirements_met") & F.col("enough_money"))
    return rows.select("game_id", "upgrade_id", "cost", "missing", "dependencies_met", "levels_met", "enough_money",
                       "owned", "requirements_met", "can_purchase")


def upgrade_order() -> list[Column]:
    """Vehicles first, then what can be bought, then what lacks money, then cost."""
    return [
        F.col("upgrade_id").startswith("unlock_").desc(), F.col("can_purchase").desc(),
        F.col("requirements_met").desc(), F.col("cost").asc(), F.col("upgrade_id").asc(),
    ]


def apply_purchases(games: DataFrame, requests: DataFrame, upgrades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay upgrade requests in order; returns (games, outcomes).

    ``requests``: request_id, game_id, upgrade_id, seq. A request needs its
    upgrade's dependencies, levels and money at its turn. Between two
    purchases a game does not change, so its next purchase is the earliest
    later request it can afford: one aggregate per round for all games, and
    as many rounds as the longest purchase history, which the number of
    upgrades bounds. Requests that are past, owned or too dear stay so and
    leave the rounds. Games and requests both grow, so they meet by shuffle.
    """
    u = F.broadcast(upgrades.select("upgrade_id", "requires", "levels", "cost", "kind", "effect", "amount"))
    no_ids = F.array().cast("array<string>")
    base = cut(games.select(
        "game_id", F.col("money").cast("double").alias("money"), F.coalesce("upgrades", no_ids).alias("owned"),
        F.coalesce("effects", F.map_from_arrays(no_ids, F.array().cast("array<double>"))).alias("eff"), levels_by_name("xp").alias("have"),
    ))
    reqs = requests.join(u, "upgrade_id").join(base.select("game_id", "have").hint("merge"), "game_id")
    live = cut(reqs.where(levels_reached(F.col("levels"), "have")).select(
        "game_id", F.struct("seq", "request_id").alias("turn"), "upgrade_id", "requires", "cost", "kind", "effect", "amount"
    ))
    asks, turn = live.columns, live.schema["turn"].dataType
    state = cut(base.drop("have").withColumns({
        "last": F.lit(None).cast(turn), "log": F.array().cast(f"array<struct<turn:{turn.simpleString()},upgrade_id:string,cost:double>>"),
    }))
    while True:
        live = cut(live.join(state.select("game_id", "money", "owned", "last").hint("merge"), "game_id").where(
            (F.col("last").isNull() | (F.col("turn") > F.col("last")))
            & ~F.array_contains("owned", F.col("upgrade_id"))
            & (F.col("money") >= F.col("cost"))
        ).select(*asks, (F.size(F.array_except("requires", "owned")) == 0).alias("able")))
        nxt = live.where("able").groupBy("game_id").agg(F.min(F.struct("turn", "upgrade_id", "cost", "kind", "effect", "amount")).alias("n"))
        now = F.try_element_at("eff", F.col("n.effect"))
        value = (
            F.when(F.col("n.kind") == "multiply", F.coalesce(now, F.lit(1.0)) * F.col("n.amount"))
            .when(F.col("n.kind") == "increment", F.coalesce(now, F.lit(0.0)) + F.col("n.amount"))
            .otherwise(F.col("n.amount"))
        )
        moved = state.join(nxt.hint("merge"), "game_id", "left")
        got = F.col("n").isNotNull()
        changed = F.map_concat(F.map_filter("eff", lambda k, _v: k != F.col("n.effect")), F.create_map(F.col("n.effect"), value))
        state, seen = cut_with(moved.select(
            "game_id",
            F.when(got, F.col("money") - F.col("n.cost")).otherwise(F.col("money")).alias("money"),
            F.when(got, F.array_append("owned", F.col("n.upgrade_id"))).otherwise(F.col("owned")).alias("owned"),
            F.when(got, changed).otherwise(F.col("eff")).alias("eff"),
            F.coalesce("n.turn", "last").alias("last"),
            F.when(got, F.array_append("log", F.struct("n.turn", "n.upgrade_id", "n.cost"))).otherwise(F.col("log")).alias("log"),
            got.alias("got"),
        ), moved=F.sum(F.when(F.col("got"), 1).otherwise(0)))
        state = state.drop("got")
        if not seen["moved"]:
            break
    out = games.join(state.select("game_id", F.col("money").alias("_m"), "owned", "eff").hint("merge"), "game_id").select(*[
        {"money": F.col("_m").alias("money"), "upgrades": F.col("owned").alias("upgrades"), "effects": F.col("eff").alias("effects")}.get(c, F.col(c))
        for c in games.columns
    ])
    # What each request met: the part of its game's short log before its turn.
    asked = requests.withColumn("turn", F.struct("seq", "request_id")).join(u.select("upgrade_id", "requires", "levels", "cost"), "upgrade_id", "left")
    asked = asked.join(base.select("game_id", "have", F.col("money").alias("_m0"), F.col("owned").alias("_u0")).hint("merge"), "game_id", "left")
    asked = asked.join(state.select("game_id", "log").hint("merge"), "game_id", "left")
    before = F.filter("log", lambda e: e["turn"] < F.col("turn"))
    owned = F.concat("_u0", F.transform(before, lambda e: e["upgrade_id"]))
    spent = F.aggregate(before, F.lit(0.0), lambda a, e: a + e["cost"])
    won = F.exists("log", lambda e: e["turn"] == F.col("turn"))
    status = (
        F.when(F.col("log").isNull(), "no such game").when(F.col("cost").isNull(), "no such upgrade").when(won, "bought")
        .when(F.array_contains(owned, F.col("upgrade_id")), "already bought")
        .when(F.size(F.array_except("requires", owned)) > 0, "requirements")
        .when(~levels_reached(F.col("levels"), "have"), "level").when(F.col("_m0") - spent < F.col("cost"), "funds").otherwise("funds")
    )
    return out, asked.select(*requests.columns, status.alias("status"))


def apply_vehicle_purchases(
    employees: DataFrame, games: DataFrame, requests: DataFrame, vehicles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replay vehicle requests in order; returns (employees, games, bought).

    ``requests``: request_id, employee_id, seq. Each success moves an
    employee one level up. Money only shrinks and a refused employee keeps
    asking for the same level, so a refused price is refused for good: each
    round adds up prices in order, finds the first refusal per game, and
    strikes that price and dearer ones from there on. Distinct prices bound
    the number of rounds.
    """
    spark = employees.sparkSession
    if vehicles is None:
        vehicles = spark.createDataFrame([(v[1], float(v[6]), v[9]) for v in VEHICLES], "level int, purchase_cost double, purchase_level int")
    top = int(vehicles.agg(F.max("level")).first()[0])
    turns = W.partitionBy("employee_id").orderBy("seq", "request_id")
    # No employee can move more than ``top`` levels, so later asks are moot.
    asks = requests.select("request_id", "employee_id", "seq").withColumn("nth", F.row_number().over(turns)).where(F.col("nth") <= top)
    rules = games.select("game_id", effect("vehicleLevelMax", 0).cast("int").alias("_max"), effect("upgradeDiscount", 0).alias("_off"),
                         F.col("money").cast("double").alias("money"))
    e = employees.select("employee_id", "game_id", "vehicle_level", level_of(F.coalesce("xp", F.lit(0).cast("long"))).alias("_lvl"))
    cand = asks.join(e, "employee_id").join(rules, "game_id").withColumn("target", F.col("vehicle_level") + F.col("nth"))
    v = vehicles.select(F.col("level").alias("target"), F.col("purchase_cost").alias("_c"), F.col("purchase_level").alias("_need"))
    cand = cand.join(v, "target", "left")
    fine = F.coalesce((F.col("target") <= F.col("_max")) & F.col("_c").isNotNull() & (F.col("_lvl") >= F.col("_need")) & (F.col("_c") > 0), F.lit(False))
    stuck = F.max(F.when(~fine, 1).otherwise(0)).over(turns.rowsBetween(W.unboundedPreceding, W.currentRow))
    cand = cand.withColumn("_stuck", stuck).where("_stuck = 0").select(
        "request_id", "employee_id", "game_id", "seq", "target", "nth", "money", F.floor(F.col("_c") * (1 - F.col("_off"))).cast("double").alias("cost")
    )
    live = cut(cand)
    while True:
        run = cut(running_sum(live, "cost", [F.col("seq"), F.col("request_id")], ["game_id"], "spent"))
        turn = F.struct("seq", "request_id")
        first, seen = cut_with(run.where("spent > money").groupBy("game_id").agg(F.min(F.struct(turn.alias("turn"), "cost")).alias("f")))
        if seen["rows"] == 0:
            break
        # One game's first refusal strikes its price from that turn on.
        marked = live.join(first, "game_id", "left").withColumn(
            "_out", F.coalesce((turn >= F.col("f.turn")) & (F.col("cost") >= F.col("f.cost")), F.lit(False))
        )
        gone = F.max(F.col("_out").cast("int")).over(turns.rowsBetween(W.unboundedPreceding, W.currentRow))
        live = cut(marked.withColumn("_gone", gone).where("_gone = 0").drop("_gone", "_out", "f"))
    bought = run.select("request_id", "employee_id", "game_id", "target", "cost")
    up = bought.groupBy("employee_id").agg(F.max("target").alias("_t"))
    emp = employees.join(up, "employee_id", "left").select(*[
        F.coalesce("_t", "vehicle_level").alias("vehicle_level") if c == "vehicle_level" else F.col(c) for c in employees.columns
    ])
    paid = bought.groupBy("game_id").agg(F.sum("cost").alias("_p"))
    gm = games.join(paid, "game_id", "left").select(*[
        (F.col("money") - F.coalesce("_p", F.lit(0.0))).alias("money") if c == "money" else F.col(c) for c in games.columns
    ])
    return emp, gm, bought
