"""Job search, acceptance, settlement, travel and progress as table jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import cut_with
from .routing import position_at
from .tiles import build_tile_index, nearest


@dataclass(frozen=True)
class GameConfig:
    """Money and experience factors."""

    distance_factor: float = 20.0
    xp_per_euro: float = 100.0
    money_multiplier: float = 1.0
    xp_multiplier: float = 1.0
    speed_multiplier: float = 0.01
    search_radius_m: float = 5000.0
    jobs_per_tier: int = 2
    hiring_base: float = 1.0
    hiring_exponent: float = 1.25
    first_employee_free: bool = True


# Id, level, name, capacity kg, road speed km/h, tier,
# purchase cost, unlock cost, unlock level, purchase level.
VEHICLES = [
    ("bike", 0, "Bike", 10, 15, 1, 0, 0, 0, 0),
    ("pannier_bike", 1, "Pannier Bike", 25, 18, 1, 12, 20, 3, 2),
    ("e_bike", 2, "E-Bike", 20, 25, 2, 28, 60, 6, 4),
    ("cargo_bike", 3, "Cargo Bike", 80, 20, 2, 60, 150, 10, 6),
    ("scooter", 4, "Scooter", 50, 45, 3, 130, 400, 15, 9),
    ("motorbike_125", 5, "Motorbike 125", 80, 70, 3, 260, 900, 22, 13),
    ("compact_car", 6, "Compact Car", 250, 120, 4, 520, 2000, 30, 18),
    ("small_van", 7, "Small Van", 700, 110, 4, 1050, 4500, 40, 24),
    ("cargo_van", 8, "Cargo Van", 1200, 105, 5, 2100, 10000, 50, 30),
    ("box_truck", 9, "Box Truck", 3500, 90, 6, 4200, 22000, 60, 36),
    ("tipper_truck", 10, "Tipper Truck", 5000, 85, 6, 8500, 48000, 70, 42),
    ("tanker", 11, "Tanker", 8000, 80, 7, 17000, 100000, 80, 48),
    ("hazmat_truck", 12, "Hazmat Truck", 12000, 80, 8, 34000, 210000, 90, 55),
    ("hazmat_semi", 13, "Hazmat Semi", 18000, 75, 8, 70000, 450000, 99, 60),
]
VEHICLE_FIELDS = [
    "vehicle_id", "level", "name", "capacity", "road_speed", "tier",
    "purchase_cost", "unlock_cost", "unlock_level", "purchase_level",
]
DEFAULT_TIER, DEFAULT_CAPACITY, DEFAULT_SPEED = 1, 10, 15


def _by_level(field: str, level: Column, default: int) -> Column:
    at = VEHICLE_FIELDS.index(field)
    pairs = [F.lit(x) for v in VEHICLES for x in (v[1], v[at])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level.cast("int")), F.lit(default))


def with_vehicle(df: DataFrame, vehicles: DataFrame | None = None, level: str = "vehicle_level") -> DataFrame:
    """Tier, capacity and speed of each row's vehicle level, with defaults."""
    lv = F.col(level)
    if vehicles is None:
        return df.withColumns({
            "vehicle_tier": _by_level("tier", lv, DEFAULT_TIER),
            "capacity": _by_level("capacity", lv, DEFAULT_CAPACITY),
            "road_speed": _by_level("road_speed", lv, DEFAULT_SPEED),
        })
    v = vehicles.select(F.col("level").alias("_lv"), F.col("tier").alias("_t"), F.col("capacity").alias("_c"), F.col("road_speed").alias("_s"))
    out = df.join(v, lv == F.col("_lv"), "left")
    return out.withColumns({
        "vehicle_tier": F.coalesce("_t", F.lit(DEFAULT_TIER)), "capacity": F.coalesce("_c", F.lit(DEFAULT_CAPACITY)),
        "road_speed": F.coalesce("_s", F.lit(DEFAULT_SPEED)),
    }).drop("_lv", "_t", "_c", "_s")


def effect(name: str, default: float, effects: str = "effects") -> Column:
    return F.coalesce(F.try_element_at(F.col(effects), F.lit(name)), F.lit(float(default)))


def reward(km: Column, money_factor: Column, config: GameConfig) -> Column:
    return km * config.distance_factor * money_factor * config.money_multiplier


def offer_xp(km: Column, xp_factor: Column, config: GameConfig) -> Column:
    return F.floor(km * config.distance_factor * config.xp_per_euro * config.xp_multiplier * xp_factor).cast("long")


def xp_gain(xp: Column, factor: Column) -> Column:
    """Whole XP after the multiplier; nothing for negative amounts or factors."""
    return F.when((xp < 0) | (factor < 0), F.lit(0)).otherwise(F.floor(xp * factor)).cast("long")


def knn_jobs(
    employees: DataFrame, jobs: DataFrame, k: int = 2, radius_m: float = 5000.0, k_col: str | None = None
) -> DataFrame:
    """Closest jobs per employee and tier up to the vehicle's, within a radius.

    ``radius_m`` is in Web-Mercator metres, not on the ground. ``employees``
    has employee_id, lat, lon, vehicle_tier; ``jobs`` has job_id, tier, x, y.
    ``k_col`` names a per-employee number of jobs, ``k`` its largest value.
    """
    asks = employees.where(F.col("vehicle_tier") >= 1).select(
        "employee_id", *([k_col] if k_col else []), geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y"),
        F.explode(F.sequence(F.lit(1), F.col("vehicle_tier").cast("int"))).alias("tier"),
    )
    index = build_tile_index(jobs, "job_id", "x", "y", metric="planar", group="tier", k=k)
    hits = nearest(asks, index, "employee_id", "x", "y", group="tier", max_distance=radius_m)
    out = hits.select("employee_id", F.col("tier").cast("int").alias("tier"), F.col("near_id").alias("job_id"),
                      F.col("near_rank").alias("rank"), "distance")
    if k_col:
        out = out.join(employees.select("employee_id", k_col), "employee_id").where(F.col("rank") <= F.col(k_col)).drop(k_col)
    return out


def idle_employees(employees: DataFrame, active: DataFrame, travel: DataFrame) -> DataFrame:
    """Employees with neither a started job nor a started travel."""
    busy = active.where("start_time is not null").select("employee_id").unionByName(
        travel.where("start_time is not null").select("employee_id")
    )
    return employees.join(busy, "employee_id", "left_anti")


@dataclass
class Search:
    offers: DataFrame
    active: DataFrame


def search_jobs(
    employees: DataFrame, jobs: DataFrame, games: DataFrame, active: DataFrame, travel: DataFrame,
    config: GameConfig = GameConfig(),
) -> Search:
    """New offers for idle employees, replacing their unstarted ones.

    Each game's ``jobsPerTier`` effect says how many jobs of a tier are
    offered; the largest one among the seekers sizes the job index.
    """
    idle = idle_employees(employees, active, travel)
    rules = games.select(
        "game_id", effect("moneyDistanceFactor", 1).alias("_money"), effect("xpMultiplier", 1).alias("_xp"),
        effect("jobsPerTier", config.jobs_per_tier).cast("int").alias("_k"),
    )
    seekers, seen = cut_with(with_vehicle(idle).join(rules, "game_id"), most=F.max("_k"))
    found = knn_jobs(seekers, jobs, max(1, seen["most"] or 0), config.search_radius_m, "_k")
    terms = jobs.select("job_id", "start_address", "end_address", "category", "km")
    offers = found.join(terms, "job_id").join(
        seekers.select("employee_id", "game_id", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), "_money", "_xp"), "employee_id"
    )
    offers = offers.select(
        "employee_id", "game_id", "job_id", "tier", "rank", "category", "start_address", "end_address", "start_lat", "start_lon",
        reward(F.col("km"), F.col("_money"), config).alias("reward"), offer_xp(F.col("km"), F.col("_xp"), config).alias("xp"),
    )
    stale = F.col("start_time").isNull()
    kept = active.where(~stale).unionByName(
        active.where(stale).join(idle.select("employee_id"), "employee_id", "left_anti").select(*active.columns)
    )
    return Search(offers, kept)


def elapsed_s(as_of: Column, start: str = "start_time") -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def is_finished(as_of: Column) -> Column:
    done = elapsed_s(as_of) >= F.coalesce(F.col("duration_s"), F.lit(0.0))
    return F.col("start_time").isNotNull() & done


def finished(df: DataFrame, as_of: Column) -> DataFrame:
    """Started rows whose duration has passed at ``as_of``."""
    return df.where(is_finished(as_of))


@dataclass
class Settlement:
    employees: DataFrame
    games: DataFrame
    remaining: DataFrame
    totals: DataFrame


def settle(active: DataFrame, employees: DataFrame, games: DataFrame, addresses: DataFrame, as_of: Column) -> Settlement:
    """Pay out all finished jobs at once.

    Employees gain XP and move to the delivery of their latest finished job,
    games gain money and XP per category, the jobs go. Jobs whose employee,
    game or delivery address is unknown stay.
    """
    factor = games.select("game_id", effect("xpMultiplier", 1).alias("_f"))
    done = (
        finished(active.where(F.col("duration_s").isNotNull()), as_of)
        .join(factor, "game_id")
        .join(employees.select("employee_id"), "employee_id", "left_semi")
        .join(addresses.select(F.col("id").alias("delivery"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "delivery")
        .withColumn("gain", xp_gain(F.col("xp"), F.col("_f")))
    )
    per_employee = done.groupBy("employee_id").agg(
        F.sum("gain").alias("_gain"),
        F.max(F.struct("start_time", "active_id", "_lat", "_lon")).alias("_at"),
    )
    emp = employees.join(per_employee, "employee_id", "left").select(
        *[
            {
                "xp": (F.col("xp") + F.coalesce("_gain", F.lit(0))).alias("xp"),
                "lat": F.coalesce("_at._lat", "lat").alias("lat"),
                "lon": F.coalesce("_at._lon", "lon").alias("lon"),
            }.get(c, F.col(c))
            for c in employees.columns
        ]
    )
    per_category = done.groupBy("game_id", "category").agg(
        F.sum("gain").alias("gain"), F.sum("reward").alias("reward"), F.count(F.lit(1)).alias("jobs")
    )
    # A game has a handful of categories, so this list stays short.
    totals = per_category.groupBy("game_id").agg(
        F.sum("reward").alias("reward"), F.sum("jobs").alias("jobs"),
        F.map_from_entries(F.filter(F.collect_list(F.struct(F.col("category").cast("int").alias("k"), F.col("gain").alias("v"))), lambda e: e["v"] != 0)).alias("gains"),
    )
    gm = games.join(totals.select("game_id", F.col("reward").alias("_r"), F.col("gains").alias("_g")), "game_id", "left").select(
        *[
            {
                "money": (F.col("money") + F.coalesce("_r", F.lit(0.0))).alias("money"),
                "xp": F.when(F.col("_g").isNull(), F.col("xp")).otherwise(merge_xp("xp", "_g")).alias("xp"),
            }.get(c, F.col(c))
            for c in games.columns
        ]
    )
    remaining = active.join(done.select("active_id"), "active_id", "left_anti").select(*active.columns)
    return Settlement(emp, gm, remaining, totals)


def merge_xp(old: str, gains: str) -> Column:
    """Sum of two XP maps by category; a missing category counts as 0."""
    zero = F.lit(0).cast("long")
    return F.map_zip_with(F.col(old), F.col(gains), lambda _k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def accept(active: DataFrame, choices: DataFrame, as_of: Column) -> DataFrame:
    """Start the chosen offers and drop the offers they rule out.

    ``choices`` has active_id and chosen_at. An employee takes one offer and
    a job one employee: of competing choices the earlier wins, then the
    smaller id; a choice that loses its job does not start another.
    """
    wanted = choices.groupBy("active_id").agg(F.min("chosen_at").alias("chosen_at"))
    cand = active.where("start_time is null").join(wanted, "active_id").select("active_id", "employee_id", "job_id", "chosen_at")
    first = F.struct("chosen_at", "active_id")
    by_employee = cand.groupBy("employee_id").agg(F.min(first).alias("_e"))
    one = cand.join(by_employee, "employee_id").where(F.col("_e.active_id") == F.col("active_id"))
    by_job = one.groupBy("job_id").agg(F.min(first).alias("_j")).where("job_id is not null").select(F.col("_j.active_id").alias("active_id"))
    free = one.where("job_id is null").select("active_id")
    won = cand.join(by_job.unionByName(free), "active_id", "left_semi")
    started = active.join(won.select("active_id"), "active_id", "left_semi").withColumn("start_time", as_of.cast(active.schema["start_time"].dataType))
    rest = active.join(won.select("active_id"), "active_id", "left_anti")
    rest = rest.join(won.select("employee_id"), "employee_id", "left_anti")
    rest = rest.join(won.where("job_id is not null").select("job_id"), "job_id", "left_anti")
    return started.select(*active.columns).unionByName(rest.select(*active.columns))


@dataclass
class TravelCleanup:
    employees: DataFrame
    travel: DataFrame
    cleaned: DataFrame


def clean_travel(travel: DataFrame, employees: DataFrame, as_of: Column, legacy: bool = False) -> TravelCleanup:
    """Finish due travels and drop all but the latest of the others.

    ``travel``: travel_id, employee_id, start_time, duration_s, to_lat,
    to_lon. Of several finished travels the newest destination counts, or
    with ``legacy`` the oldest. Travels not started are left alone.
    """
    started = travel.where("start_time is not null")
    latest = started.groupBy("employee_id").agg(F.max(F.struct("start_time", "travel_id")).alias("_l"))
    marked = started.join(latest, "employee_id").withColumn("done", is_finished(as_of)).withColumn(
        "newest", F.col("_l.travel_id") == F.col("travel_id")
    )
    cleaned = marked.where(F.col("done") | ~F.col("newest")).select("travel_id", "employee_id", "done")
    order = F.struct("start_time", "travel_id", "to_lat", "to_lon")
    arrive = marked.where("done").groupBy("employee_id").agg((F.min(order) if legacy else F.max(order)).alias("_a"))
    emp = employees.join(arrive, "employee_id", "left").select(*[
        {"lat": F.coalesce("_a.to_lat", "lat").alias("lat"), "lon": F.coalesce("_a.to_lon", "lon").alias("lon")}.get(c, F.col(c))
        for c in employees.columns
    ])
    kept = travel.join(cleaned.select("travel_id"), "travel_id", "left_anti").select(*travel.columns)
    return TravelCleanup(emp, kept, cleaned)


def with_order(employees: DataFrame, game: str = "game_id", key: str = "employee_id") -> DataFrame:
    """Hire order from 0 within each game, even for one very large game."""
    from .ranking import dense_positions

    return dense_positions(employees, [F.col(key)], [game], "hire_order")


def with_addresses(jobs: DataFrame, addresses: DataFrame) -> DataFrame:
    """Start and end address columns of each job."""
    def side(p: str) -> DataFrame:
        return addresses.select(F.col("id").alias(f"{p}_address"), *[F.col(c).alias(f"{p}_{c}") for c in addresses.columns if c != "id"])
    return jobs.join(side("start"), "start_address").join(side("end"), "end_address")


def with_start_location(jobs: DataFrame, addresses: DataFrame) -> DataFrame:
    """Location struct and coordinates of each job from its start address."""
    at = addresses.select(F.col("id").alias("start_address"), "lat", "lon")
    return jobs.join(at, "start_address").withColumn("location", F.to_json(F.struct("lat", "lon")))


def coordinates_of(df: DataFrame, location: str = "location") -> DataFrame:
    """lat and lon read back from a JSON location."""
    def field(n: str) -> Column:
        return F.get_json_object(location, f"$.{n}").try_cast("double")
    return df.withColumn("lat", field("lat")).withColumn("lon", field("lon"))


def without_jobs(addresses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Addresses no job starts from."""
    return addresses.join(jobs.select(F.col("start_address").alias("id")), "id", "left_anti")


def job_parties(active: DataFrame, employees: DataFrame, games: DataFrame) -> DataFrame:
    """Active jobs with their employee's and game's columns."""
    e = employees.select("employee_id", *[F.col(c).alias(f"employee_{c}") for c in employees.columns if c not in ("employee_id", "game_id")])
    g = games.select("game_id", *[F.col(c).alias(f"game_{c}") for c in games.columns if c != "game_id"])
    return active.join(e, "employee_id").join(g, "game_id")


def addresses_in_use(addresses: DataFrame, active: DataFrame) -> DataFrame:
    """Addresses referred to by any active job."""
    used = active.select(F.col("pickup").alias("id")).unionByName(active.select(F.col("delivery").alias("id")))
    return addresses.join(used, "id", "left_semi")


def fleet(employees: DataFrame, active: DataFrame, travel: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row per employee in hire order: started job, its ends, travel."""
    started = active.where("start_time is not null")
    job = started.groupBy("employee_id").agg(F.max(F.struct("start_time", "active_id", "pickup", "delivery", "duration_s")).alias("_j"))
    trip = travel.where("start_time is not null").groupBy("employee_id").agg(
        F.max(F.struct("start_time", "travel_id", "to_lat", "to_lon")).alias("_t")
    )
    out = with_order(employees).join(job, "employee_id", "left").join(trip, "employee_id", "left")
    out = out.withColumns({
        "active_id": F.col("_j.active_id"), "pickup": F.col("_j.pickup"), "delivery": F.col("_j.delivery"), "travel_id": F.col("_t.travel_id"),
        "travel_lat": F.col("_t.to_lat"), "travel_lon": F.col("_t.to_lon"),
    }).drop("_j", "_t")
    for side in ("pickup", "delivery"):
        a = addresses.select(F.col("id").alias(side), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
        out = out.join(a, side, "left")
    return out


def progress(df: DataFrame, as_of: Column) -> DataFrame:
    """Percent done (at most 100), seconds left (at least 0), complete flag."""
    e = elapsed_s(as_of)
    d = F.coalesce("duration_s", F.lit(0.0))
    share = F.when(d > 0, e * 100.0 / F.nullif(d, F.lit(0.0))).otherwise(100.0)
    return df.where("start_time is not null").withColumns({
        "percent": F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)),
        "remaining_s": F.greatest(d - e, F.lit(0.0)), "complete": e >= d,
    })


@dataclass
class Cancelled:
    employees: DataFrame
    active: DataFrame


def cancel(
    active: DataFrame, points: DataFrame, requests: DataFrame, employees: DataFrame, as_of: Column
) -> Cancelled:
    """Stop the requested started jobs where their employees are at ``as_of``.

    ``points`` are route points with ``route_id`` = active_id. A job without
    a route leaves the employee at the job's start coordinate.
    """
    stop = active.where("start_time is not null").join(requests.select("active_id"), "active_id", "left_semi")
    asks = stop.select("active_id", "employee_id", F.col("active_id").alias("route_id"), elapsed_s(as_of).alias("at_s"),
                       "start_time", "start_lat", "start_lon")
    at = position_at(points, asks, query="active_id")
    at = at.select("employee_id", "start_time", "active_id",
                   F.coalesce("lat", "start_lat").alias("_lat"), F.coalesce("lon", "start_lon").alias("_lon"))
    last = at.groupBy("employee_id").agg(F.max(F.struct("start_time", "active_id", "_lat", "_lon")).alias("_p"))
    emp = employees.join(last, "employee_id", "left").select(*[
        {"lat": F.coalesce("_p._lat", "lat").alias("lat"), "lon": F.coalesce("_p._lon", "lon").alias("lon")}.get(c, F.col(c))
        for c in employees.columns
    ])
    return Cancelled(emp, active.join(stop.select("active_id"), "active_id", "left_anti").select(*active.columns))


def hiring_costs(employees: DataFrame, games: DataFrame, config: GameConfig = GameConfig()) -> DataFrame:
    """Cost of each game's next employee from how many it has."""
    n = employees.groupBy("game_id").agg(F.count(F.lit(1)).alias("employees"))
    out = games.select("game_id").join(n, "game_id", "left").withColumn("employees", F.coalesce("employees", F.lit(0)).cast("long"))
    cost = F.lit(float(config.hiring_base)) * F.pow(F.col("employees").cast("double"), F.lit(float(config.hiring_exponent)))
    if config.first_employee_free:
        cost = F.when(F.col("employees") == 0, F.lit(0.0)).otherwise(cost)
    return out.withColumn("next_cost", cost)
