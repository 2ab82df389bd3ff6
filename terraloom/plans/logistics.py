"""Queries over jobs, fleets, settlement, progression and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import level_of, thresholds
from ..operators import fleet as FL
from ..operators import generation as GN
from ..operators import progression as PG
from ..operators import reports as RP
from ..scratch import cut
from ..sources import writers as WR
from ..streaming import jobs as ST
from . import derive as D
from .oracle import AS_OF, NCUST, VEHICLE_TIER, lat_of, level, lon_of, merc_x, merc_y, with_
from .registry import query


def addr_points(spark, sf):
    return D.addresses(spark, sf).select("id", "lat", "lon")


# --- joins over jobs -----------------------------------------------------------

@query("addresses_without_jobs", with_("addr job", "SELECT id, city FROM addr WHERE id NOT IN (SELECT start_address FROM job WHERE km > 40)"))
def _(spark, sf):
    return FL.without_jobs(D.addresses(spark, sf), D.jobs(spark, sf).where("km > 40")).select("id", "city")


@query("jobs_with_addresses", with_("addr job", "SELECT job_id, a.city AS start_city, b.city AS end_city, round(a.lat, 6) AS start_lat, round(b.lat, 6) AS end_lat FROM job JOIN addr a ON a.id = start_address JOIN addr b ON b.id = end_address"))
def _(spark, sf):
    j = FL.with_addresses(D.jobs(spark, sf), D.addresses(spark, sf))
    return j.select("job_id", "start_city", "end_city", F.round("start_lat", 6).alias("start_lat"), F.round("end_lat", 6).alias("end_lat"))


@query("jobs_with_location", with_("addr job", "SELECT job_id, round(a.lat, 6) AS lat, round(a.lon, 6) AS lon FROM job JOIN addr a ON a.id = start_address"))
def _(spark, sf):
    j = FL.with_start_location(D.jobs(spark, sf), addr_points(spark, sf)).select("job_id", "location")
    return FL.coordinates_of(j).select("job_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("job_parties", with_("active eemp egame", "SELECT active_id, e.vehicle_level AS employee_vehicle_level, g.money AS game_money FROM active a JOIN eemp e ON e.employee_id = a.employee_id JOIN egame g ON g.game_id = a.game_id"))
def _(spark, sf):
    p = FL.job_parties(D.active(spark, sf), D.event_employees(spark, sf), D.event_games(spark, sf))
    return p.select("active_id", "employee_vehicle_level", "game_money")


@query("addresses_in_use", with_("addr active", "SELECT id FROM addr WHERE id IN (SELECT pickup FROM active UNION ALL SELECT delivery FROM active)"))
def _(spark, sf):
    return FL.addresses_in_use(addr_points(spark, sf), D.active(spark, sf)).select("id")


# --- search --------------------------------------------------------------------

KNN = (
    f"seek AS (SELECT e.*, {merc_x('e.lon')} AS ex, {merc_y('e.lat')} AS ey, {VEHICLE_TIER}[vehicle_level + 1] AS vt FROM emp e), "
    "cand AS (SELECT s.employee_id, s.game_id, j.*, sqrt(pow(s.ex - j.x, 2) + pow(s.ey - j.y, 2)) AS d FROM seek s JOIN job j ON j.tier <= s.vt AND abs(s.ex - j.x) <= 30000 AND abs(s.ey - j.y) <= 30000), "
    "knn AS (SELECT *, row_number() OVER (PARTITION BY employee_id, tier ORDER BY d, job_id) AS rn FROM cand WHERE d <= 30000) "
)


def knn_sql(body: str) -> str:
    return with_("job emp", "SELECT").removesuffix(" SELECT") + ", " + KNN + body


@query("closest_jobs", knn_sql("SELECT employee_id, tier, job_id, CAST(rn AS INTEGER) AS rank, round(d, 3) AS distance FROM knn WHERE rn <= 2"))
def _(spark, sf):
    e = FL.with_vehicle(D.employees(spark, sf))
    k = FL.knn_jobs(e, D.jobs(spark, sf), 2, 30000.0)
    return k.select("employee_id", "tier", "job_id", "rank", F.round("distance", 3).alias("distance"))


JOBS_PER_TIER = (1, 2, 3, 5)


def supplier_games(spark, sf):
    """A game per nation of some supplier."""
    g = D.employees(spark, sf).select("game_id").distinct()
    return g.withColumn("effects", F.create_map(F.lit("moneyDistanceFactor"), F.lit(1.0) + F.lit(0.5) * (F.col("game_id") % 2),
                                                F.lit("xpMultiplier"), F.lit(1.0) + F.lit(0.25) * (F.col("game_id") % 3),
                                                F.lit("jobsPerTier"), F.element_at(F.array(*[F.lit(float(k)) for k in JOBS_PER_TIER]), (F.col("game_id") % 4 + 1).cast("int"))))


IDLE = "e.employee_id NOT IN (SELECT employee_id FROM active WHERE start_time >= TIMESTAMP '2024-01-29') AND e.employee_id NOT IN (SELECT employee_id FROM travel WHERE start_time >= TIMESTAMP '2024-01-29')"


@query("search_offers", with_("job emp active travel", "SELECT").removesuffix(" SELECT") + ", " + KNN.replace("FROM emp e)", f"FROM emp e WHERE {IDLE})") +
       "SELECT employee_id, job_id, tier, CAST(rn AS INTEGER) AS rank, round(km * 20e0 * (1e0 + 0.5e0 * (game_id % 2)), 4) AS reward, CAST(floor(km * 20e0 * 100e0 * 1e0 * (1e0 + 0.25e0 * (game_id % 3))) AS BIGINT) AS xp FROM knn WHERE rn <= [1, 2, 3, 5][game_id % 4 + 1]")
def _(spark, sf):
    cfg = FL.GameConfig(search_radius_m=30000.0)
    late = F.lit("2024-01-29").cast("timestamp")
    a, t = [df.withColumn("start_time", F.when(F.col("start_time") >= late, F.col("start_time"))) for df in (D.active(spark, sf), D.travel(spark, sf))]
    s = FL.search_jobs(D.employees(spark, sf), D.jobs(spark, sf), supplier_games(spark, sf), a, t, cfg)
    return s.offers.select("employee_id", "job_id", "tier", "rank", F.round("reward", 4).alias("reward"), "xp")


@query("search_kept_offers", with_("active travel emp", "SELECT active_id FROM active WHERE start_time >= TIMESTAMP '2024-01-29' OR employee_id NOT IN (SELECT employee_id FROM emp) OR "
       "employee_id IN (SELECT employee_id FROM active WHERE start_time >= TIMESTAMP '2024-01-29') OR employee_id IN (SELECT employee_id FROM travel WHERE start_time >= TIMESTAMP '2024-01-29')"))
def _(spark, sf):
    late = F.lit("2024-01-29").cast("timestamp")
    a, t = [df.withColumn("start_time", F.when(F.col("start_time") >= late, F.col("start_time"))) for df in (D.active(spark, sf), D.travel(spark, sf))]
    return FL.search_jobs(D.employees(spark, sf), D.jobs(spark, sf), supplier_games(spark, sf), a, t).active.select("active_id")


@query("vehicle_attributes", with_("emp", f"SELECT employee_id, {VEHICLE_TIER}[vehicle_level + 1] AS vehicle_tier, [" + ", ".join(str(v[3]) for v in FL.VEHICLES) + "][vehicle_level + 1] AS capacity, ["
       + ", ".join(str(v[4]) for v in FL.VEHICLES) + "][vehicle_level + 1] AS road_speed FROM emp"))
def _(spark, sf):
    return FL.with_vehicle(D.employees(spark, sf)).select("employee_id", "vehicle_tier", "capacity", "road_speed")


# --- settlement ----------------------------------------------------------------

US = "(epoch_us({as_of}) - epoch_us(start_time)) / 1e6"
ELAPSED = US.format(as_of=AS_OF)
DONE = (
    f"done AS (SELECT a.*, ad.lat AS dlat, ad.lon AS dlon, CAST(floor(a.xp * g.xpm) AS BIGINT) AS gain FROM active a JOIN egame g USING (game_id) JOIN addr ad ON ad.id = a.delivery "
    f"WHERE start_time IS NOT NULL AND {ELAPSED} >= duration_s) "
)


def done_sql(body: str) -> str:
    return with_("addr active eemp egame", "SELECT").removesuffix(" SELECT") + ", " + DONE + body


def settlement(spark, sf):
    return FL.settle(D.active(spark, sf), D.event_employees(spark, sf), D.event_games(spark, sf), addr_points(spark, sf), D.as_of())


@query("finished_jobs", with_("active", f"SELECT active_id FROM active WHERE start_time IS NOT NULL AND {ELAPSED} >= duration_s"))
def _(spark, sf):
    return FL.finished(D.active(spark, sf), D.as_of()).select("active_id")


@query("settle_employees", done_sql("SELECT employee_id, e.xp + coalesce(CAST(g AS BIGINT), 0) AS xp, round(coalesce(l.dlat, e.lat), 6) AS lat, round(coalesce(l.dlon, e.lon), 6) AS lon FROM eemp e "
       "LEFT JOIN (SELECT employee_id, sum(gain) AS g FROM done GROUP BY 1) USING (employee_id) "
       "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY start_time DESC, active_id DESC) AS rn FROM done) l USING (employee_id) WHERE coalesce(rn, 1) = 1"))
def _(spark, sf):
    e = settlement(spark, sf).employees
    return e.select("employee_id", "xp", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("settle_games", done_sql(", u AS (SELECT game_id, category, sum(gain) AS xp FROM done GROUP BY 1, 2 UNION ALL SELECT game_id, 0, xp0 FROM egame UNION ALL SELECT game_id, 3, xp3 FROM egame), "
       "m AS (SELECT game_id, money + coalesce((SELECT sum(reward) FROM done d WHERE d.game_id = g.game_id), 0) AS money FROM egame g) "
       "SELECT game_id, round(any_value(money), 4) AS money, category, CAST(sum(xp) AS BIGINT) AS xp FROM u JOIN m USING (game_id) GROUP BY game_id, category").replace(") , u AS", "), u AS"))
def _(spark, sf):
    g = settlement(spark, sf).games
    return g.select("game_id", F.round("money", 4).alias("money"), F.explode("xp").alias("category", "xp"))


@query("settle_remaining", done_sql("SELECT active_id FROM active WHERE active_id NOT IN (SELECT active_id FROM done)"))
def _(spark, sf):
    return settlement(spark, sf).remaining.select("active_id")


@query("settle_totals", done_sql("SELECT game_id, round(sum(reward), 4) AS reward, count(*) AS jobs FROM done GROUP BY 1"))
def _(spark, sf):
    return settlement(spark, sf).totals.select("game_id", F.round("reward", 4).alias("reward"), "jobs")


ACCEPT = (
    "ch AS (SELECT active_id, employee_id, job_id, TIMESTAMP '2024-01-20' + to_seconds(CAST((active_id * 37) % 1000 AS BIGINT)) AS chosen FROM active WHERE start_time IS NULL), "
    "c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY chosen, active_id) AS rn FROM ch) WHERE rn = 1), "
    "won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chosen, active_id) AS rj FROM c1) WHERE rj = 1) "
    "SELECT active_id, CASE WHEN active_id IN (SELECT active_id FROM won) THEN TIMESTAMP '2024-01-20' ELSE start_time END AS start_time FROM active "
    "WHERE active_id IN (SELECT active_id FROM won) OR (employee_id NOT IN (SELECT employee_id FROM won) AND job_id NOT IN (SELECT job_id FROM won))"
)


@query("accept_offers", with_("active", "SELECT").removesuffix(" SELECT") + ", " + ACCEPT)
def _(spark, sf):
    a = D.active(spark, sf)
    at = (F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(secs=((F.col("active_id") * 37) % 1000)))
    return FL.accept(a, a.where("start_time is null").select("active_id", at.alias("chosen_at")), D.as_of()).select("active_id", "start_time")


TRAVEL = (
    f"t AS (SELECT *, {ELAPSED} >= duration_s AS done, row_number() OVER (PARTITION BY employee_id ORDER BY start_time DESC, travel_id DESC) AS rn FROM travel), "
    "l AS (SELECT employee_id, to_lat, to_lon FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY start_time {dir}, travel_id {dir}) AS rl FROM t WHERE done) WHERE rl = 1) "
)


@query("travel_arrivals", with_("travel eemp", "SELECT").removesuffix(" SELECT") + ", " + TRAVEL.format(dir="DESC") +
       "SELECT employee_id, round(coalesce(to_lat, lat), 6) AS lat, round(coalesce(to_lon, lon), 6) AS lon FROM eemp LEFT JOIN l USING (employee_id)")
def _(spark, sf):
    e = FL.clean_travel(D.travel(spark, sf), D.event_employees(spark, sf), D.as_of()).employees
    return e.select("employee_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("travel_arrivals_legacy", with_("travel eemp", "SELECT").removesuffix(" SELECT") + ", " + TRAVEL.format(dir="ASC") +
       "SELECT employee_id, round(coalesce(to_lat, lat), 6) AS lat FROM eemp LEFT JOIN l USING (employee_id)")
def _(spark, sf):
    e = FL.clean_travel(D.travel(spark, sf), D.event_employees(spark, sf), D.as_of(), legacy=True).employees
    return e.select("employee_id", F.round("lat", 6).alias("lat"))


@query("travel_cleaned", with_("travel", "SELECT").removesuffix(" SELECT") + ", " + TRAVEL.format(dir="DESC") + "SELECT travel_id, employee_id, done FROM t WHERE done OR rn > 1")
def _(spark, sf):
    return FL.clean_travel(D.travel(spark, sf), D.event_employees(spark, sf), D.as_of()).cleaned


@query("fleet", with_("addr active travel eemp", "SELECT").removesuffix(" SELECT") +
       ", j AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY start_time DESC, active_id DESC) AS rn FROM active WHERE start_time IS NOT NULL), "
       "t AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY start_time DESC, travel_id DESC) AS rn FROM travel) "
       "SELECT e.employee_id, CAST(row_number() OVER (PARTITION BY e.game_id ORDER BY e.employee_id) - 1 AS BIGINT) AS hire_order, active_id, pickup, delivery, travel_id, round(p.lat, 6) AS pickup_lat, round(d.lat, 6) AS delivery_lat "
       "FROM eemp e LEFT JOIN j ON j.employee_id = e.employee_id AND j.rn = 1 LEFT JOIN t ON t.employee_id = e.employee_id AND t.rn = 1 LEFT JOIN addr p ON p.id = pickup LEFT JOIN addr d ON d.id = delivery")
def _(spark, sf):
    f = FL.fleet(D.event_employees(spark, sf), D.active(spark, sf), D.travel(spark, sf), addr_points(spark, sf))
    return f.select("employee_id", F.col("hire_order").cast("long").alias("hire_order"), "active_id", "pickup", "delivery", "travel_id",
                    F.round("pickup_lat", 6).alias("pickup_lat"), F.round("delivery_lat", 6).alias("delivery_lat"))


@query("hire_order", with_("emp", "SELECT employee_id, game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY employee_id) - 1 AS BIGINT) AS hire_order FROM emp"))
def _(spark, sf):
    return FL.with_order(D.employees(spark, sf)).select("employee_id", "game_id", F.col("hire_order").cast("long").alias("hire_order"))


@query("progress", with_("active", f"SELECT active_id, round(least(greatest(CASE WHEN duration_s > 0 THEN ({ELAPSED}) * 100e0 / duration_s ELSE 100e0 END, 0e0), 100e0), 3) AS percent, "
       f"round(greatest(duration_s - {ELAPSED}, 0e0), 3) AS remaining_s, {ELAPSED} >= duration_s AS complete FROM active WHERE start_time IS NOT NULL"))
def _(spark, sf):
    p = FL.progress(D.active(spark, sf), D.as_of())
    return p.select("active_id", F.round("percent", 3).alias("percent"), F.round("remaining_s", 3).alias("remaining_s"), "complete")


@query("cancel_jobs", with_("active eemp poly", "SELECT").removesuffix(" SELECT") +
       f", a AS (SELECT *, {ELAPSED} AS at_s FROM active WHERE start_time IS NOT NULL), "
       "span AS (SELECT route_id, min(cum_time_s) AS t0, max(cum_time_s) AS t1, arg_min(lat, seq) AS flat, arg_max(lat, seq) AS llat FROM poly GROUP BY 1), "
       "w AS (SELECT a.*, CASE WHEN t0 IS NULL THEN start_lat WHEN at_s <= t0 THEN flat WHEN at_s >= t1 THEN llat END AS plat, row_number() OVER (PARTITION BY employee_id ORDER BY start_time DESC, active_id DESC) AS rn FROM a LEFT JOIN span ON route_id = active_id) "
       "SELECT employee_id, round(coalesce(plat, lat), 5) AS lat FROM eemp LEFT JOIN (SELECT * FROM w WHERE rn = 1) USING (employee_id)")
def _(spark, sf):
    a = D.active(spark, sf)
    c = FL.cancel(a, D.route_polyline(spark, sf), a.select("active_id"), D.event_employees(spark, sf), D.as_of())
    return c.employees.select("employee_id", F.round("lat", 5).alias("lat"))


@query("hiring_costs", with_("emp", "SELECT n_nationkey::BIGINT AS game_id, count(employee_id) AS employees, round(CASE WHEN count(employee_id) = 0 THEN 0e0 ELSE pow(count(employee_id), 1.25e0) END, 6) AS next_cost "
       "FROM nation LEFT JOIN emp ON game_id = n_nationkey GROUP BY 1"))
def _(spark, sf):
    g = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("game_id"))
    return FL.hiring_costs(D.employees(spark, sf), g).withColumn("next_cost", F.round("next_cost", 6))


# --- progression ---------------------------------------------------------------

@query("employee_levels", with_("emp", f"SELECT employee_id, xp, {level('xp')} AS level FROM emp"))
def _(spark, sf):
    return PG.with_level(D.employees(spark, sf), "xp").select("employee_id", "xp", "level")


LEVELS = "[" + ", ".join(map(str, thresholds())) + "]"


@query("xp_report", with_("ugame", "SELECT").removesuffix(" SELECT") +
       ", r AS (SELECT game_id, category, xp FROM ugame UNION ALL SELECT game_id, NULL, CAST(sum(xp) AS BIGINT) FROM ugame GROUP BY 1), "
       f"l AS (SELECT *, {level('xp')} AS level, {LEVELS} AS t FROM r) "
       "SELECT game_id, category, xp, level, round(CASE WHEN level >= 120 THEN 100e0 ELSE (xp - t[level + 1]) * 100e0 / (t[level + 2] - t[level + 1]) END, 6) AS percent, "
       "CAST(CASE WHEN level >= 120 THEN 0 ELSE t[level + 2] - xp END AS BIGINT) AS xp_to_next FROM l")
def _(spark, sf):
    return PG.xp_report(D.user_games(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("level_counts", with_("emp", f"SELECT {level('xp')} AS level, count(*) AS employees FROM emp GROUP BY 1"))
def _(spark, sf):
    t = PG.level_table(spark).select("level")
    e = D.employees(spark, sf).groupBy(level_of("xp").alias("level")).agg(F.count(F.lit(1)).alias("employees"))
    return e.join(t, "level")


U = PG.upgrade_rows()
UPG = "up AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{u[0]}', [{', '.join(repr(x) for x in u[1])}]::VARCHAR[], {u[2].get('total', -1)}, {next((PG.CATEGORIES.index(k) for k in u[2] if k != 'total'), -1)}, "
    f"{next((v for k, v in u[2].items() if k != 'total'), -1)}, {u[3]!r}e0, '{u[4]}', '{u[5]}', {u[6]!r}e0)" for i, u in enumerate(U)
) + ") v(ix, upgrade_id, req, need_total, need_cat, need_lvl, cost, kind, effect, amount)) "
ELIG = (
    "tot AS (SELECT game_id, CAST(sum(xp) AS BIGINT) AS total, CAST(sum(n) * 400 AS DOUBLE) AS money FROM ugame GROUP BY 1), "
    f"el AS (SELECT t.game_id, t.money, u.*, {level('t.total')} >= need_total AND (need_cat < 0 OR {level('coalesce(c.xp, 0)')} >= need_lvl) AS levels_met "
    "FROM tot t CROSS JOIN up u LEFT JOIN ugame c ON c.game_id = t.game_id AND c.category = u.need_cat) "
)


@query("upgrade_eligibility", with_("ugame", "SELECT").removesuffix(" SELECT") + ", " + UPG + ", " + ELIG +
       "SELECT game_id, upgrade_id, len(req) = 0 AS dependencies_met, levels_met, money >= cost AS enough_money, len(req) = 0 AND levels_met AND money >= cost AS can_purchase FROM el")
def _(spark, sf):
    e = PG.upgrade_eligibility(D.user_games(spark, sf), PG.upgrade_table(spark))
    return e.select("game_id", "upgrade_id", "dependencies_met", "levels_met", "enough_money", "can_purchase")


@query("upgrade_effects", "WITH " + UPG + f", p AS (SELECT user_id AS game_id, ts, (event_id * 7) % {len(U)} AS ix FROM events), "
       "s AS (SELECT game_id, effect, list(struct_pack(k := kind, a := amount) ORDER BY ts, upgrade_id) AS steps FROM p JOIN up USING (ix) GROUP BY 1, 2) "
       "SELECT game_id, effect, list_reduce(list_prepend(CASE WHEN steps[1].k = 'multiply' THEN 1e0 ELSE 0e0 END, list_transform(steps, lambda x: 0e0)), "
       "lambda acc, x, i: CASE WHEN steps[i - 1].k = 'multiply' THEN acc * steps[i - 1].a WHEN steps[i - 1].k = 'increment' THEN acc + steps[i - 1].a ELSE steps[i - 1].a END) AS value FROM s"
       .replace("SELECT game_id, effect, list_reduce", "SELECT game_id, effect, round(list_reduce").replace("END) AS value", "END), 6) AS value"))
def _(spark, sf):
    e = PG.effects(D.purchases(spark, sf), PG.upgrade_table(spark))
    return e.select("game_id", "effect", F.round("value", 6).alias("value"))


REPLAY = (
    f"ask AS (SELECT event_id AS request_id, user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, (event_id * 7) % {len(U)} AS ix FROM events), "
    "step AS (SELECT a.*, e.upgrade_id, e.req, e.cost, e.levels_met FROM ask a JOIN el e ON e.game_id = a.game_id AND e.ix = a.ix), "
    "rec(game_id, rn, request_id, upgrade_id, status, money, owned) AS (SELECT game_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), money, CAST([] AS VARCHAR[]) FROM tot UNION ALL "
    "SELECT game_id, rn, request_id, upgrade_id, st, CASE WHEN st = 'bought' THEN money - cost ELSE money END, CASE WHEN st = 'bought' THEN list_append(owned, upgrade_id) ELSE owned END FROM "
    "(SELECT s.game_id, s.rn, s.request_id, s.upgrade_id, s.cost, r.money, r.owned, CASE WHEN list_contains(r.owned, s.upgrade_id) THEN 'already bought' WHEN NOT list_has_all(r.owned, s.req) THEN 'requirements' "
    "WHEN NOT s.levels_met THEN 'level' WHEN r.money < s.cost THEN 'funds' ELSE 'bought' END AS st FROM rec r JOIN step s ON s.game_id = r.game_id AND s.rn = r.rn + 1)) "
)


@query("apply_purchases", with_("ugame", "SELECT").removesuffix(" SELECT").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + UPG + ", " + ELIG + ", " + REPLAY +
       "SELECT request_id, game_id, upgrade_id, status FROM rec WHERE rn > 0")
def _(spark, sf):
    _games, outcomes = PG.apply_purchases(D.user_games(spark, sf), D.purchases(spark, sf), PG.upgrade_table(spark))
    return outcomes.select("request_id", "game_id", "upgrade_id", "status")


def vehicle_setup(spark, sf):
    """Users' employees ask for vehicles at every event of theirs."""
    g = D.event_games(spark, sf).withColumn("money", F.lit(25000.0) + F.col("game_id") * 1000).withColumn(
        "effects", F.create_map(F.lit("vehicleLevelMax"), F.lit(12.0), F.lit("upgradeDiscount"), F.lit(0.1)))
    e = D.event_employees(spark, sf).withColumn("vehicle_level", (F.col("employee_id") % 4).cast("int")).withColumn("xp", F.col("employee_id") * 30000)
    r = D.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("employee_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"))
    return e, g, r


VEHICLE_REPLAY = (
    "WITH RECURSIVE " + "veh AS (SELECT * FROM (VALUES " + ", ".join(f"({v[1]}, {v[6]}e0, {v[9]})" for v in FL.VEHICLES) + ") v(target, cost, need)), "
    f"emp AS (SELECT DISTINCT user_id AS employee_id, user_id % 25 AS game_id, CAST(user_id % 4 AS INTEGER) AS lvl, {level('user_id * 30000')} AS xl FROM events), "
    "ask AS (SELECT event_id AS request_id, user_id AS employee_id, user_id % 25 AS game_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS rn FROM events), "
    "rec(game_id, rn, request_id, employee_id, target, cost, ok, money, lv) AS (SELECT game_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0, 0e0, false, 25000e0 + game_id * 1000, map_from_entries(list((employee_id, lvl))) FROM emp GROUP BY game_id UNION ALL "
    "SELECT game_id, rn, request_id, employee_id, nxt, c, coalesce(good, false), CASE WHEN good THEN money - c ELSE money END, CASE WHEN good THEN map_concat(lv, map([employee_id], [nxt])) ELSE lv END FROM "
    "(SELECT q.*, floor(v.cost * (1 - 0.1e0)) AS c, nxt <= 12 AND v.cost > 0 AND xl >= v.need AND money >= floor(v.cost * (1 - 0.1e0)) AS good FROM "
    "(SELECT a.*, r.money, r.lv, e.xl, r.lv[a.employee_id] + 1 AS nxt FROM rec r JOIN ask a ON a.game_id = r.game_id AND a.rn = r.rn + 1 JOIN emp e ON e.employee_id = a.employee_id) q LEFT JOIN veh v ON v.target = nxt)) "
    "SELECT request_id, employee_id, game_id, target, cost FROM rec WHERE ok"
)


@query("apply_vehicle_purchases", VEHICLE_REPLAY)
def _(spark, sf):
    _e, _g, bought = PG.apply_vehicle_purchases(*vehicle_setup(spark, sf))
    return bought


# --- generation ----------------------------------------------------------------

RANGES = {t: (lo * 20, hi * 20) for t, (lo, hi) in GN.TIER_RANGES_KM.items()}


def straight(trips):
    """A router that drives 1.3 times the straight line."""
    return trips.select("id", (GN.geo.great_circle_km("from_lat", "from_lon", "to_lat", "to_lon") * 1300.0).alias("route_m"))


def generated(spark, sf):
    return GN.generate_jobs(addr_points(spark, sf), None, straight, seed=5, mode="all", ranges=RANGES)


@query("generate_jobs")
def _(spark, sf):
    return generated(spark, sf).jobs.select("start_address", "end_address", "tier", "category", "km")


def in_box(km):
    """Whether (e_lat, e_lon) lies in the box of ``km`` around (lat, lon)."""
    la, d = F.radians("lat"), km / GN.geo.GEODESIC_RADIUS_KM
    east = F.degrees(F.atan2(F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(la) * F.cos(d)))
    return (F.abs(F.col("e_lat") - F.col("lat")) <= km / GN.geo.KM_PER_LAT_DEGREE) & (F.abs(F.col("e_lon") - F.col("lon")) <= east)


@query("generation_checked", with_("addr", "SELECT id, true AS placed_once, true AS in_band, true AS routed FROM addr"))
def _(spark, sf):
    """Each address has one job or one reject; each job's end lies in its
    tier's square band and its km is what the router gives. This router finds
    every route and makes no detour, so only an empty band may reject."""
    g = generated(spark, sf)
    ends = addr_points(spark, sf).select(F.col("id").alias("end_address"), F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    starts = addr_points(spark, sf).withColumnRenamed("id", "start_address")
    j = g.jobs.join(starts, "start_address").join(ends, "end_address")
    bounds = F.create_map(*[x for t, (lo, hi) in RANGES.items() for x in (F.lit(t), F.array(F.lit(float(lo)), F.lit(float(hi))))])[F.col("tier")]
    in_band = in_box(bounds[1]) & ~in_box(bounds[0])
    routed = F.abs(F.col("km") - 1.3 * GN.geo.great_circle_km("lat", "lon", "e_lat", "e_lon")) < 1e-6
    rows = j.select(F.col("start_address").alias("id"), in_band.alias("b"), routed.alias("r")).unionByName(
        g.rejects.select("id", (F.col("reason") == "no destination").alias("b"), (F.col("reason") == "no destination").alias("r")))
    return rows.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("placed_once"), F.every("b").alias("in_band"), F.every("r").alias("routed"))


# --- stores and logs -----------------------------------------------------------

@query("append_new", f"SELECT o_custkey AS id, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT (user_id * 3) % {NCUST} FROM events) GROUP BY 1")
def _(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"))
    stored = D.table(spark, sf, "events").select(((F.col("user_id") * 3) % D.customers(spark, sf)).alias("id"))
    return WR.new_rows(o, stored, "id", "first_order")


UPS = "n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer), o AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING')"


def upsert_tables(spark, sf):
    c = D.table(spark, sf, "customer")
    new = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    return new, c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("upsert", "WITH " + UPS + " SELECT id, name FROM n")
def _(spark, sf):
    return WR.upserted(*upsert_tables(spark, sf), "id")


@query("upsert_counts", "WITH " + UPS + " SELECT count(*) FILTER (WHERE o.id IS NULL) AS inserted, count(*) FILTER (WHERE o.name <> n.name) AS updated, count(*) FILTER (WHERE o.name = n.name) AS unchanged FROM n LEFT JOIN o USING (id)")
def _(spark, sf):
    return WR.upsert_counts(*upsert_tables(spark, sf), "id")


@query("latency_report", "SELECT event_type AS timer, count(*) AS count, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, quantile_disc(value, 0.95) AS p_ms FROM events GROUP BY 1")
def _(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("timer"), F.col("value").alias("ms"))
    r = RP.latency_report(e)
    return r.withColumn("total_ms", F.round("total_ms", 4)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("run_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failure, "
       "round(count(*) FILTER (WHERE event_type <> 'error') * 100e0 / count(*), 6) AS success_percent FROM events")
def _(spark, sf):
    e = D.table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"))
    return RP.run_summary(e).withColumn("success_percent", F.round("success_percent", 6))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3")
def _(spark, sf):
    return ST.windowed_counts(D.table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query("sliding_counts", "SELECT s AS window_start, s + INTERVAL '1 hour' AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS value FROM "
       "(SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2, 3")
def _(spark, sf):
    return ST.windowed_counts(D.table(spark, sf, "events"), "1 hour", "30 minutes").withColumn("value", F.round("value", 4))


@query("session_counts", "WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL '15 minutes' AND ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL '15 minutes' THEN 0 ELSE 1 END AS b FROM events), "
       "s AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts) AS n FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL '15 minutes' AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY event_type, n")
def _(spark, sf):
    return ST.windowed_counts(D.table(spark, sf, "events"), gap="15 minutes").withColumn("value", F.round("value", 4))
