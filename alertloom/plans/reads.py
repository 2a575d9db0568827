"""Read-side queries: filters, joins, top-k, summaries, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import geo, ip, text, timeops
from alertloom.operators import aggregates as A, filters as L, joins as J, topk as T
from alertloom.plans import oracle_sql as O
from alertloom.plans.registry import query
from alertloom.sources.views import EVENT_AS_OF, ORDER_AS_OF, view

AS_OF = ORDER_AS_OF
NOW = f"TIMESTAMP '{AS_OF}'"
LAT, LNG, RADIUS = 31.5204, 74.3587, 400.0


def text_times(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so that two engines' rows compare byte for byte."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- filters ------------------------------------------------------------------
@query("f1_status_in", "SELECT id, status FROM alerts WHERE status IN ('active','pending')")
def _(spark, d):
    return L.status_in(view(spark, d, "alerts"), K.ACTIVE_STATUSES).select("id", "status")


@query("f2_exclude_status", "SELECT id, status FROM alerts WHERE status NOT IN ('rejected','invalid','cancelled')")
def _(spark, d):
    return L.exclude_status(view(spark, d, "alerts")).select("id", "status")


@query("f3_unexpired", f"SELECT id FROM alerts WHERE expires_at IS NULL OR expires_at > {NOW}")
def _(spark, d):
    return L.unexpired(view(spark, d, "alerts"), AS_OF).select("id")


@query("f4_in_window", f"SELECT id FROM alerts WHERE {O.EFFECTIVE} BETWEEN {NOW} - INTERVAL 10 DAY AND {NOW} + INTERVAL 15 MINUTE")
def _(spark, d):
    return L.in_window(view(spark, d, "alerts"), AS_OF, hours=240).select("id")


@query("f5_search", "SELECT id, title FROM alerts WHERE title ILIKE '%urgent notice 1_%' OR description ILIKE '%urgent notice 1_%'")
def _(spark, d):
    return L.search(view(spark, d, "alerts"), "  URGENT notice 1_ ").select("id", "title")


@query("f6_eq_filters", "SELECT id FROM alerts WHERE hazard_type = 'heatwave' AND normalized_severity = 'high' AND status = 'active'")
def _(spark, d):
    return L.eq_filters(view(spark, d, "alerts"), "heatwave", "high", "active").select("id")


@query("f7_ci_filters", "SELECT a.id, s.name AS source_name FROM alerts a JOIN sources s ON a.source_id = s.id WHERE lower(a.status) = 'expired' AND lower(hazard_type) = 'flood' AND lower(s.name) = 'ndma advisories'")
def _(spark, d):
    rows = J.with_source(view(spark, d, "alerts"), view(spark, d, "sources"))
    return L.ci_filters(rows, AS_OF, hazard="FLOOD", status="Expired", source="ndma ADVISORIES").select("id", "source_name")


@query("f8_admin_filter", "SELECT id FROM alerts WHERE id IN (SELECT alert_id FROM alert_locations WHERE province ILIKE '%asi%' AND district ILIKE '%nation_1%')")
def _(spark, d):
    return L.admin_filter(view(spark, d, "alerts"), view(spark, d, "alert_locations"), "asi", "nation_1", substring=True).select("id")


@query("f9_source_filter", "SELECT id, source_id FROM alerts WHERE source_id IN (SELECT id FROM sources WHERE name ILIKE '%pdf%' OR source_type ILIKE '%pdf%')")
def _(spark, d):
    return L.source_filter(view(spark, d, "alerts"), view(spark, d, "sources"), "pdf").select("id", "source_id")


@query("f10_prune_payload", "SELECT id, title, CAST(NULL AS VARCHAR) AS raw_text FROM alerts")
def _(spark, d):
    return L.prune_payload(view(spark, d, "alerts")).select("id", "title", "raw_text")


@query("f10_raw_text", "SELECT id AS alert_id, raw_text FROM alerts WHERE id = 77")
def _(spark, d):
    return L.raw_text_of(view(spark, d, "alerts"), 77)


@query("f11_get_alert", """SELECT a.id, a.title, s.name AS source_name, r.district AS primary_district, l.loc_id, l.city
FROM alerts a JOIN sources s ON a.source_id = s.id LEFT JOIN resolutions r ON r.alert_id = a.id LEFT JOIN alert_locations l ON l.alert_id = a.id WHERE a.id = 42""")
def _(spark, d):
    one = L.get_alert(view(spark, d, "alerts"), 42)
    full = J.with_children(one, *[view(spark, d, n) for n in ("alert_locations", "resolutions", "sources")])
    return full.select("id", "title", "source_name", "primary_district", "loc_id", "city")


DECISIONS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision FROM orders WHERE o_orderstatus = 'P'"


def decisions(spark, d):
    return view(spark, d, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision")


@query("f12_set_status", f"SELECT a.id, CASE c.decision WHEN 'approve' THEN 'active' WHEN 'reject' THEN 'rejected' ELSE a.status END AS status FROM alerts a LEFT JOIN ({DECISIONS}) c ON a.id = c.id")
def _(spark, d):
    return L.set_status(view(spark, d, "alerts"), decisions(spark, d)).select("id", "status")


@query("f12_unknown_decisions", "SELECT event_id * 3 AS id FROM events WHERE event_id * 3 NOT IN (SELECT id FROM alerts)")
def _(spark, d):
    asked = view(spark, d, "events").select((F.col("event_id") * 3).alias("id"))
    return L.unknown_decisions(view(spark, d, "alerts"), asked)


@query("f13_recent_or", f"SELECT id FROM alerts WHERE effective_event_at >= {NOW} OR issued_at >= {NOW}")
def _(spark, d):
    return L.recent_or(view(spark, d, "alerts"), AS_OF).select("id")


@query("f14_history_expired", "SELECT id FROM alerts WHERE status = 'expired'")
def _(spark, d):
    return L.history_expired(view(spark, d, "alerts")).select("id")


# ---- coordinate predicates --------------------------------------------------
@query("c1_valid_country", f"SELECT loc_id, alert_id, {O.country('latitude', 'longitude')} AS ok FROM alert_locations")
def _(spark, d):
    return view(spark, d, "alert_locations").select("loc_id", "alert_id", geo.valid_country(F.col("latitude"), F.col("longitude")).alias("ok"))


@query("c2_valid_world", f"SELECT s_suppkey, {O.world('latitude * 2', 'longitude * 3')} AS ok FROM cities")
def _(spark, d):
    return view(spark, d, "cities").select("s_suppkey", geo.valid_world(F.col("latitude") * 2, F.col("longitude") * 3).alias("ok"))


@query("c3_near_region", "SELECT s_suppkey, coalesce(latitude - 4 BETWEEN 20 AND 42 AND longitude + 10 BETWEEN 55 AND 85, false) AS ok FROM cities")
def _(spark, d):
    return view(spark, d, "cities").select("s_suppkey", geo.near_region(F.col("latitude") - 4, F.col("longitude") + 10).alias("ok"))


@query("c4_has_any_valid_coords", f"""SELECT a.id, {O.country('r.latitude', 'r.longitude')} OR a.id IN (SELECT alert_id FROM alert_locations WHERE {O.country('latitude', 'longitude')}) AS ok
FROM alerts a LEFT JOIN resolutions r ON r.alert_id = a.id""")
def _(spark, d):
    here = geo.valid_country(F.col("latitude"), F.col("longitude"))
    res = view(spark, d, "resolutions").select(F.col("alert_id").alias("id"), here.alias("own"))
    loc = view(spark, d, "alert_locations").groupBy(F.col("alert_id").alias("id")).agg(F.bool_or(here).alias("any"))
    return view(spark, d, "alerts").select("id").join(res, "id", "left").join(loc, "id", "left").select(
        "id", (F.coalesce("own", F.lit(False)) | F.coalesce("any", F.lit(False))).alias("ok"))


# ---- joins ------------------------------------------------------------------
@query("j1_with_source", "SELECT a.id, s.name AS source_name, s.source_type FROM alerts a JOIN sources s ON a.source_id = s.id")
def _(spark, d):
    return J.with_source(view(spark, d, "alerts"), view(spark, d, "sources")).select("id", "source_name", "source_type")


@query("j2_with_location_match", "SELECT id FROM alerts WHERE EXISTS (SELECT 1 FROM alert_locations l WHERE l.alert_id = alerts.id AND l.district = 'NATION_3')")
def _(spark, d):
    hits = L.admin_match(view(spark, d, "alert_locations"), district="NATION_3")
    return J.with_location_match(view(spark, d, "alerts"), hits).select("id")


@query("j3_with_children", """SELECT a.id, s.name AS source_name, r.district AS primary_district, r.source AS resolution_source, l.loc_id, l.province, l.city
FROM alerts a JOIN sources s ON a.source_id = s.id LEFT JOIN resolutions r ON r.alert_id = a.id LEFT JOIN alert_locations l ON l.alert_id = a.id""")
def _(spark, d):
    full = J.with_children(*[view(spark, d, n) for n in ("alerts", "alert_locations", "resolutions", "sources")])
    return full.select("id", "source_name", "primary_district", "resolution_source", "loc_id", "province", "city")


NEAREST = f"""SELECT alert_id, loc_id, round(dist, 6) AS distance, location_name FROM (
SELECT alert_id, loc_id, dist, coalesce(canonical_name, city, district, province, raw_location, 'Advisory Location') AS location_name,
  row_number() OVER (PARTITION BY alert_id ORDER BY dist, loc_id) AS r
FROM (SELECT *, {O.haversine(LAT, LNG, 'latitude', 'longitude')} AS dist FROM alert_locations WHERE {O.world('latitude', 'longitude')}) x) y WHERE r = 1"""


@query("j4_nearest_location", NEAREST)
def _(spark, d):
    near = J.nearest_location(view(spark, d, "alert_locations"), LAT, LNG)
    return r6(near, "distance").select("alert_id", "loc_id", "distance", "location_name")


@query("j5_within_radius", f"""SELECT v.viewer_id, c.s_suppkey, round({O.haversine('v.lat', 'v.lng', 'c.latitude', 'c.longitude')}, 6) AS distance
FROM viewers v, cities c WHERE {O.world('c.latitude', 'c.longitude')} AND {O.haversine('v.lat', 'v.lng', 'c.latitude', 'c.longitude')} <= 250""")
def _(spark, d):
    pairs = J.within_radius(view(spark, d, "viewers"), view(spark, d, "cities"), 250.0)
    return r6(pairs, "distance").select("viewer_id", "s_suppkey", "distance")


@query("j6_cross_user", f"SELECT a.id, u.user_lat, u.user_lng FROM alerts a CROSS JOIN (SELECT CAST({LAT} AS DOUBLE) AS user_lat, CAST({LNG} AS DOUBLE) AS user_lng) u")
def _(spark, d):
    return J.cross_user(view(spark, d, "alerts"), LAT, LNG).select("id", "user_lat", "user_lng")


@query("j10_needs_resolution", """SELECT a.id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM resolutions r WHERE r.alert_id = a.id
AND r.cache_key = sha256(CAST(a.id AS VARCHAR) || ':' || '1'))""")
def _(spark, d):
    keyed = view(spark, d, "alerts").withColumn("cache_key", F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit("1")), 256))
    return J.needs_resolution(keyed, view(spark, d, "resolutions")).select("id")


@query("j11_latest_raw_doc", f"""SELECT source_id, id, url, {O.ts('retrieved_at')} AS retrieved_at FROM (
SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC, id DESC) AS r FROM raw_documents) WHERE r = 1""")
def _(spark, d):
    return text_times(J.latest_raw_doc(view(spark, d, "raw_documents")), "retrieved_at").select("source_id", "id", "url", "retrieved_at")


def _pairs(mapping):
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


STATION_NAMES = sorted(K.STATION_DISTRICT)
RIVER_NAMES = ["Indus", "Chenab", "Jhelum", "Ravi", "Sutlej", "Kabul", "Swat", "Hunza"]
STATION_SQL = "CASE event_id % 30 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATION_NAMES)) + " WHEN 27 THEN ' Tarbela ' WHEN 28 THEN 'nowhere' END"
RIVER_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(RIVER_NAMES)) + " END"
LEVEL_SQL = "CASE event_id % 7 WHEN 0 THEN 'Below Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Very High' WHEN 5 THEN 'Exceptionally High' END"
CONDITIONS = f"SELECT event_id, user_id AS bulletin_id, {RIVER_SQL} AS river, {STATION_SQL} AS station, {LEVEL_SQL} AS level FROM events"
STATION_VALUES = f"(VALUES {_pairs(K.STATION_DISTRICT)}) AS st(station, district)"
RIVER_VALUES = "(VALUES " + ", ".join(f"('{r}', {i}, '{n}')" for r, ns in K.RIVER_DISTRICTS.items() for i, n in enumerate(ns)) + ") AS rv(river, pos, district)"


def conditions(spark, d):
    return view(spark, d, "events").selectExpr(
        "event_id", "user_id AS bulletin_id", f"{RIVER_SQL} AS river", f"{STATION_SQL} AS station", f"{LEVEL_SQL} AS level")


MAPPED = f"""SELECT c.*, st.district, 2 AS kind, 0 AS pos FROM ({CONDITIONS}) c JOIN {STATION_VALUES} ON lower(trim(c.station)) = st.station
UNION ALL SELECT c.*, rv.district, 1 AS kind, rv.pos FROM ({CONDITIONS}) c JOIN {RIVER_VALUES} ON lower(trim(c.river)) = rv.river
WHERE coalesce(lower(trim(c.station)), '') NOT IN {O.in_list(K.STATION_DISTRICT)}"""


@query("j13_station_river_districts", f"SELECT event_id, district, kind, pos FROM ({MAPPED}) m")
def _(spark, d):
    return J.map_conditions(conditions(spark, d)).select("event_id", "district", "kind", "pos")


PRIVATE_SQL = " OR ".join(
    f"({{v}} BETWEEN {lo} AND {hi})" for lo, hi in [
        (0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183),
        (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055),
        (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295)])


def not_public(v: str) -> str:
    return f"(({PRIVATE_SQL.format(v=v)}) AND {v} NOT IN (3221225481, 3221225482))"


GEOIP = f"""SELECT event_id, CASE WHEN found THEN city ELSE 'Pakistan Centre' END AS city, CASE WHEN found THEN lat ELSE 30.3753::DOUBLE END AS lat,
CASE WHEN found THEN lng ELSE 69.3451::DOUBLE END AS lng, NOT found AS is_fallback, CASE WHEN v IS NULL THEN CASE WHEN bad THEN 'invalid_ip_fallback' ELSE 'default' END
WHEN {not_public('v')} THEN CASE WHEN dev THEN 'local_development' ELSE 'private_ip_fallback' END WHEN NOT found THEN 'geoip_not_found_fallback' WHEN dev THEN 'local_development' ELSE 'ip' END AS detection_method
FROM (SELECT a.event_id, a.v, a.bad, a.dev, r.city, r.lat, r.lng, coalesce(NOT {not_public('a.v')}, false) AND {O.world('r.lat', 'r.lng')} AS found
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE v END AS v, event_id % 22 = 0 AS bad, event_id % 7 = 0 AS dev FROM access_log) a LEFT JOIN ip_ranges r ON a.v BETWEEN r.ip_start AND r.ip_end) z"""


@query("j14_geoip_join", GEOIP)
def _(spark, d):
    log = view(spark, d, "access_log").selectExpr(
        "event_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE v END AS address", "event_id % 22 = 0 AS invalid_input", "event_id % 7 = 0 AS is_local_development")
    return J.geoip_join(log, view(spark, d, "ip_ranges")).select("event_id", "city", "lat", "lng", "is_fallback", "detection_method")


CITY_ROWS = "SELECT s_suppkey AS pos, s_suppkey AS city_id, city AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Alias ' || CAST(s_suppkey % 40 AS STRING) ELSE NULL END AS alias, district, province FROM cities"
WANTED = """SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN ' alias ' || CAST(o_orderkey % 50 AS STRING) ELSE 'SUPPLIER#' || lpad(CAST(o_orderkey % 20 AS STRING), 9, '0') END AS name,
CASE WHEN o_orderkey % 4 = 0 THEN 'NATION_' || CAST(o_orderkey % 25 AS STRING) ELSE NULL END AS district, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'ASIA' ELSE NULL END AS province FROM orders"""


@query("j16_find_city", f"""SELECT q.query_id, min(c.city_id) AS city_id FROM ({WANTED}) q JOIN ({CITY_ROWS}) c ON lower(trim(q.name)) IN (lower(c.name), lower(c.alias))
WHERE (q.district IS NULL OR q.district = c.district) AND (q.province IS NULL OR q.province = '' OR q.province = c.province) GROUP BY q.query_id""")
def _(spark, d):
    rows = spark.sql(CITY_ROWS.replace("FROM cities", "FROM {cities}"), cities=view(spark, d, "cities"))
    wanted = spark.sql(WANTED.replace("FROM orders", "FROM {orders}"), orders=view(spark, d, "orders"))
    return J.find_city(wanted, rows)


# ---- top-k --------------------------------------------------------------------
ACTIVE = f"status IN ('active','pending') AND (expires_at IS NULL OR expires_at > {NOW})"


@query("q1_active_alerts", f"""SELECT id, title, normalized_severity, {O.ts('issued_at')} AS issued_at, raw_text FROM (
SELECT id, title, normalized_severity, issued_at, CAST(NULL AS VARCHAR) AS raw_text FROM alerts WHERE {ACTIVE} AND title ILIKE '%notice%'
AND id IN (SELECT alert_id FROM alert_locations WHERE province = 'ASIA') ORDER BY issued_at DESC, id LIMIT 50)""")
def active_page(spark, d):
    page = T.active_alerts(view(spark, d, "alerts"), view(spark, d, "alert_locations"), AS_OF, province="ASIA", search="notice")
    return text_times(page, "issued_at").select("id", "title", "normalized_severity", "issued_at", "raw_text")


@query("q2_alert_history", f"SELECT id, status, {O.ts('issued_at')} AS issued_at FROM (SELECT * FROM alerts WHERE hazard_type = 'flood' ORDER BY issued_at DESC, id LIMIT 100)")
def _(spark, d):
    return text_times(T.alert_history(view(spark, d, "alerts"), hazard="flood"), "issued_at").select("id", "status", "issued_at")


MAP_PAGE = f"""SELECT a.id, a.normalized_severity, s.name AS source_name, {O.ts('a.eff')} AS effective_at,
 CASE WHEN {O.country('r.latitude', 'r.longitude')} THEN r.latitude ELSE v.latitude END AS latitude,
 CASE WHEN {O.country('r.latitude', 'r.longitude')} THEN r.longitude ELSE v.longitude END AS longitude,
 coalesce(r.province, f.province) AS province, coalesce(r.district, f.district) AS district, coalesce(r.city, f.city) AS city, r.source AS resolution_source
FROM (SELECT *, {O.EFFECTIVE} AS eff FROM alerts WHERE status NOT IN ('rejected','invalid','cancelled') AND {O.EFFECTIVE} BETWEEN {NOW} - INTERVAL 90 DAY AND {NOW} + INTERVAL 15 MINUTE
      ORDER BY eff DESC, id LIMIT 500) a
JOIN sources s ON s.id = a.source_id LEFT JOIN resolutions r ON r.alert_id = a.id
LEFT JOIN (SELECT * FROM alert_locations QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY loc_id) = 1) f ON f.alert_id = a.id
LEFT JOIN (SELECT * FROM alert_locations WHERE {O.country('latitude', 'longitude')} QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY loc_id) = 1) v ON v.alert_id = a.id
WHERE {O.country('r.latitude', 'r.longitude')} OR v.alert_id IS NOT NULL"""


def map_page(spark, d):
    return T.map_alerts(*[view(spark, d, n) for n in ("alerts", "alert_locations", "resolutions", "sources")], AS_OF, days=90)


@query("q3_map_alerts", MAP_PAGE)
def _(spark, d):
    return text_times(map_page(spark, d), "effective_at").select(
        "id", "normalized_severity", "source_name", "effective_at", "latitude", "longitude", "province", "district", "city", "resolution_source")


NEARBY_LIVE = f"status IN ('active','pending','approved') AND (expires_at IS NULL OR expires_at > {NOW})"


@query("q4_nearby_alerts", f"""SELECT a.id, a.normalized_severity, s.name AS source_name, n.loc_id, n.location_name, round(n.distance, 2) AS distance_km
FROM alerts a JOIN sources s ON s.id = a.source_id JOIN ({NEAREST}) n ON n.alert_id = a.id WHERE {NEARBY_LIVE} AND n.distance <= {RADIUS}
ORDER BY n.distance, {O.sev_rank('lower(a.normalized_severity)', 4)}, a.issued_at DESC, a.id LIMIT 50 OFFSET 10""")
def _(spark, d):
    page = T.nearby_alerts(*[view(spark, d, n) for n in ("alerts", "alert_locations", "sources")], AS_OF, LAT, LNG, RADIUS, offset=10)
    return page.select("id", "normalized_severity", "source_name", "loc_id", "location_name", "distance_km")


@query("q4_nearby_for_viewers", f"""SELECT viewer_id, id, pos, round(distance, 2) AS distance_km FROM (
SELECT viewer_id, id, distance, row_number() OVER (PARTITION BY viewer_id ORDER BY distance, {O.sev_rank('normalized_severity', 4)}, issued_at DESC, id) AS pos FROM (
SELECT v.viewer_id, a.id, a.normalized_severity, a.issued_at, min({O.haversine('v.lat', 'v.lng', 'l.latitude', 'l.longitude')}) AS distance
FROM viewers v, alert_locations l JOIN alerts a ON a.id = l.alert_id
WHERE {NEARBY_LIVE} AND {O.world('l.latitude', 'l.longitude')} AND {O.haversine('v.lat', 'v.lng', 'l.latitude', 'l.longitude')} <= 300
GROUP BY ALL) x) y WHERE pos BETWEEN 6 AND 25""")
def _(spark, d):
    page = T.nearby_for_viewers(*[view(spark, d, n) for n in ("alerts", "alert_locations", "viewers")], AS_OF, 300.0, limit=20, offset=5)
    return page.select("viewer_id", "id", "pos", "distance_km")


@query("q5_recent_page", "SELECT id, (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM alerts) AS total_pages FROM (SELECT id FROM alerts ORDER BY coalesce(issued_at, created_at) DESC, id LIMIT 10 OFFSET 20)")
def _(spark, d):
    return T.recent_page(view(spark, d, "alerts"), page=3).select("id", "total_pages")


@query("q6_search_cities", f"SELECT DISTINCT pos, city_id, name FROM ({CITY_ROWS}) c WHERE contains(lower(name), '12') OR contains(lower(district), '12') OR contains(lower(province), '12') OR contains(lower(alias), '12') ORDER BY pos LIMIT 8")
def _(spark, d):
    rows = spark.sql(CITY_ROWS.replace("FROM cities", "FROM {cities}"), cities=view(spark, d, "cities"))
    return T.search_cities(rows, " 12 ")


@query("q8_latest_n", "SELECT id FROM alerts ORDER BY coalesce(issued_at, created_at) DESC, id LIMIT 5")
def _(spark, d):
    return T.latest_n(view(spark, d, "alerts")).select("id")


# ---- aggregations -------------------------------------------------------------
@query("a1_ingest_stats", """SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'ignored') AS ignored,
count(*) FILTER (st = 'incomplete' AND action <> 'rejected') AS incomplete, count(*) FILTER (action = 'rejected') AS rejected
FROM (SELECT CASE id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' WHEN 2 THEN 'ignored' ELSE 'rejected' END AS action, CASE WHEN id % 5 = 0 THEN 'incomplete' ELSE status END AS st FROM alerts)""")
def _(spark, d):
    rows = view(spark, d, "alerts").selectExpr(
        "CASE id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' WHEN 2 THEN 'ignored' ELSE 'rejected' END AS action",
        "CASE WHEN id % 5 = 0 THEN 'incomplete' ELSE status END AS status")
    return A.ingest_stats(rows)


@query("a2_summary_metrics", f"""SELECT (SELECT count(*) FROM alerts WHERE status = 'active') AS active_alerts_count,
(SELECT count(*) FROM alerts WHERE status = 'active' AND normalized_severity = 'critical') AS critical_alerts_count,
(SELECT count(DISTINCT district) FROM alert_locations WHERE alert_id IN (SELECT id FROM alerts)) AS affected_districts_count,
(SELECT count(*) FROM source_status WHERE consecutive_failures = 0 AND health_status <> 'unhealthy') AS healthy_sources_count,
(SELECT count(*) FROM source_status WHERE consecutive_failures > 0 OR health_status = 'unhealthy') AS unhealthy_sources_count,
(SELECT {O.ts('max(last_checked_at)')} FROM source_status) AS latest_update_time""")
def _(spark, d):
    return text_times(A.summary_metrics(*[view(spark, d, n) for n in ("alerts", "alert_locations", "source_status")]), "latest_update_time")


@query("a3_map_summary", f"""SELECT count(*) AS total_map_alerts, count(*) FILTER (normalized_severity = 'critical') AS critical_map_alerts,
(SELECT count(DISTINCT district) FROM alert_locations WHERE alert_id IN (SELECT id FROM ({MAP_PAGE}) q)) AS affected_districts_count FROM ({MAP_PAGE}) p""")
def _(spark, d):
    return A.map_summary(map_page(spark, d), view(spark, d, "alert_locations"))


@query("a4_type_counts", "SELECT entity_type, count(*) AS n FROM gazetteer GROUP BY entity_type")
def _(spark, d):
    return A.type_counts(view(spark, d, "gazetteer"))


@query("a7_district_severity", f"""SELECT bulletin_id, st.district, max(CASE lower(level) WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'very high' THEN 4 WHEN 'exceptionally high' THEN 5 END) AS max_rank
FROM ({CONDITIONS}) c JOIN {STATION_VALUES} ON lower(c.station) = st.station WHERE level IS NOT NULL AND level <> 'Below Low' GROUP BY 1, 2""")
def _(spark, d):
    from alertloom.operators.bulletins import district_severity
    return district_severity(conditions(spark, d), "bulletin_id")


@query("a8_highest_level", """SELECT bulletin_id, arg_max(level, CASE level WHEN 'Below Low' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Very High' THEN 4 ELSE 5 END) AS highest_level
FROM (""" + CONDITIONS + """) c WHERE level IS NOT NULL GROUP BY bulletin_id""")
def _(spark, d):
    from alertloom.operators.bulletins import highest_level
    return highest_level(conditions(spark, d), "bulletin_id")


@query("a9_source_health_counts", "SELECT count(*) FILTER (consecutive_failures = 0) AS operational, count(*) FILTER (consecutive_failures > 0) AS delayed, count(*) AS source_count FROM source_status")
def _(spark, d):
    return A.source_health_counts(view(spark, d, "source_status"))


@query("a10_revision_count", "SELECT a.id, count(r.alert_id) + 1 AS revision_count FROM alerts a LEFT JOIN (SELECT CAST(user_id AS BIGINT) AS alert_id FROM events) r ON r.alert_id = a.id GROUP BY a.id")
def _(spark, d):
    return A.revision_count(view(spark, d, "alerts"), view(spark, d, "events").select(F.col("user_id").alias("alert_id")))


@query("a11_location_groups", f"""SELECT DISTINCT alert_id, entity_type AS type, canonical_name AS name, CASE entity_type WHEN 'CITY' THEN 4 WHEN 'TOWN' THEN 5 ELSE 99 END AS type_order FROM alert_locations""")
def _(spark, d):
    return A.location_groups(view(spark, d, "alert_locations")).select("alert_id", "type", "name", "type_order")


TILE_CELLS = """floor((longitude + 180.0) / 360.0 * {size} / 45) AS cell_x,
floor((0.5 - ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / (4 * pi())) * {size} / 45) AS cell_y"""
TILES = " UNION ALL ".join(f"""SELECT {zoom} AS zoom, {TILE_CELLS.format(size=256.0 * 2**zoom)}, count(*) AS point_count,
CASE WHEN count(*) < 5 THEN 'small' WHEN count(*) < 15 THEN 'medium' ELSE 'large' END AS size_class
FROM alert_locations WHERE {O.country('latitude', 'longitude')} GROUP BY 1, 2, 3""" for zoom in (6, 10))
POINTS = f"SELECT 11 AS zoom, {TILE_CELLS.format(size=256.0 * 2**11)}, 1 AS point_count, 'small' AS size_class FROM alert_locations WHERE {O.country('latitude', 'longitude')}"


@query("a12_tile_clusters", f"{TILES} UNION ALL {POINTS}")
def _(spark, d):
    """Both sides of the zoom above which nothing is clustered."""
    at = lambda zoom: A.tile_clusters(view(spark, d, "alert_locations"), zoom).select(
        F.lit(zoom).alias("zoom"), F.col("cell_x").cast("double").alias("cell_x"), F.col("cell_y").cast("double").alias("cell_y"), "point_count", "size_class")
    return at(6).unionByName(at(10)).unionByName(at(11))


@query("a13_children_by_parent", """SELECT 'province_district' AS kind, province_id AS parent_id, numeric_id AS child_id FROM gazetteer WHERE entity_type = 'DISTRICT' AND province_id IS NOT NULL
UNION ALL SELECT 'district_place', district_id, numeric_id FROM gazetteer WHERE entity_type IN ('CITY','TOWN','VILLAGE','LOCALITY') AND district_id IS NOT NULL""")
def _(spark, d):
    return A.children_by_parent(view(spark, d, "gazetteer"))


@query("a14_page_header", f"SELECT count(*) AS total_count, '{'1999-10-03 00:00:00'}' AS window_start, '2000-01-01 00:15:00' AS window_end, '3 Oct 1999, 05:00 AM to 1 Jan 2000, 05:00 AM PKT' AS window_label FROM ({MAP_PAGE}) p")
def _(spark, d):
    start, end = timeops.window_bounds(AS_OF, 90)
    label = timeops.window_label(start, timeops.as_of_column(AS_OF))
    return text_times(A.page_header(map_page(spark, d), start, end, label), "window_start", "window_end")


# ---- scalar rules -------------------------------------------------------------
STORY = "CASE id % 12 WHEN 0 THEN 'Flash Flood in valley' WHEN 1 THEN 'tropical storm near coast' WHEN 2 THEN 'Downpour, be prepared' WHEN 3 THEN 'Seismic event, evacuate' WHEN 4 THEN 'heat wave: extreme' WHEN 5 THEN 'mudslide danger' WHEN 6 THEN 'heavy_rain' WHEN 7 THEN 'Cyclone advisory' WHEN 8 THEN 'Moderate Lightning' ELSE title END"


def _duck_label(expr, groups):
    return O.contains_case(f"lower({expr})", groups, "unknown")


@query("x2_hazard", f"SELECT id, {_duck_label(STORY, K.HAZARD_WORDS)} AS hazard FROM alerts")
def _(spark, d):
    return view(spark, d, "alerts").select("id", text.hazard(F.expr(STORY)).alias("hazard"))


@query("x3_severity", f"SELECT id, {_duck_label(STORY, K.SEVERITY_WORDS)} AS severity FROM alerts")
def _(spark, d):
    return view(spark, d, "alerts").select("id", text.severity(F.expr(STORY)).alias("severity"))


X4_IN = f"SELECT id, '  ' || {STORY} || '   x ' AS title, description, CASE id % 4 WHEN 0 THEN 'Met' WHEN 1 THEN '' WHEN 2 THEN 'Earthquake' ELSE hazard_type END AS hazard_type, official_severity, CASE id % 3 WHEN 0 THEN 'extreme' WHEN 1 THEN 'unknown' ELSE NULL END AS normalized_severity FROM alerts"
X4_COMBINED = "title || ' ' || coalesce(description, 'None')"


@query("x4_normalize_alert", f"""SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(description, '') AS description,
CASE WHEN lower(hazard_type) IN ('met','weather','unknown','') THEN {_duck_label(X4_COMBINED, K.HAZARD_WORDS)} ELSE {_duck_label('hazard_type', K.HAZARD_WORDS)} END AS hazard_type,
CASE WHEN official_severity <> '' THEN {_duck_label('official_severity', K.SEVERITY_WORDS)} WHEN coalesce(normalized_severity, '') IN ('', 'unknown') THEN {_duck_label(X4_COMBINED, K.SEVERITY_WORDS)} ELSE normalized_severity END AS normalized_severity
FROM ({X4_IN}) a""")
def _(spark, d):
    rows = spark.sql(X4_IN.replace("FROM alerts", "FROM {alerts}"), alerts=view(spark, d, "alerts"))
    return text.normalize_alert(rows).select("id", "title", "description", "hazard_type", "normalized_severity")


@query("x5_clean_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("x6_fold", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


X7_IN = "CASE id % 6 WHEN 0 THEN 'District ' || title WHEN 1 THEN title || ' Distt' WHEN 2 THEN '  Dera-Ghazi_Khan ' WHEN 3 THEN 'D.G. Khan' WHEN 4 THEN 'zila ' || title || ' district' ELSE title END"


@query("x7_location_name", f"""SELECT id, CASE n WHEN 'd g khan' THEN 'dera ghazi khan' WHEN 'd i khan' THEN 'dera ismail khan' WHEN 'dist' THEN 'district' WHEN 'distt' THEN 'district' ELSE n END AS name FROM (
SELECT id, regexp_replace(regexp_replace({O.fold(X7_IN)}, '^(?:district|distt?|zila)\\s+', ''), '\\s+(?:district|distt?|zila)$', '') AS n FROM alerts) z""")
def _(spark, d):
    return view(spark, d, "alerts").select("id", text.location_name(F.expr(X7_IN)).alias("name"))


@query("x8_to_ascii", """SELECT doc_id, regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(text,
'“', '"'), '”', '"'), '‘', ''''), '’', ''''), '—', '-'), '–', '-'), '°', ' deg '), '…', '...')), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents""")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", text.to_ascii(F.col("text")).alias("plain"))


@query("x9_wrap", "SELECT id, CASE WHEN id % 8 = 0 THEN 'N/A' ELSE 'Situation report ' || id || ', zone ' || CAST(substr(description, instr(description, 'zone ') + 5) AS VARCHAR) END AS wrapped FROM alerts")
def _(spark, d):
    return view(spark, d, "alerts").select("id", text.wrap(F.col("description")).alias("wrapped"))


# A wrap is right if it keeps every visible character, no line is too long, and no line could take the next one's first word.
@query("x9_wrap_long", """SELECT doc_id, md5(CASE WHEN visible = '' THEN 'N/A' ELSE visible END) AS visible, true AS short, true AS filled FROM (
SELECT doc_id, regexp_replace(plain, '[\\s\\x0b\\x1c-\\x1f]+', '', 'g') AS visible FROM (SELECT doc_id, regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(text,
'“', '"'), '”', '"'), '‘', ''''), '’', ''''), '—', '-'), '–', '-'), '°', ' deg '), '…', '...')), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents) p) q""")
def _(spark, d):
    wrapped = view(spark, d, "documents").select("doc_id", text.wrap(F.col("text")).alias("w"))
    lines = wrapped.withColumn("paragraphs", F.transform(F.split("w", "\n\n"), lambda p: F.split(p, "\n")))
    room = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(
        F.length(a) + 1 + F.length(F.get(F.split(b, " "), F.lit(0))) <= 78, F.lit(False)))
    return lines.select(
        "doc_id", F.md5(F.regexp_replace("w", r"[\s\x0b\x1c-\x1f]+", "")).alias("visible"),
        F.forall(F.flatten("paragraphs"), lambda x: F.length(x) <= 78).alias("short"),
        (~F.exists("paragraphs", lambda p: F.exists(room(p), lambda x: x))).alias("filled"))


X10_CTX = "title || chr(10) || CASE id % 3 WHEN 0 THEN '1. Leave the river bank' || chr(10) || '2) Call for help' WHEN 1 THEN '1. Short one' ELSE '' END"


@query("x10_safety_instructions", "SELECT id, CASE id % 3 WHEN 0 THEN 'Leave the river bank|Call for help' ELSE CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(hazard_type, '{w}')" for w in words) + " THEN '" + "|".join(K.SAFETY_LINES[f]) + "'" for f, words in K.SAFETY_WORDS)
    + " ELSE '" + "|".join(K.SAFETY_LINES["other"]) + "' END END AS lines FROM alerts")
def _(spark, d):
    lines = text.safety_instructions(F.col("hazard_type"), text.to_ascii(F.expr(X10_CTX)))
    return view(spark, d, "alerts").select("id", F.array_join(lines, "|").alias("lines"))


@query("x11_report_filename", """SELECT a.id, strftime(a.issued_at + INTERVAL 5 HOUR, '%Y-%m-%d_%H-%M-%S') || '_' ||
substr(upper(replace(s.name, ' ', '_')), 1, 10) || '_' || substr(upper(a.hazard_type), 1, 15) || '_' || substr(replace(replace(upper(a.title), '-', '_'), ' ', '_'), 1, 20) || '.txt' AS file_name
FROM alerts a JOIN sources s ON s.id = a.source_id""")
def _(spark, d):
    rows = J.with_source(view(spark, d, "alerts"), view(spark, d, "sources"))
    return rows.select("id", text.report_filename(F.col("issued_at"), F.col("source_name"), F.col("hazard_type"), F.col("title")).alias("file_name"))


@query("x12_location_label", "SELECT id, CASE WHEN id % 2 = 0 THEN title WHEN id % 3 = 0 THEN hazard_type ELSE coalesce(source_alert_id, 'Advisory Location') END AS label FROM alerts")
def _(spark, d):
    first = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("")
    second = F.when(F.col("id") % 3 == 0, F.col("hazard_type"))
    return view(spark, d, "alerts").select("id", text.location_label(first, second, F.col("source_alert_id")).alias("label"))


@query("x13_evidence_label", "SELECT loc_id, alert_id, CASE WHEN alert_id % 5 = 0 THEN 'Resolved through location hierarchy' WHEN text_source = 'STRUCTURED_SCRAPER_FIELD' THEN 'Source-provided' ELSE 'Inferred from advisory text' END AS label FROM alert_locations")
def _(spark, d):
    method = F.when(F.col("alert_id") % 5 == 0, "HIERARCHY_INFERRED").otherwise("EXACT_ALIAS")
    return view(spark, d, "alert_locations").select("loc_id", "alert_id", text.evidence_label(method, F.col("text_source")).alias("label"))


@query("x14_parser_name", "SELECT id, CASE WHEN contains(name, 'PMD Weather') THEN 'PMDWeatherScraper' WHEN contains(name, 'NDMA') THEN 'NDMAScraper' WHEN contains(name, 'FFD') THEN 'FFDBulletinScraper' ELSE 'PMDEarthquakeScraper' END AS parser FROM source_status")
def _(spark, d):
    return view(spark, d, "source_status").select("id", text.parser_name(F.col("name")).alias("parser"))


@query("x16_safe_candidate", """SELECT numeric_id, NOT (entity_type IN ('VILLAGE','LOCALITY') AND NOT contains(p, ' ') AND length(p) < 6) AND (length(p) >= 3 OR p IN ('kp','gb','pb')) AS safe
FROM (SELECT numeric_id, entity_type, CASE numeric_id % 5 WHEN 0 THEN 'kot' WHEN 1 THEN 'gb' WHEN 2 THEN 'zz' WHEN 3 THEN 'old kot' ELSE 'kotriabad' END AS p FROM gazetteer) g""")
def _(spark, d):
    p = F.expr("CASE numeric_id % 5 WHEN 0 THEN 'kot' WHEN 1 THEN 'gb' WHEN 2 THEN 'zz' WHEN 3 THEN 'old kot' ELSE 'kotriabad' END")
    return view(spark, d, "gazetteer").select("numeric_id", text.safe_for_text(F.col("entity_type"), p).alias("safe"))


@query("x17_alert_facts", """SELECT id, strftime(issued_at + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') AS issued, CASE WHEN expires_at IS NOT NULL THEN strftime(coalesce(starts_at, issued_at) + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') || ' – ' || strftime(expires_at + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') END AS validity,
coalesce(description, '') AS summary FROM alerts""")
def _(spark, d):
    show = timeops.pkt_short
    validity = F.when(F.col("expires_at").isNotNull(), F.concat_ws(" – ", show(F.coalesce("starts_at", "issued_at")), show(F.col("expires_at"))))
    return view(spark, d, "alerts").select("id", show(F.col("issued_at")).alias("issued"), validity.alias("validity"),
                                           F.array_join(text.fallback_sentences(F.col("description")), "|").alias("summary"))


@query("x1_geonames_type", """SELECT p_partkey, CASE WHEN code = 'PCLI' THEN 'COUNTRY' WHEN code = 'ADM1' THEN CASE WHEN contains(name, 'AZAD') THEN 'TERRITORY' ELSE 'PROVINCE' END WHEN code = 'ADM2' THEN CASE WHEN contains(name, 'DIVISION') THEN 'DIVISION' ELSE 'DISTRICT' END
WHEN code = 'ADM3' THEN 'TEHSIL' WHEN cls = 'P' THEN CASE WHEN code = 'PPLA' OR pop >= 100000 THEN 'CITY' WHEN pop >= 10000 THEN 'TOWN' WHEN code = 'PPLX' THEN 'LOCALITY' ELSE 'VILLAGE' END
WHEN code = 'STMI' OR code = 'CNL' THEN 'RIVER' WHEN code = 'DAM' THEN CASE WHEN contains(name, 'BARRAGE') THEN 'BARRAGE' ELSE 'DAM' END WHEN code = 'RGN' THEN 'REGION' WHEN code = 'BAY' THEN 'COASTAL_AREA' END AS entity_type
FROM (SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN 'PCLI' WHEN 1 THEN 'ADM1' WHEN 2 THEN 'ADM2' WHEN 3 THEN 'ADM3' WHEN 4 THEN 'PPLA' WHEN 5 THEN 'PPLX' WHEN 6 THEN 'PPL' WHEN 7 THEN 'STMI' WHEN 8 THEN 'CNL' WHEN 9 THEN 'DAM' WHEN 10 THEN 'RGN' WHEN 11 THEN 'BAY' ELSE 'XXX' END AS code,
CASE WHEN p_partkey % 13 IN (4,5,6) THEN 'P' ELSE 'H' END AS cls, CASE p_partkey % 3 WHEN 0 THEN 'AZAD BARRAGE DIVISION' ELSE 'PLAIN' END AS name, p_size * 3000 * (p_partkey % 2) AS pop FROM part) g""")
def _(spark, d):
    part = view(spark, d, "part").selectExpr(
        "p_partkey", "element_at(array('PCLI','ADM1','ADM2','ADM3','PPLA','PPLX','PPL','STMI','CNL','DAM','RGN','BAY','XXX'), CAST(p_partkey % 13 AS INT) + 1) AS code",
        "CASE WHEN p_partkey % 13 IN (4,5,6) THEN 'P' ELSE 'H' END AS cls", "CASE p_partkey % 3 WHEN 0 THEN 'Azad Barrage Division' ELSE 'plain' END AS name", "p_size * 3000 * (p_partkey % 2) AS pop")
    return part.select("p_partkey", text.geonames_type(F.col("cls"), F.col("code"), F.col("name"), F.col("pop")).alias("entity_type"))


# ---- dates --------------------------------------------------------------------
D1_IN = "CASE event_id % 5 WHEN 0 THEN CAST(ts AS STRING) || '+05:00' WHEN 1 THEN replace(CAST(ts AS STRING), ' ', 'T') || 'Z' WHEN 2 THEN '17' || lpad(CAST(event_id AS STRING), 8, '0') WHEN 3 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END"


@query("d1_parse_ts", """SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN ts - INTERVAL 5 HOUR WHEN 1 THEN ts WHEN 2 THEN TIMESTAMP '1970-01-01' + to_seconds(1700000000 + event_id) WHEN 3 THEN NULL ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def _(spark, d):
    rows = view(spark, d, "events").select("event_id", timeops.parse_ts(F.expr(D1_IN)).alias("parsed"))
    return text_times(rows, "parsed")


@query("d2_effective_ts", f"SELECT id, {O.ts(O.EFFECTIVE)} AS effective FROM alerts")
def _(spark, d):
    rows = view(spark, d, "alerts")
    return text_times(rows.select("id", L.effective(rows).alias("effective")), "effective")


@query("d3_window_bounds", f"SELECT id, {O.ts('issued_at - INTERVAL 7 DAY')} AS w_start, {O.ts('issued_at + INTERVAL 15 MINUTE')} AS w_end FROM alerts")
def _(spark, d):
    start, end = timeops.window_bounds(F.col("issued_at"))
    return text_times(view(spark, d, "alerts").select("id", start.alias("w_start"), end.alias("w_end")), "w_start", "w_end")


@query("d4_format_pkt", """SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') || ' PKT' AS label, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' PKT' AS stamp,
strftime(ts - INTERVAL 7 DAY + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') || ' to ' || strftime(ts + INTERVAL 5 HOUR, '%-d %b %Y, %I:%M %p') || ' PKT' AS range_label FROM events""")
def _(spark, d):
    t = F.col("ts").cast("timestamp")
    return view(spark, d, "events").select("event_id", timeops.pkt_label(t).alias("label"), timeops.pkt_stamp(t).alias("stamp"),
                                           timeops.window_label(t - F.expr("INTERVAL 7 DAYS"), t).alias("range_label"))


REL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1e6"


REL_AMOUNT = f"CAST(CASE WHEN abs(floor({REL} / 86400 + 0.5)) >= 1 THEN floor({REL} / 86400 + 0.5) WHEN abs(floor({REL} / 3600 + 0.5)) >= 1 THEN floor({REL} / 3600 + 0.5) ELSE floor({REL} / 60 + 0.5) END AS BIGINT)"
REL_UNIT = f"CASE WHEN abs(floor({REL} / 86400 + 0.5)) >= 1 THEN 'day' WHEN abs(floor({REL} / 3600 + 0.5)) >= 1 THEN 'hour' ELSE 'minute' END"


@query("d5_relative_time", f"""SELECT event_id, amount, unit, CASE WHEN unit = 'day' AND amount = 1 THEN 'tomorrow' WHEN unit = 'day' AND amount = -1 THEN 'yesterday'
WHEN unit = 'minute' AND amount = 0 THEN 'this minute' WHEN amount > 0 THEN 'in ' || amount || ' ' || unit || CASE WHEN amount = 1 THEN '' ELSE 's' END
ELSE -amount || ' ' || unit || CASE WHEN amount = -1 THEN '' ELSE 's' END || ' ago' END AS phrase FROM (SELECT event_id, {REL_AMOUNT} AS amount, {REL_UNIT} AS unit FROM events) e""")
def _(spark, d):
    amount, unit = timeops.relative_time(F.col("ts").cast("timestamp"), timeops.as_of_column("2024-01-15 12:00:00"))
    rows = view(spark, d, "events").select("event_id", amount.alias("amount"), unit.alias("unit"))
    return rows.withColumn("phrase", timeops.relative_phrase(F.col("amount"), F.col("unit")))


@query("d6_backfill_effective", f"SELECT id, {O.ts('coalesce(effective_event_at, issued_at, starts_at, created_at)')} AS effective_event_at FROM alerts")
def _(spark, d):
    filled = F.coalesce("effective_event_at", "issued_at", "starts_at", "created_at")
    return text_times(view(spark, d, "alerts").select("id", filled.alias("effective_event_at")), "effective_event_at")


# ---- geo and magnitude ---------------------------------------------------------
@query("g1_haversine_km", f"SELECT s_suppkey, round({O.haversine(LAT, LNG, 'latitude', 'longitude')}, 6) AS km FROM cities")
def _(spark, d):
    km = geo.haversine_km(F.lit(LAT), F.lit(LNG), F.col("latitude"), F.col("longitude"))
    return view(spark, d, "cities").select("s_suppkey", F.round(km, 6).alias("km"))


@query("g2_round_km", f"SELECT s_suppkey, round({O.haversine(LAT, LNG, 'latitude', 'longitude')}, 2) AS km FROM cities")
def _(spark, d):
    km = geo.haversine_km(F.lit(LAT), F.lit(LNG), F.col("latitude"), F.col("longitude"))
    return view(spark, d, "cities").select("s_suppkey", geo.round_km(km).alias("km"))


@query("g3_pop_thousands", "SELECT o_orderkey, CAST(floor(CAST(o_totalprice AS BIGINT) / 1000 + 0.5) AS BIGINT) AS thousands FROM orders")
def _(spark, d):
    return view(spark, d, "orders").select("o_orderkey", geo.thousands(F.round("o_totalprice").cast("bigint")).alias("thousands"))


@query("g4_validated_coords", f"""SELECT a.alert_id, CASE WHEN {O.country('a.latitude', 'a.longitude')} THEN a.latitude WHEN {O.country('c.latitude', 'c.longitude')} THEN c.latitude END AS lat,
CASE WHEN {O.country('a.latitude', 'a.longitude')} THEN a.longitude WHEN {O.country('c.latitude', 'c.longitude')} THEN c.longitude END AS lng
FROM resolutions a JOIN cities c ON a.alert_id % 10 = c.s_suppkey""")
def _(spark, d):
    city = view(spark, d, "cities").selectExpr("s_suppkey AS k", "latitude AS lat2", "longitude AS lng2")
    rows = view(spark, d, "resolutions").withColumn("k", F.col("alert_id") % 10).join(city, "k")
    pair = geo.checked_pair(*[F.col(c) for c in ("latitude", "longitude", "lat2", "lng2")])
    return rows.select("alert_id", pair.alias("p")).select("alert_id", "p.*")


@query("m1_magnitude_severity", "SELECT event_id, CASE WHEN value / 60 >= 7 THEN 'critical' WHEN value / 60 >= 5 THEN 'high' WHEN value / 60 >= 4 THEN 'medium' ELSE 'low' END AS severity FROM events")
def _(spark, d):
    return view(spark, d, "events").select("event_id", geo.magnitude_severity(F.col("value") / 60).alias("severity"))


@query("m2_magnitude_status", "SELECT event_id, CASE WHEN (15 + event_id % 40 BETWEEN 20 AND 42 AND 50 + event_id % 50 BETWEEN 55 AND 85 AND value / 60 >= 4) OR value / 60 >= 5 THEN 'active' ELSE 'pending' END AS status FROM events")
def _(spark, d):
    return view(spark, d, "events").select("event_id", geo.magnitude_status(F.col("value") / 60, 15 + F.col("event_id") % 40, 50 + F.col("event_id") % 50).alias("status"))


@query("m3_flood_severity", f"SELECT event_id, CASE WHEN level IN ('Exceptionally High','Very High') THEN 'critical' WHEN level = 'High' THEN 'high' WHEN level = 'Medium' THEN 'medium' WHEN level IN ('Low','Below Low') THEN 'low' ELSE 'unknown' END AS severity FROM ({CONDITIONS}) c")
def _(spark, d):
    from alertloom.operators.bulletins import flood_severity
    return conditions(spark, d).select("event_id", flood_severity(F.col("level")).alias("severity"))


@query("m4_source_state", "SELECT id, CASE WHEN health_status = 'unhealthy' OR consecutive_failures >= 3 THEN 'UNAVAILABLE' WHEN consecutive_failures > 0 THEN 'RETRYING' ELSE 'OPERATIONAL' END AS state FROM source_status")
def _(spark, d):
    return view(spark, d, "source_status").select("id", A.source_state(F.col("consecutive_failures"), F.col("health_status")).alias("state"))


@query("f15_split_river_rows", f"SELECT event_id, CASE WHEN level IS NOT NULL THEN 'current' ELSE 'forecast' END AS part FROM ({CONDITIONS}) c")
def _(spark, d):
    now, later = L.split_river_rows(conditions(spark, d))
    return now.select("event_id", F.lit("current").alias("part")).unionByName(later.select("event_id", F.lit("forecast").alias("part")))


# ---- addresses ----------------------------------------------------------------
@query("p1_normalize_ip", "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN NULL ELSE v END AS address FROM access_log")
def _(spark, d):
    v = ip.ip_text(F.col("v"))
    shown = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" ::FFFF:"), v)).when(F.col("event_id") % 10 == 1, F.concat(v, F.lit(".9")))
             .when(F.col("event_id") % 10 == 6, F.lit("300.1.2.3")).otherwise(v))
    return view(spark, d, "access_log").select("event_id", ip.normalize_ip(shown).alias("address"))


TRUSTED = ["10.0.0.0/8"]
TEN = "(v BETWEEN 167772160 AND 184549375)"
P2 = f"""SELECT event_id, CASE step WHEN 'x_real_ip' THEN w WHEN 'peer' THEN peer_ip ELSE v END AS address, CASE WHEN step IN ('peer', 'outsider') THEN 'request_client' ELSE step END AS source,
step = 'peer' AND (event_id % 14 = 0 OR event_id % 9 = 0) AS invalid_input FROM (
SELECT event_id, v, w, CASE WHEN event_id % 4 = 0 THEN 167772160 + (event_id % 256) * 256 + 7 ELSE v END AS peer_ip,
CASE WHEN event_id % 4 <> 0 AND NOT {TEN} THEN 'outsider' WHEN event_id % 10 = 0 THEN 'cf_connecting_ip' WHEN event_id % 9 <> 0 AND event_id % 2 = 0 AND NOT {TEN} THEN 'x_forwarded_for'
WHEN event_id % 6 = 0 THEN 'x_real_ip' ELSE 'peer' END AS step FROM access_log) z"""


@query("p2_client_ip", P2)
def _(spark, d):
    c = ip.client_ip(*[F.col(n) for n in ("peer", "cf_connecting_ip", "x_forwarded_for", "x_real_ip")], trusted=TRUSTED)
    return view(spark, d, "access_log").select("event_id", c.alias("c")).select("event_id", "c.address", "c.source", "c.invalid_input")


@query("p3_is_public_ip", f"SELECT event_id, NOT {not_public('v')} AS is_public FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 167772160 + event_id WHEN 1 THEN 3221225472 + event_id % 300 WHEN 2 THEN 3232235520 + event_id WHEN 3 THEN 1681915904 + event_id ELSE v END AS v FROM access_log) z")
def _(spark, d):
    v = F.expr("CASE event_id % 7 WHEN 0 THEN 167772160 + event_id WHEN 1 THEN 3221225472 + event_id % 300 WHEN 2 THEN 3232235520 + event_id WHEN 3 THEN 1681915904 + event_id ELSE v END")
    return view(spark, d, "access_log").select("event_id", ip.is_public(v).alias("is_public"))
