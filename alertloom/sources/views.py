"""Domain views over the driver tables.

The only module that knows the TPC-like columns. Each view is one SELECT; the
same text serves Spark and, through another ``Dialect``, the DuckDB checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from alertloom import constants as K
from alertloom.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages", "benchmark", "labels", "conversations",
]
ORDER_AS_OF = "2000-01-01 00:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"


class SparkDialect:
    """Spark spelling of the few constructs the two engines write differently."""

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def ts(self, expr: str) -> str:
        return f"CAST({expr} AS TIMESTAMP)"

    def days(self, expr: str) -> str:
        return f"make_dt_interval(CAST({expr} AS INT))"

    def hours(self, expr: str) -> str:
        return f"make_dt_interval(0, CAST({expr} AS INT))"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def sha256(self, expr: str) -> str:
        return f"sha2({expr}, 256)"

    def word(self, expr: str, n: int) -> str:
        return f"get(split({expr}, ' '), {n - 1})"

    def rename(self, expr: str) -> str:
        return expr


class DuckDialect(SparkDialect):
    def table(self, name: str) -> str:
        return name

    def ts(self, expr: str) -> str:
        return f"CAST({expr} AS TIMESTAMP)"

    def days(self, expr: str) -> str:
        return f"to_days(CAST({expr} AS INT))"

    def hours(self, expr: str) -> str:
        return f"to_hours(CAST({expr} AS INT))"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def sha256(self, expr: str) -> str:
        return f"sha256({expr})"

    def word(self, expr: str, n: int) -> str:
        return f"string_split({expr}, ' ')[{n}]"


def choose(expr: str, values: list[str]) -> str:
    """CASE over 0..n-1."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _sources(q) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS id, '{n}' AS name, '{t}' AS source_type, '{u}' AS scrape_url, {p} AS polling_interval_minutes"
        for i, n, t, u, p in K.SOURCE_ROWS
    )
    return rows


def _alerts(q) -> str:
    hazards = choose("o_orderkey % 9", K.HAZARD_VOCABULARY)
    return f"""
SELECT o_orderkey AS id, CAST(o_custkey % 4 + 1 AS INT) AS source_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'A' || CAST(o_orderkey AS STRING) END AS source_alert_id,
  o_orderpriority || ' notice ' || CAST(o_custkey AS STRING) AS title,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Situation report ' || CAST(o_orderkey AS STRING) || ', zone ' || CAST(o_custkey % 25 AS STRING) || '.' END AS description,
  {hazards} AS hazard_type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {choose("o_orderkey % 4", ["Severe", "Moderate", "Minor", "Extreme"])} END AS official_severity,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS normalized_severity,
  CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderkey % 13 = 0 THEN 'rejected'
       WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'expired' END AS status,
  {q.ts('o_orderdate')} AS issued_at,
  {q.ts('o_orderdate')} + {q.days('o_orderkey % 5')} AS starts_at,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {q.ts('o_orderdate')} + {q.days('o_orderkey % 40')} END AS expires_at,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {q.ts('o_orderdate')} + {q.hours('o_orderkey % 36')} END AS effective_event_at,
  {q.ts('o_orderdate')} + {q.hours('1')} AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {q.ts('o_orderdate')} + {q.hours('o_orderkey % 50')} END AS updated_at,
  'https://feeds.example/alert/' || CAST(o_orderkey AS STRING) AS source_url,
  'Raw ' || o_orderpriority || ' ' || CAST(o_orderkey AS STRING) AS raw_text
FROM {q.table('orders')}"""


def _city_columns(q, key="s_suppkey") -> str:
    return f"""
  CASE WHEN {key} % 17 = 0 THEN NULL ELSE 23 + ({key} * 7919 % 15000) / 1e3 + CASE WHEN {key} % 19 = 0 THEN 40 ELSE 0 END END AS latitude,
  CASE WHEN {key} % 17 = 0 THEN NULL ELSE 60 + ({key} * 104729 % 18500) / 1e3 END AS longitude"""


def _cities(q) -> str:
    return f"""
SELECT s_suppkey, s_name AS city, n_name AS district, r_name AS province, {_city_columns(q)}
FROM {q.table('supplier')} JOIN {q.table('nation')} ON s_nationkey = n_nationkey
JOIN {q.table('region')} ON n_regionkey = r_regionkey"""


def _alert_locations(q) -> str:
    pad = lambda e, n: f"lpad(CAST({e} AS STRING), {n}, '0')"
    return f"""
SELECT l_orderkey AS alert_id,
  {pad('l_linenumber', 2)} || '-' || {pad('l_partkey', 12)} || '-' || {pad('l_suppkey', 12)} || '-' || {pad('CAST(round(l_extendedprice * 100) AS BIGINT)', 12)} || '-' || {pad('CAST(l_shipdate AS DATE)', 10)} AS loc_id,
  province, district, city, city AS raw_location, city AS canonical_name,
  CASE WHEN l_suppkey % 3 = 0 THEN 'CITY' ELSE 'TOWN' END AS entity_type,
  latitude, longitude,
  {choose('l_linenumber % 5', ['STRUCTURED_SCRAPER_FIELD', 'TITLE', 'DESCRIPTION', 'SAFETY_INSTRUCTIONS', 'RAW_TEXT'])} AS text_source,
  CASE l_linenumber % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 60 WHEN 3 THEN 40 ELSE 20 END AS evidence_score
FROM {q.table('lineitem')} JOIN {q.table('cities')} ON l_suppkey = s_suppkey"""


def _resolutions(q) -> str:
    return f"""
SELECT o_orderkey AS alert_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'NATION_' || CAST(o_custkey % 25 AS STRING) END AS district,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Seat ' || CAST(o_custkey % 25 AS STRING) END AS city,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Zone ' || CAST(o_custkey % 5 AS STRING) END AS province,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 22 + (o_orderkey * 37 % 17000) / 1e3 END AS latitude,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 59 + (o_orderkey * 53 % 20000) / 1e3 END AS longitude,
  CASE WHEN o_orderkey % 4 = 0 THEN 'UNRESOLVED' ELSE 'TITLE_EXTRACTION' END AS source,
  CASE WHEN o_orderkey % 4 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence,
  o_orderkey % 4 <> 0 AS is_inferred,
  {q.sha256("CAST(o_orderkey AS STRING) || ':' || CAST(o_orderkey % 3 AS STRING)")} AS cache_key
FROM {q.table('orders')} WHERE o_orderkey % 5 <> 4"""


def _gazetteer(q) -> str:
    none = "CAST(NULL AS BIGINT)"
    return f"""
SELECT CAST(1 + r_regionkey AS BIGINT) AS numeric_id, 'p' || CAST(r_regionkey AS STRING) AS location_id, r_name AS canonical_name, 'PROVINCE' AS entity_type,
  {none} AS province_id, {none} AS district_id, {none} AS tehsil_id, {none} AS division_id, {none} AS parent_id,
  CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, {none} AS population, r_name || ' Province' AS alias
FROM {q.table('region')}
UNION ALL
SELECT CAST(100 + n_nationkey AS BIGINT), 'd' || CAST(n_nationkey AS STRING), n_name, 'DISTRICT', CAST(1 + n_regionkey AS BIGINT), {none}, {none}, {none}, CAST(1 + n_regionkey AS BIGINT),
  24 + (n_nationkey * 613 % 13000) / 1e3, 61 + (n_nationkey * 911 % 17000) / 1e3, {none}, n_name || ' District'
FROM {q.table('nation')}
UNION ALL
SELECT 1000 + s_suppkey, 's' || CAST(s_suppkey AS STRING),
  CASE WHEN s_suppkey % 23 = 0 THEN n_name ELSE s_name END,
  CASE WHEN s_suppkey % 3 = 0 THEN 'CITY' WHEN s_suppkey % 7 = 0 THEN 'TEHSIL' ELSE 'TOWN' END,
  CAST(1 + n_regionkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), {none}, {none}, CAST(100 + s_nationkey AS BIGINT),
  {_city_columns(q)}, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey * 37 % 1000 END, 'Old ' || s_name
FROM {q.table('supplier')} JOIN {q.table('nation')} ON s_nationkey = n_nationkey
UNION ALL
SELECT 1000000 + c_custkey, 'c' || CAST(c_custkey AS STRING), c_name, 'VILLAGE', CAST(1 + n_regionkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), {none}, {none}, CAST(100 + c_nationkey AS BIGINT),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {none}, CASE WHEN c_custkey % 50 = 0 THEN 'Old Supplier#' || lpad(CAST(c_custkey % 10 AS STRING), 9, '0') ELSE CAST(NULL AS STRING) END
FROM {q.table('customer')} JOIN {q.table('nation')} ON c_nationkey = n_nationkey"""


def _advisories(q) -> str:
    """Incoming alerts whose texts name places of the gazetteer view."""
    sup = lambda e: f"'Supplier#' || lpad(CAST({e} AS STRING), 9, '0')"
    return f"""
SELECT o_orderkey AS id, CAST(o_custkey % 4 + 1 AS INT) AS source_id, 'A' || CAST(o_orderkey AS STRING) AS source_alert_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'Rain warning for ' || {sup('o_custkey % 10')}
    WHEN 1 THEN 'Flood in NATION_' || CAST(o_custkey % 25 AS STRING) || ' District'
    WHEN 2 THEN 'Heat across ' || CASE o_custkey % 2 WHEN 0 THEN 'ASIA' ELSE 'Middle East' END
    ELSE 'General bulletin ' || CAST(o_orderkey AS STRING) END AS title,
  CASE o_orderkey % 5 WHEN 0 THEN 'Roads shut near ' || {sup('o_orderkey % 10')} || ' and district NATION_' || CAST(o_orderkey % 25 AS STRING) || '; NATION_' || CAST(o_orderkey % 25 AS STRING) || ' on alert.'
    WHEN 1 THEN 'NATION_' || CAST(o_orderkey % 25 AS STRING) || ', NATION_' || CAST(o_custkey % 25 AS STRING) || ' and NATION_' || CAST(o_orderkey % 25 AS STRING) || ' report damage.'
    WHEN 2 THEN 'Level rising on River Indus at Tarbela.'
    WHEN 3 THEN 'Old ' || {sup('o_orderkey % 10')} || ' (tehsil ' || {sup('7')} || ') flooded.'
    ELSE NULL END AS description,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Notice: ' || {sup('o_custkey % 10')} || '/NATION_' || CAST(o_custkey % 25 AS STRING) ELSE 'No place named.' END AS raw_text,
  CASE WHEN o_orderkey % 9 = 0 THEN 'NATION_' || CAST(o_custkey % 25 AS STRING) WHEN o_orderkey % 9 = 3 THEN {sup('o_custkey % 10')} WHEN o_orderkey % 9 = 5 THEN 'Atlantis ' || CAST(o_custkey % 7 AS STRING) ELSE NULL END AS raw_location,
  CASE WHEN o_orderkey % 10 = 5 THEN 30 + (o_orderkey % 50) / 1e1 ELSE NULL END AS loc_lat,
  CASE WHEN o_orderkey % 10 = 5 THEN 66 + (o_custkey % 50) / 1e1 ELSE NULL END AS loc_lng
FROM {q.table('orders')}"""


def _poll_log(q) -> str:
    return f"""
SELECT user_id AS source_id, {q.ts('ts')} AS checked_at, event_id, event_type <> 'error' AS ok FROM {q.table('events')}"""


def _alert_versions(q) -> str:
    sev = choose("v % 4", ["low", "medium", "high", "critical"])
    return f"""
SELECT event_id AS seq, 1 AS source_id, 'U' || CAST(user_id AS STRING) AS source_alert_id, received_at, hazard_type, {sev} AS normalized_severity,
  hazard_type || ' ' || CAST({q.div('v', '2')} AS STRING) || CASE WHEN event_id % 3 = 0 THEN '!' ELSE '' END AS description,
  'Version of ' || CAST(user_id AS STRING) AS title, {q.sha256("CAST(user_id AS STRING) || hazard_type || CAST(v AS STRING)")} AS content_hash
FROM (SELECT event_id, user_id, {q.ts('ts')} AS received_at, CASE event_type WHEN 'view' THEN 'flood' WHEN 'click' THEN 'flood' ELSE event_type END AS hazard_type, CAST(floor(value / 100) AS BIGINT) AS v FROM {q.table('events')}) e"""


def _raw_documents(q) -> str:
    return f"""
SELECT doc_id AS id, source, CAST(doc_id % 4 + 1 AS INT) AS source_id, 'https://feeds.example/doc/' || CAST(doc_id AS STRING) AS url, 'text/html' AS content_type,
  text AS raw_text, {q.sha256('text')} AS content_hash, CAST(200 AS INT) AS http_status,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + {q.hours('doc_id % 700')} AS retrieved_at
FROM {q.table('documents')}"""


def _phrases(q) -> str:
    two = f"lower({q.word('text', 1)} || ' ' || {q.word('text', 2)})"
    return f"""
SELECT pattern, min(item_id) AS numeric_id, min(item_id % 5) AS kind FROM (SELECT {two} AS pattern, item_id FROM {q.table('benchmark')}) b GROUP BY pattern"""


def _access_log(q) -> str:
    octets = lambda v: " || '.' || ".join(f"CAST({q.div(v, str(256 ** p))} % 256 AS STRING)" for p in (3, 2, 1, 0))
    return f"""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.' || CAST(event_id % 256 AS STRING) || '.7' ELSE {octets('v')} END AS peer,
  CASE WHEN event_id % 10 = 0 THEN {octets('v')} WHEN event_id % 14 = 0 THEN 'not-an-ip' ELSE NULL END AS cf_connecting_ip,
  CASE WHEN event_id % 9 = 0 THEN '1.2.3, ' || {octets('v')} WHEN event_id % 2 = 0 THEN {octets('v')} || ', 10.0.0.' || CAST(event_id % 200 AS STRING) ELSE NULL END AS x_forwarded_for,
  CASE WHEN event_id % 6 = 0 THEN {octets('w')} ELSE NULL END AS x_real_ip, v, w
FROM (SELECT event_id, (user_id * 2654435761) % 4294967296 AS v, (event_id * 40503 + 16777216) % 4294967296 AS w FROM {q.table('events')}) e"""


def _ip_ranges(q) -> str:
    return f"""
SELECT n_nationkey * 171798692 AS ip_start, n_nationkey * 171798692 + 171798691 - CASE WHEN n_nationkey % 6 = 0 THEN 50000000 ELSE 0 END AS ip_end, n_name AS city,
  24 + n_nationkey / 5e0 AS lat, CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE 61 + n_nationkey / 4e0 END AS lng
FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM {q.table('nation')}) n"""


def _viewers(q) -> str:
    return f"""
SELECT c_custkey AS viewer_id, 23 + (c_custkey * 7919 % 15000) / 1e3 AS lat, 60 + (c_custkey * 104729 % 18500) / 1e3 AS lng
FROM {q.table('customer')}"""


def _source_status(q) -> str:
    """One row per polled source: state after all polls."""
    return f"""
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'PMD Weather' WHEN 1 THEN 'NDMA Advisories' WHEN 2 THEN 'FFD Bulletins' ELSE 'Seismic Centre' END || ' ' || CAST(s_suppkey AS STRING) AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 5 END AS consecutive_failures,
  CASE WHEN s_suppkey % 13 = 0 THEN 'unhealthy' ELSE 'healthy' END AS health_status,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) + {q.hours('s_suppkey % 800')} END AS last_checked_at
FROM {q.table('supplier')}"""


VIEWS = {
    "sources": _sources, "alerts": _alerts, "cities": _cities, "alert_locations": _alert_locations,
    "resolutions": _resolutions, "gazetteer": _gazetteer, "advisories": _advisories, "poll_log": _poll_log,
    "alert_versions": _alert_versions, "raw_documents": _raw_documents, "phrases": _phrases,
    "access_log": _access_log, "ip_ranges": _ip_ranges, "viewers": _viewers, "source_status": _source_status,
}


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view (or a driver table) as a lazy DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name](SparkDialect())
    inputs = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **inputs)


def duck_with(body: str) -> str:
    """The body with the views it names put in front as WITH clauses."""
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in done and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.IGNORECASE):
                sql = VIEWS[name](DuckDialect())
                need(sql)
                done[name] = sql

    need(body)
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in done.items())
    return f"WITH {ctes}\nSELECT * FROM ({body}) answer"
