"""Quality, hashing and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.functions import hashing, text, timeops
from alertloom.operators import aggregates as A, identity as I, quality as Q
from alertloom.operators.chunked import number_rows, time_chunks
from alertloom.plans import oracle_sql as O
from alertloom.plans.reads import text_times
from alertloom.plans.registry import query
from alertloom.sources.views import view

CHUNK = 5_000  # rows of a chunk, small enough for the checks to cross chunk borders


# ---- validation -----------------------------------------------------------------
V1_IN = """SELECT id, CASE WHEN id % 31 = 0 THEN 0 ELSE source_id END AS source_id, CASE WHEN id % 29 = 0 THEN '  ' WHEN id % 23 = 0 THEN 'Nationwide watch' ELSE title END AS title,
CASE WHEN id % 29 = 0 THEN NULL ELSE description END AS description, CASE WHEN id % 37 = 0 THEN NULL ELSE issued_at END AS issued_at, CASE WHEN id % 41 = 0 THEN '' ELSE source_url END AS source_url,
CASE WHEN id % 17 = 0 THEN NULL ELSE status END AS status, id % 3 <> 0 AS has_location FROM alerts"""


@query("v1_validate_alerts", f"""SELECT id, CASE WHEN len(e) > 0 THEN '["' || array_to_string(e, '", "') || '"]' END AS validation_errors,
CASE WHEN len(e) > 0 THEN 'incomplete' WHEN status IS NULL OR status = 'active' THEN 'pending' ELSE status END AS status FROM (
SELECT id, status, list_filter([CASE WHEN source_id = 0 THEN 'Missing source_id' END, CASE WHEN trim(title) = '' THEN 'Missing or empty title' END,
CASE WHEN issued_at IS NULL THEN 'Missing issue time (issued_at)' END, CASE WHEN source_url = '' THEN 'Missing source_url' END,
CASE WHEN NOT has_location AND NOT contains(lower(title), 'nationwide') THEN 'No affected locations identified' END], lambda x: x IS NOT NULL) AS e FROM ({V1_IN}) v) w""")
def _(spark, d):
    rows = spark.sql(V1_IN.replace("FROM alerts", "FROM {alerts}"), alerts=view(spark, d, "alerts"))
    return Q.validate_alerts(rows).select("id", "validation_errors", "status")


BAD = """SELECT numeric_id AS id, numeric_id AS pos, CASE WHEN numeric_id % 13 = 4 THEN 'PLANET' ELSE entity_type END AS entity_type, canonical_name,
CASE WHEN numeric_id % 17 = 3 THEN '' ELSE lower(canonical_name) END AS normalized_name, latitude, CASE WHEN numeric_id % 7 = 2 THEN NULL WHEN numeric_id % 11 = 5 THEN 200 ELSE longitude END AS longitude,
CASE WHEN numeric_id % 5 = 1 THEN 0 - population ELSE population END AS population, province_id, division_id, CASE WHEN numeric_id % 19 = 7 THEN NULL ELSE district_id END AS district_id, tehsil_id,
CASE WHEN numeric_id % 23 = 6 THEN 999999999 WHEN numeric_id % 29 = 8 THEN numeric_id + 1 WHEN numeric_id % 29 = 9 THEN numeric_id - 1 WHEN numeric_id % 29 = 10 THEN numeric_id - 2 ELSE parent_id END AS parent_id, CAST(NULL AS STRING) AS hierarchy_exception
FROM gazetteer UNION ALL SELECT numeric_id, numeric_id + 5000000, entity_type, canonical_name, 'twin', latitude, longitude, population, province_id, division_id, district_id, tehsil_id, parent_id, 'x' FROM gazetteer WHERE numeric_id % 3 = 0 AND entity_type = 'DISTRICT'"""

V2_SQL = f"""WITH RECURSIVE r AS ({BAD}), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
walk(id, here, depth) AS (SELECT id, parent_id, 1 FROM k WHERE parent_id IS NOT NULL UNION ALL SELECT walk.id, k.parent_id, depth + 1 FROM walk JOIN k ON k.id = walk.here WHERE k.parent_id IS NOT NULL AND depth < 40)
SELECT id, 'missing or duplicate id' AS error FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) > 1
UNION ALL SELECT id, 'invalid explicit type' FROM k WHERE entity_type = 'PLANET'
UNION ALL SELECT id, 'missing canonical or normalized name' FROM k WHERE normalized_name = ''
UNION ALL SELECT id, 'incomplete coordinate pair' FROM k WHERE (latitude IS NULL) <> (longitude IS NULL)
UNION ALL SELECT id, 'implausible coordinates' FROM k WHERE latitude IS NOT NULL AND NOT coalesce(latitude BETWEEN 22 AND 38.8 AND longitude BETWEEN 60 AND 78.8, false)
UNION ALL SELECT id, 'negative population' FROM k WHERE population < 0
UNION ALL SELECT id, 'tehsil has no district' FROM k WHERE entity_type = 'TEHSIL' AND district_id IS NULL
UNION ALL SELECT id, 'city has no district or documented exception' FROM k WHERE entity_type = 'CITY' AND district_id IS NULL
UNION ALL SELECT id, 'parent_id references missing record' FROM k WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM k)
UNION ALL SELECT id, 'circular parent relationship' FROM walk WHERE depth = 40"""


@query("v2_validate_gazetteer", V2_SQL)
def _(spark, d):
    gaz = view(spark, d, "gazetteer")
    return Q.validate_gazetteer(spark.sql(BAD.replace("FROM gazetteer", "FROM {gazetteer}"), gazetteer=gaz))


@query("v3_parsing_status", "SELECT doc_id, CASE WHEN text LIKE '%:%' THEN 'success' ELSE 'failed' END AS parsing_status, CASE WHEN text LIKE '%:%' THEN NULL ELSE 'no separator in ' || source END AS parsing_error FROM documents")
def _(spark, d):
    ok = F.col("text").contains(":")
    out = Q.parsing_status(view(spark, d, "documents"), ok, F.concat(F.lit("no separator in "), F.col("source")))
    return out.select("doc_id", "parsing_status", "parsing_error")


@query("v4_quarantine", "SELECT id, CASE WHEN source_alert_id IS NULL THEN 'no id' END AS reject_reason FROM alerts")
def _(spark, d):
    good, bad = Q.quarantine(view(spark, d, "alerts"), F.col("source_alert_id").isNull(), F.lit("no id"))
    return good.select("id", F.lit(None).cast("string").alias("reject_reason")).unionByName(bad.select("id", "reject_reason"))


# ---- hashes -----------------------------------------------------------------------
K1_IN = """SELECT id, id % 50 AS grp, source_id, CAST(id % 50 AS STRING) AS source_alert_id, CASE WHEN id % 2 = 0 THEN ' Flood WATCH ' ELSE 'flood watch' END AS title,
CASE id % 3 WHEN 0 THEN 'River, rising!' WHEN 1 THEN 'river rising' ELSE 'River falling' END AS description, 'flood' AS hazard_type, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS issued_at,
CAST(NULL AS TIMESTAMP) AS starts_at, CAST(NULL AS TIMESTAMP) AS expires_at, 'high' AS normalized_severity FROM alerts"""


@query("k1_content_hash", f"""SELECT a.id, min(b.id) AS same_as FROM (SELECT x.id, (source_id, source_alert_id, lower(trim(title)), id % 3 = 2, coalesce(locs, [])) AS k FROM ({K1_IN}) x
LEFT JOIN (SELECT alert_id, list_sort(list(DISTINCT trim(lower(concat_ws('-', coalesce(province, 'None'), coalesce(district, 'None'), coalesce(city, 'None'), coalesce(raw_location, 'None')))))) AS locs FROM alert_locations GROUP BY alert_id) l ON l.alert_id = x.id) a
JOIN (SELECT x.id, (source_id, source_alert_id, lower(trim(title)), id % 3 = 2, coalesce(locs, [])) AS k FROM ({K1_IN}) x
LEFT JOIN (SELECT alert_id, list_sort(list(DISTINCT trim(lower(concat_ws('-', coalesce(province, 'None'), coalesce(district, 'None'), coalesce(city, 'None'), coalesce(raw_location, 'None')))))) AS locs FROM alert_locations GROUP BY alert_id) l ON l.alert_id = x.id) b ON a.k = b.k GROUP BY a.id""")
def _(spark, d):
    rows = spark.sql(K1_IN.replace("FROM alerts", "FROM {alerts}"), alerts=view(spark, d, "alerts"))
    places = view(spark, d, "alert_locations").select(
        F.col("alert_id").alias("id"), "province", "district", "city", "raw_location").distinct()
    hashed = rows.join(hashing.location_digest(places, "id"), "id", "left").select(
        "id", hashing.content_hash(F.col("location_digest")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("id").alias("same_as"))
    return hashed.join(first, "h").select("id", "same_as")


@query("k2_cache_key", f"SELECT id, sha256(content_hash || ':{K.GAZETTEER_VERSION}:{K.EXTRACTION_VERSION}') AS cache_key FROM raw_documents")
def _(spark, d):
    key = hashing.cache_key(F.col("content_hash"), K.GAZETTEER_VERSION, K.EXTRACTION_VERSION)
    return view(spark, d, "raw_documents").select("id", key.alias("cache_key"))


@query("k3_document_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", hashing.document_hash(F.col("text")).alias("content_hash"))


@query("n1_primary_location", "SELECT alert_id, district, city, is_inferred FROM resolutions")
def _(spark, d):
    res = view(spark, d, "resolutions")
    record = F.to_json(F.struct(F.struct("city", "district", "is_inferred").alias("primary_location")))
    field = lambda name: F.get_json_object(record, f"$.primary_location.{name}")
    return res.select("alert_id", field("district").alias("district"), field("city").alias("city"),
                      field("is_inferred").cast("boolean").alias("is_inferred"))


@query("n2_compact_json", """SELECT alert_id, '{' || coalesce('"city":"' || city || '",', '') || '"confidence":"' || confidence || '",' || coalesce('"district":"' || district || '",', '') || '"source":"' || source || '"}' AS body FROM resolutions""")
def _(spark, d):
    body = F.to_json(F.struct("city", "confidence", "district", "source"))  # fields declared in sorted order
    return view(spark, d, "resolutions").select("alert_id", body.alias("body"))


@query("n3_list_json", """SELECT id, '["' || hazard_type || '", "' || status || '"]' AS body FROM alerts""")
def _(spark, d):
    return view(spark, d, "alerts").select("id", I.text_list(F.array("hazard_type", "status")).alias("body"))


@query("n4_sort_locations_key", """SELECT id, array_to_string(list_sort([lower(trim(title)), lower(hazard_type), lower(status)]), '|') AS body FROM alerts""")
def _(spark, d):
    parts = F.array_sort(F.transform(F.array("title", "hazard_type", "status"), lambda x: F.lower(F.trim(x))))
    return view(spark, d, "alerts").select("id", F.array_join(parts, "|").alias("body"))


# ---- versions ---------------------------------------------------------------------
CHAIN = """SELECT *, lag(content_hash) OVER (PARTITION BY source_alert_id ORDER BY received_at, seq) AS previous_hash FROM alert_versions"""


@query("w7_revision_chain", f"SELECT seq, previous_hash, CASE WHEN previous_hash IS NULL THEN 'created' WHEN previous_hash = content_hash THEN 'ignored' ELSE 'updated' END AS action FROM ({CHAIN}) c")
def _(spark, d):
    versions = view(spark, d, "alert_versions")
    chunk = time_chunks(versions, "received_at", CHUNK)
    return I.revision_chain(versions, ["source_alert_id"], ["received_at", "seq"], chunk).select("seq", "previous_hash", "action")


@query("w8_consecutive_failures", """SELECT event_id, CAST(CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY source_id, island ORDER BY checked_at, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS BIGINT) AS consecutive_failures,
CASE WHEN NOT ok AND row_number() OVER (PARTITION BY source_id, island ORDER BY checked_at, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END >= 3 THEN 'unhealthy' ELSE 'healthy' END AS health_status
FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY checked_at, event_id) AS island FROM poll_log) p""")
def _(spark, d):
    polls = view(spark, d, "poll_log")
    return Q.consecutive_failures(polls, time_chunks(polls, "checked_at", CHUNK)).select("event_id", "consecutive_failures", "health_status")


@query("w8_source_health", f"""SELECT p.source_id, count(*) FILTER (NOT ok AND (g.last_success_at IS NULL OR checked_at > g.last_success_at)) AS consecutive_failures, {O.ts('max(checked_at)')} AS last_checked_at,
{O.ts('max(g.last_success_at)')} AS last_success_at FROM poll_log p LEFT JOIN (SELECT source_id, max(checked_at) AS last_success_at FROM poll_log WHERE ok GROUP BY source_id) g ON g.source_id = p.source_id GROUP BY p.source_id""")
def _(spark, d):
    return text_times(Q.source_health(view(spark, d, "poll_log")), "last_checked_at", "last_success_at").drop("health_status")


REVISED = f"SELECT source_alert_id AS alert_id, seq, received_at AS created_at, content_hash FROM ({CHAIN}) c WHERE previous_hash <> content_hash"


@query("w9_latest_revision", f"SELECT alert_id, arg_max(seq, created_at) AS seq, arg_max(content_hash, created_at) AS content_hash FROM ({REVISED}) r GROUP BY alert_id")
def _(spark, d):
    versions = view(spark, d, "alert_versions")
    chain = I.revision_chain(versions, ["source_alert_id"], ["received_at", "seq"], time_chunks(versions, "received_at", CHUNK))
    revs = chain.filter("action = 'updated'").selectExpr("source_alert_id AS alert_id", "seq", "received_at AS created_at", "content_hash")
    return I.latest_revision(revs).select("alert_id", "seq", "content_hash")


# ---- upsert -------------------------------------------------------------------------
EXTRA = """CAST(NULL AS STRING) AS official_severity, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS issued_at, CAST(NULL AS TIMESTAMP) AS starts_at, CAST(NULL AS TIMESTAMP) AS expires_at,
received_at AS effective_event_at, 'pending' AS status, 'u' AS source_url, received_at AS created_at, CAST(NULL AS STRING) AS raw_text, CAST(NULL AS STRING) AS validation_errors,
CASE WHEN seq % 5 = 0 THEN 'S' ELSE NULL END AS structured_advisory, 'v1' AS cache_key"""
BATCH = f"SELECT seq, source_id, source_alert_id, title, description, hazard_type, normalized_severity, content_hash, {EXTRA} FROM alert_versions WHERE received_at >= TIMESTAMP '2024-01-04 00:00:00'"
STORED = f"""SELECT CAST(substr(source_alert_id, 2) AS BIGINT) AS id, source_id, source_alert_id, title, description, hazard_type, normalized_severity, content_hash, {EXTRA}
FROM (SELECT *, row_number() OVER (PARTITION BY source_alert_id ORDER BY received_at, seq) AS nth FROM alert_versions WHERE received_at < TIMESTAMP '2024-01-04 00:00:00') v WHERE nth = 1"""


def batch_and_stored(spark, d):
    versions = view(spark, d, "alert_versions")
    batch = spark.sql(BATCH.replace("FROM alert_versions", "FROM {v}"), v=versions)
    early = versions.filter("received_at < TIMESTAMP '2024-01-04 00:00:00'").groupBy("source_alert_id").agg(
        F.min_by(F.struct(*[c for c in versions.columns if c != "source_alert_id"]), F.struct("received_at", "seq")).alias("r")).select("source_alert_id", "r.*")
    stored = spark.sql(f"SELECT CAST(substr(source_alert_id, 2) AS BIGINT) AS id, source_id, source_alert_id, title, description, hazard_type, normalized_severity, content_hash, {EXTRA} FROM {{v}}", v=early)
    return batch, stored


def classified(spark, d):
    batch, stored = batch_and_stored(spark, d)
    return I.classify(batch, stored)


# The check keeps its own copy of the chain rules, written with plain windows.
CLASSIFIED = f"""SELECT *, CASE WHEN prev_hash IS NULL THEN 'created' WHEN prev_hash = content_hash AND prev_sa IS NOT DISTINCT FROM structured_advisory THEN 'ignored' ELSE 'updated' END AS action,
prev_hash IS NOT NULL AND prev_hash <> content_hash AS revised, first_value(CASE WHEN seq < 0 THEN sid ELSE new_id END) OVER (PARTITION BY source_alert_id ORDER BY seq) AS alert_id,
last_value(CASE WHEN prev_hash IS NULL OR prev_hash <> content_hash THEN [description, normalized_severity] END IGNORE NULLS) OVER (PARTITION BY source_alert_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM (
SELECT *, lag(content_hash) OVER w AS prev_hash, lag(structured_advisory) OVER w AS prev_sa FROM (
SELECT seq, source_alert_id, content_hash, structured_advisory, description, normalized_severity, CAST(NULL AS BIGINT) AS sid, CAST('0x' || substr(md5('id' || chr(1) || source_id || chr(1) || source_alert_id), 1, 15) AS BIGINT) AS new_id FROM ({BATCH}) b
UNION ALL SELECT -1, source_alert_id, content_hash, structured_advisory, description, normalized_severity, id, NULL FROM ({STORED}) s) u WINDOW w AS (PARTITION BY source_alert_id ORDER BY seq)) t"""
CHANGED = """'["' || array_to_string(CASE WHEN len(f) = 0 THEN ['locations_or_minor'] ELSE f END, '", "') || '"]'"""


@query("j12_upsert_match", """SELECT seq, stored_id FROM (SELECT b.id AS seq, coalesce(x.id, y.id) AS stored_id FROM alerts b
LEFT JOIN (SELECT source_id, source_alert_id, min(id) AS id FROM alerts WHERE id % 2 = 0 GROUP BY ALL) x ON b.source_alert_id IS NOT NULL AND x.source_id = b.source_id AND x.source_alert_id = b.source_alert_id
LEFT JOIN (SELECT source_id, title, issued_at, min(id) AS id FROM alerts WHERE id % 2 = 0 GROUP BY ALL) y ON b.source_alert_id IS NULL AND y.source_id = b.source_id AND y.title = b.title AND y.issued_at = b.issued_at) z""")
def _(spark, d):
    alerts = view(spark, d, "alerts")
    batch = alerts.withColumnRenamed("id", "seq")
    return I.match_keys(batch, alerts.filter("id % 2 = 0")).select("seq", "stored_id")


@query("i1_classify", f"SELECT seq, action, revised, alert_id FROM ({CLASSIFIED}) c WHERE seq >= 0")
def _(spark, d):
    return classified(spark, d).select("seq", "action", "revised", "alert_id")


@query("i2_changed_fields", f"""SELECT seq, {CHANGED} AS changed_fields FROM (SELECT seq, list_filter([CASE WHEN old[1] IS DISTINCT FROM description THEN 'description' END, CASE WHEN old[2] IS DISTINCT FROM normalized_severity THEN 'severity' END,
CASE WHEN prev_sa IS DISTINCT FROM structured_advisory THEN 'structured_advisory' END], lambda x: x IS NOT NULL) AS f FROM ({CLASSIFIED}) c WHERE seq >= 0 AND revised) q""")
def _(spark, d):
    return classified(spark, d).filter("revised").select("seq", I.text_list(F.col("changed_fields")).alias("changed_fields"))


@query("i3_revisions", f"SELECT alert_id, seq, prev_hash AS previous_content_hash, content_hash AS new_content_hash, CAST(NULL AS BIGINT) AS raw_document_id FROM ({CLASSIFIED}) c WHERE seq >= 0 AND revised")
def _(spark, d):
    return I.revisions(classified(spark, d)).drop("changed_fields")


@query("i4_apply_upsert", f"""SELECT alert_id AS id, source_alert_id, coalesce(arg_max(description, seq) FILTER (prev_hash IS NULL OR revised), max(description) FILTER (seq < 0)) AS description,
arg_max(content_hash, seq) AS content_hash, (array_agg(structured_advisory ORDER BY seq DESC))[1] AS structured_advisory FROM ({CLASSIFIED}) c GROUP BY alert_id, source_alert_id""")
def _(spark, d):
    batch, stored = batch_and_stored(spark, d)
    return I.apply_upsert(stored, batch, I.classify(batch, stored)).select("id", "source_alert_id", "description", "content_hash", "structured_advisory")


@query("i5_replace_children", """SELECT alert_id, loc_id, raw_location FROM alert_locations WHERE alert_id % 3 <> 0
UNION ALL SELECT alert_id, loc_id, 'new ' || raw_location FROM alert_locations WHERE alert_id % 3 = 0 AND evidence_score >= 60""")
def _(spark, d):
    old = view(spark, d, "alert_locations").select("alert_id", "loc_id", "raw_location")
    new = view(spark, d, "alert_locations").filter("evidence_score >= 60").select(
        "alert_id", "loc_id", F.concat(F.lit("new "), F.col("raw_location")).alias("raw_location"))
    touched = view(spark, d, "alerts").filter("id % 3 = 0").select(F.col("id").alias("alert_id"))
    return I.replace_children(old, new, touched)


@query("u5_change_set", f"SELECT seq, action FROM ({CLASSIFIED}) c WHERE seq >= 0 AND action <> 'ignored'")
def _(spark, d):
    return I.change_set(classified(spark, d)).select("seq", "action")


@query("a1_ingest_batch_stats", f"SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'ignored') AS ignored FROM ({CLASSIFIED}) c WHERE seq >= 0")
def _(spark, d):
    return A.ingest_stats(classified(spark, d).withColumn("status", F.lit("pending"))).select("created", "updated", "ignored")
