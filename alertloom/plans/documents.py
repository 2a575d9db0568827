"""Document jobs, checked by render-then-parse: documents are written from the
driver tables' columns, parsed, and compared with those columns in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.operators import bulletins as B
from alertloom.plans import oracle_sql as O
from alertloom.plans.reads import EVENT_AS_OF, text_times
from alertloom.plans.registry import query
from alertloom.session import new_folder, spread, worked_out
from alertloom.sources import feeds as S, gazetteer_files as GF
from alertloom.sources.views import choose, view

# ---- rendered bulletins -------------------------------------------------------------
LEVELS = ["Below Low", "Low", "Medium", "High", "Very High", "Exceptionally High"]


def level(i: int) -> str:
    return choose(f"(doc_id + {i}) % 6", LEVELS)


HEADER = ("'GOVERNMENT OF PAKISTAN MINISTRY OF DEFENCE (DEFENCE DIVISION)' || chr(10) || 'PAKISTAN METEOROLOGICAL DEPARTMENT FLOOD FORECASTING DIVISION' || chr(10) || "
          "'46-JAIL ROAD LAHORE-54000 BULLETIN No: ' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '/26 Dated: ' || CAST(doc_id % 28 + 1 AS STRING) || 'th July-2026' || chr(10) || "
          "'Time: 12:15 hours (PST) www.ffd.example | Email: duty@ffd.example | Duty Officer 24/7Hrs: 0429' || CAST(doc_id AS STRING) || chr(10) || 'All rights reserved. Page 1 of 8'")
PARTS = [
    "'DAILY FLOOD BULLETIN 23-JUL-2026'", "'Rivers at a glance'",
    f"'INDUS ' || {level(0)} || ' (Tarbela & Chashma) KABUL ' || upper({level(1)}) || ' (Nowshera) JHELUM ' || {level(2)}",
    f"'CHENAB ' || {level(3)} || ' (Khanki and Qadirabad) RAVI ' || {level(4)} || ' SUTLEJ ' || {level(5)}",
    "'Flood severity scale and what each level requires'", "'Below Low Low Medium High Very High Exceptionally High'",
    "'I: HYDROLOGICAL SITUATION at 0600 PST AND OUTLOOK'",
    f"'River Chenab at Khanki and Qadirabad is in ' || {level(2)} || ' flood level.'",
    f"'River Chenab at Khanki and Qadirabad is in ' || {level(2)} || ' flood level.'",
    f"CASE WHEN doc_id % 2 = 0 THEN 'River Ravi at Balloki and River Kabul at Warsak are in ' || {level(4)} || ' flood level.' ELSE 'Other rivers flow normally.' END",
    "'River Indus at Tarbela is ' || CASE doc_id % 3 WHEN 0 THEN 'rising.' WHEN 1 THEN 'falling.' ELSE 'steady.' END",
    "CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'WARNING:' || chr(10) || 'Flows in River Chenab are expected to ' || CASE doc_id % 2 WHEN 0 THEN 'decrease' ELSE 'increase' END || ' up to ' || CAST(doc_id % 28 + 1 AS STRING) || 'th July within the next ' || CAST(doc_id % 3 * 12 + 24 AS STRING) || ' hours. High to Medium flows are likely in Jhelum.' END",
    HEADER, "'III: WEATHER FORECAST FOR 24-HOURS'", "'Rain of ' || CAST(doc_id % 90 AS STRING) || ' mm over the upper' || chr(10) || 'catchment.'",
    "'IV: WEATHER OUTLOOK FOR NEXT 48-HOURS'", "'Wet spell ' || CAST(doc_id AS STRING) || ' goes on.'", HEADER,
    "'4. QUANTITATIVE FLOOD FORECAST OF GAUGING STATIONS'",
    "'RIVERS Stations Actual Observations at 0600 PST Max Flood Peaks Season 2026'",
    f"'INDUS Chashma ' || CAST(doc_id % 500 AS STRING) || '.5 302.25 310 F 270 ' || {level(1)} || ' 1038.9 EH (2010) 313.8'",
    "'CHENAB Trimmu 94.7 81.3 100 R 140 Low to Medium 944.3 EH (1928) 94.7'",
    "'SUTLEJ Sulemanki 16.9 6.3 No sig. change Below Low 598.9 EH (1955) 19.1'", "'Spatial: Isolated=20 to 30% of area'",
]
BULLETIN = " || chr(10) || ".join(PARTS)
RENDER = f"SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'Unrelated advisory ' || CAST(doc_id AS STRING) ELSE {BULLETIN} END AS raw_text, 'https://ffd.example/bulletin/' || CAST(doc_id AS STRING) AS source_url FROM documents"
DOCS = "(SELECT doc_id FROM documents WHERE doc_id % 10 <> 9) d"
CHENAB_TREND = "CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN 'Decreasing' ELSE 'Increasing' END"
INDUS_TREND = "CASE doc_id % 3 WHEN 0 THEN 'Increasing' WHEN 1 THEN 'Decreasing' END"


def rendered(spark, d):
    return spark.sql(RENDER.replace("FROM documents", "FROM {documents}"), documents=view(spark, d, "documents"))


def structured(spark, d, *facts):
    return B.structure_bulletins(rendered(spark, d), facts=facts or None)


def sql_row(river, station, lvl, forecast, trend, inflow, outflow, where="true"):
    q = lambda v: "NULL" if v is None else v
    return (f"SELECT doc_id, '{river}' AS river, {q(station)} AS station, {q(lvl)} AS level, {q(forecast)} AS forecast_level, {q(trend)} AS trend, "
            f"CAST({q(inflow)} AS DOUBLE) AS current_inflow, CAST({q(outflow)} AS DOUBLE) AS current_outflow FROM {DOCS} WHERE {where}")


# Without a warning section the hydrology text runs on to the end of the
# document, where the sentence naming Chashma holds "No sig. change".
CONDITION_ROWS = " UNION ALL ".join([
    sql_row("Indus", "'Tarbela'", level(0), None, INDUS_TREND, None, None),
    sql_row("Indus", "'Chashma'", level(0), level(1), f"coalesce({INDUS_TREND}, CASE WHEN doc_id % 5 = 4 THEN 'No significant change' ELSE 'Decreasing' END)", "doc_id % 500 + 0.5", "302.25"),
    sql_row("Kabul", "'Nowshera'", level(1), None, None, None, None),
    sql_row("Jhelum", None, level(2), None, None, None, None),
    sql_row("Chenab", "'Khanki'", level(2), None, CHENAB_TREND, None, None),
    sql_row("Chenab", "'Qadirabad'", level(2), None, CHENAB_TREND, None, None),
    sql_row("Ravi", None, level(4), None, None, None, None),
    sql_row("Sutlej", None, level(5), None, None, None, None),
    sql_row("Ravi", "'Balloki'", level(4), None, None, None, None, "doc_id % 2 = 0"),
    sql_row("Kabul", "'Warsak'", level(4), None, None, None, None, "doc_id % 2 = 0"),
    sql_row("Chenab", "'Trimmu'", None, "'Low to Medium'", "'Increasing'", "94.7", "81.3"),
    sql_row("Sutlej", "'Sulemanki'", None, "'Below Low'", "'No significant change'", "16.9", "6.3"),
])


@query("b1_is_bulletin", "SELECT doc_id, doc_id % 10 <> 9 AS is_bulletin FROM documents")
def _(spark, d):
    return rendered(spark, d).select("doc_id", B.is_bulletin(B.one_line(F.col("raw_text"))).alias("is_bulletin"))


@query("b2_section", f"SELECT doc_id, 'Rain of ' || CAST(doc_id % 90 AS VARCHAR) || ' mm over the upper catchment.' AS next_24_hours, 'Wet spell ' || CAST(doc_id AS VARCHAR) || ' goes on.' AS next_48_hours FROM {DOCS}")
def _(spark, d):
    rows = B.sections(rendered(spark, d), wanted=("__f24", "__f48")).filter(B.is_bulletin(F.col("__t")))
    return rows.select("doc_id", F.col("__f24").alias("next_24_hours"), F.col("__f48").alias("next_48_hours"))


@query("b3_bulletin_meta", f"""SELECT doc_id, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '/26' AS number, CAST(doc_id % 28 + 1 AS VARCHAR) || 'th July-2026' AS issue_date, '12:15 hours (PST)' AS issue_time, '1 of 8' AS page,
'Defence Division' AS division, '46-JAIL ROAD LAHORE-54000' AS office_address, 'duty@ffd.example' AS email, '0429' || CAST(doc_id AS VARCHAR) AS telephone, 10 AS n_keys FROM {DOCS}""")
def _(spark, d):
    t = B.one_line(F.col("raw_text"))
    m = F.col("m")
    names = ["number", "issue_date", "issue_time", "page", "division", "office_address", "email", "telephone"]
    rows = rendered(spark, d).filter(B.is_bulletin(t)).select("doc_id", B.metadata(t).alias("m"))
    return rows.select("doc_id", *[m[n].alias(n) for n in names], F.size(m).alias("n_keys"))


GLANCE = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS river, {s} AS station, {level(i)} AS level FROM {DOCS}" for r, s, i in [
    ("Indus", "'Tarbela'", 0), ("Indus", "'Chashma'", 0), ("Kabul", "'Nowshera'", 1), ("Jhelum", "NULL", 2), ("Chenab", "'Khanki'", 3),
    ("Chenab", "'Qadirabad'", 3), ("Ravi", "NULL", 4), ("Sutlej", "NULL", 5)])


@query("b4_glance_rows", GLANCE)
def _(spark, d):
    rows = B.sections(rendered(spark, d), wanted=()).select("doc_id", F.explode_outer(B.glance_rows(F.col("__parts"))).alias("r")).filter("r IS NOT NULL")
    return rows.select("doc_id", "r.river", "r.station", "r.level")


@query("b5_hydrology_rows", " UNION ALL ".join(
    f"SELECT doc_id, '{r}' AS river, '{s}' AS station, {level(i)} AS level FROM {DOCS} WHERE {w}" for r, s, i, w in [
        ("Chenab", "Khanki", 2, "true"), ("Chenab", "Qadirabad", 2, "true"), ("Ravi", "Balloki", 4, "doc_id % 2 = 0"), ("Kabul", "Warsak", 4, "doc_id % 2 = 0")]))
def _(spark, d):
    parts = B.sections(rendered(spark, d)).filter(B.is_bulletin(F.col("__t")))
    context = F.concat_ws(" ", "__hydro", "__warn")
    rows = parts.select("doc_id", F.explode_outer(F.array_distinct(B.hydrology_rows(context))).alias("r")).filter("r IS NOT NULL")
    return rows.select("doc_id", "r.river", "r.station", "r.level")


@query("b6_forecast_rows", f"SELECT doc_id, 'Indus' AS river, 'Chashma' AS station, {level(1)} AS forecast_level, 'Decreasing' AS trend, doc_id % 500 + 0.5::DOUBLE AS current_inflow, 302.25::DOUBLE AS current_outflow FROM {DOCS} UNION ALL SELECT doc_id, 'Chenab', 'Trimmu', 'Low to Medium', 'Increasing', 94.7, 81.3 FROM {DOCS} UNION ALL SELECT doc_id, 'Sutlej', 'Sulemanki', 'Below Low', 'No significant change', 16.9, 6.3 FROM {DOCS}")
def _(spark, d):
    rows = B.sections(rendered(spark, d), wanted=()).select("doc_id", F.explode_outer(B.forecast_rows(F.col("__parts"))).alias("r")).filter("r IS NOT NULL")
    return rows.select("doc_id", "r.river", "r.station", "r.forecast_level", "r.trend", "r.current_inflow", "r.current_outflow")


# Without a warning section the hydrology text runs on to the end of the document.
RUN_ON = f"""'|III: WEATHER FORECAST FOR 24-HOURS Rain of ' || (doc_id % 90) || ' mm over the upper catchment.|IV: WEATHER OUTLOOK FOR NEXT 48-HOURS Wet spell ' || doc_id || ' goes on. 4.|QUANTITATIVE FLOOD FORECAST OF GAUGING STATIONS RIVERS Stations Actual Observations at 0600 PST Max Flood Peaks Season 2026 INDUS Chashma '
|| (doc_id % 500) || '.5 302.25 310 F 270 ' || {level(1)} || ' 1038.9 EH (2010) 313.8 CHENAB Trimmu 94.7 81.3 100 R 140 Low to Medium 944.3 EH (1928) 94.7 SUTLEJ Sulemanki 16.9 6.3 No sig. change Below Low 598.9 EH (1955) 19.1 Spatial: Isolated=20 to 30% of area'"""


@query("b7_sentences", f"""SELECT doc_id, 'River Chenab at Khanki and Qadirabad is in ' || {level(2)} || ' flood level.|' || CASE WHEN doc_id % 2 = 0 THEN 'River Ravi at Balloki and River Kabul at Warsak are in ' || {level(4)} || ' flood level.' ELSE 'Other rivers flow normally.' END
|| '|River Indus at Tarbela is ' || CASE doc_id % 3 WHEN 0 THEN 'rising.' WHEN 1 THEN 'falling.' ELSE 'steady.' END || CASE WHEN doc_id % 5 = 4 THEN {RUN_ON} ELSE '' END AS summary FROM {DOCS}""")
def _(spark, d):
    parts = B.sections(rendered(spark, d)).filter(B.is_bulletin(F.col("__t")))
    return parts.select("doc_id", F.array_join(B.sentences(F.col("__hydro")), "|").alias("summary"))


@query("b8_trend", f"SELECT doc_id, river, station, trend FROM ({CONDITION_ROWS}) c")
def _(spark, d):
    rows = B.river_conditions(structured(spark, d, "river_conditions").filter("advisory IS NOT NULL"), "doc_id")
    return rows.select("doc_id", "river", "station", "trend")


@query("b9_river_conditions", CONDITION_ROWS)
def _(spark, d):
    return B.river_conditions(structured(spark, d, "river_conditions").filter("advisory IS NOT NULL"), "doc_id").drop("pos")


@query("u4_merge_river_rows", f"SELECT doc_id, count(*) AS n_rows, count(level) AS with_level, count(forecast_level) AS with_forecast, count(DISTINCT river) AS rivers FROM ({CONDITION_ROWS}) c GROUP BY doc_id")
def _(spark, d):
    rows = B.river_conditions(structured(spark, d, "river_conditions").filter("advisory IS NOT NULL"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count("level").alias("with_level"),
                                      F.count("forecast_level").alias("with_forecast"), F.countDistinct("river").alias("rivers"))


RANK = "CASE level WHEN 'Below Low' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Very High' THEN 4 ELSE 5 END"


@query("b10_structure_bulletins", f"""SELECT d.doc_id, '{K.BULLETIN_PARSER}' AS parser_name, 'structured' AS validation_status, CASE WHEN d.doc_id % 5 = 4 THEN 'warning' ELSE '' END AS missing, 'Daily Flood Bulletin' AS title,
m.top AS highest_reported_level FROM {DOCS} JOIN (SELECT doc_id, arg_max(level, {RANK}) AS top FROM ({CONDITION_ROWS}) c WHERE level IS NOT NULL GROUP BY 1) m ON m.doc_id = d.doc_id""")
def _(spark, d):
    a = structured(spark, d).filter("advisory IS NOT NULL")
    return a.select("doc_id", "advisory.parser_name", "advisory.validation_status", F.array_join("advisory.missing_sections", ",").alias("missing"),
                    "advisory.title", "advisory.highest_reported_level")


@query("b11_canonical_level", f"SELECT doc_id, {level(0)} || ' to ' || {level(3)} AS level FROM documents")
def _(spark, d):
    shouted = F.expr(f"upper({level(0)}) || '  TO ' || lower({level(3)})")
    return view(spark, d, "documents").select("doc_id", B.canonical_level(shouted).alias("level"))


@query("a15_warning_facts", f"""SELECT doc_id, 'up to ' || CAST(doc_id % 28 + 1 AS VARCHAR) || 'th July|within the next ' || CAST(doc_id % 3 * 12 + 24 AS VARCHAR) || ' hours' AS timing, 'Jhelum|Chenab' AS rivers, 'High to Medium flows' AS ranges FROM {DOCS} WHERE doc_id % 5 <> 4""")
def _(spark, d):
    w = "w"
    parts = worked_out(B.sections(rendered(spark, d), wanted=("__warn",)).filter("__warn IS NOT NULL"), w=B.warning_facts(F.col("__warn")))
    return parts.select(
        "doc_id", F.array_join(f"{w}.expected_timing", "|").alias("timing"), F.array_join(f"{w}.rivers", "|").alias("rivers"),
        F.array_join(f"{w}.expected_flood_ranges", "|").alias("ranges"))


TOP_LEVEL = f"SELECT doc_id, arg_max(level, {RANK}) AS top FROM ({CONDITION_ROWS}) c WHERE level IS NOT NULL GROUP BY 1"
SEVERITY = "CASE WHEN top IN ('Very High', 'Exceptionally High') THEN 'critical' WHEN top = 'High' THEN 'high' WHEN top = 'Medium' THEN 'medium' ELSE 'low' END"


@query("i7_backfill_bulletins", f"SELECT doc_id AS id, {SEVERITY} AS expected_severity FROM ({TOP_LEVEL}) t WHERE doc_id % 3 <> 0 OR {SEVERITY} <> 'critical'")
def _(spark, d):
    docs = structured(spark, d, "highest_reported_level").withColumnRenamed("doc_id", "id")
    stored = rendered(spark, d).withColumnRenamed("doc_id", "id").select("id", F.when(F.col("id") % 3 == 0, K.BULLETIN_PARSER).alias("parser_name"), F.lit("critical").alias("normalized_severity"))
    return B.stale_bulletins(stored, docs.select("id", "advisory")).select("id", "expected_severity")


# ---- scraped pages -----------------------------------------------------------------
S6_IN = "SELECT doc_id, 'https://ffd.example/b/' || CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS url, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS retrieved_at, 'Flood   fore-' || chr(10) || 'cast ' || CAST(doc_id AS STRING) || chr(13) || chr(10) || '  BULLETIN  ' || chr(10) || chr(10) || chr(10) || chr(10) || repeat('x', CAST(doc_id % 2500 AS INT)) || '  ' AS text FROM documents"


@query("s6_clean_bulletin_text", """SELECT doc_id, title, 'FFD-' || replace(title, ' ', '') || '-2024-01-01' AS source_alert_id, body AS raw_text, substr(body, 1, 2000) || CASE WHEN length(body) > 2000 THEN '...' ELSE '' END AS description FROM (
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'FFD River Discharge & Weather Bulletin A' WHEN 1 THEN 'FFD Rainfall & Flood Forecast Bulletin B' ELSE 'Flood Forecasting Division Bulletin' END AS title,
rtrim('Flood forecast ' || CAST(doc_id AS VARCHAR) || chr(10) || 'BULLETIN' || chr(10) || chr(10) || repeat('x', CAST(doc_id % 2500 AS INT)), chr(10)) AS body FROM documents) z""")
def _(spark, d):
    docs = spark.sql(S6_IN.replace("FROM documents", "FROM {t}"), t=view(spark, d, "documents"))
    return S.clean_bulletin_text(docs).select("doc_id", "title", "source_alert_id", "raw_text", "description")


@query("s7_bulletin_to_alerts", f"SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 9 THEN 'unknown' ELSE {SEVERITY} END AS normalized_severity, 'active' AS status, 'Pakistan' AS raw_location FROM documents d LEFT JOIN ({TOP_LEVEL}) t ON t.doc_id = d.doc_id")
def _(spark, d):
    docs = rendered(spark, d).selectExpr("doc_id", "source_url AS url", "raw_text AS text", "TIMESTAMP '2024-01-01 00:00:00' AS retrieved_at")
    return S.run_feed("FFDBulletinScraper", docs).select("doc_id", "normalized_severity", "status", "raw_location")


S8_WORDS = ["Extreme heat ahead", "monsoon rain and flood", "high seismic activity", "red alert: temperature", "severe flood; earthquake", "calm day", "Monsoon spell"]


def says(*words):
    return "(" + " OR ".join(f"contains(up, '{w}')" for w in words) + ")"


S8_HAZARD = f"CASE WHEN {says('HEAT', 'TEMPERATURE')} THEN 'heatwave' WHEN {says('EARTHQUAKE', 'SEISMIC')} THEN 'earthquake' WHEN {says('FLOOD')} THEN 'flood' WHEN {says('RAIN', 'MONSOON')} THEN 'weather' ELSE 'other' END"


@query("s8_advisory_text_to_alerts", f"""SELECT doc_id, {S8_HAZARD} AS hazard_type, CASE WHEN {says('EXTREME', 'RED ALERT')} THEN 'extreme' WHEN {says('HIGH', 'SEVERE')} THEN 'high' ELSE 'medium' END AS normalized_severity,
'NDMA ' || upper(substr({S8_HAZARD}, 1, 1)) || substr({S8_HAZARD}, 2) || ' Advisory' AS title, 'NDMA-adv' || CAST(doc_id AS VARCHAR) AS source_alert_id FROM (SELECT doc_id, upper({choose('doc_id % 7', S8_WORDS)} || ' ' || text) AS up FROM documents) z""")
def _(spark, d):
    docs = view(spark, d, "documents").select(
        "doc_id", F.expr(f"{choose('doc_id % 7', S8_WORDS)} || chr(10) || text").alias("text"), F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"),
        F.concat(F.lit("https://n.example/storage/adv"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"))
    return S.run_feed("NDMAScraper", docs).select("doc_id", "hazard_type", "normalized_severity", "title", "source_alert_id")


CAP = """SELECT event_id, user_id AS source_id, 'https://cap.example/' || CAST(event_id AS STRING) AS url, CASE WHEN event_id % 11 = 0 THEN '<html><p>gone</p></html>' WHEN event_id % 13 = 0 THEN '<alert><identifier>E</identifier></alert>' ELSE
'<?xml version="1.0"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>CAP-' || CAST(event_id AS STRING) || '</identifier>' || CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 17 = 0 THEN '<sent>yesterday</sent>' ELSE '<sent>' || replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || '+05:00</sent>' END ||
'<info>' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '<headline>Rain &amp; wind ' || CAST(event_id AS STRING) || '</headline>' END || '<description>Story ' || event_type || '</description>' || CASE WHEN event_id % 2 = 0 THEN '<instruction>Stay in</instruction>' ELSE '' END ||
'<severity>Severe</severity><area><areaDesc>Zone ' || CAST(user_id AS STRING) || '</areaDesc></area><area><areaDesc>Other</areaDesc></area></info><info><headline>Second</headline></info></alert>' END AS content FROM events"""


def cap_docs(spark, d):
    return spark.sql(CAP.replace("FROM events", "FROM {t}"), t=spread(view(spark, d, "events")))


CAP_OK = "event_id % 11 <> 0 AND event_id % 13 <> 0"
CAP_TITLE = "CASE WHEN event_id % 5 = 0 THEN 'PMD Weather Alert' ELSE 'Rain & wind ' || CAST(event_id AS VARCHAR) END"


@query("s1_cap_scan", f"""SELECT event_id, 'CAP-' || CAST(event_id AS VARCHAR) AS source_alert_id, {CAP_TITLE} AS title, 'Story ' || event_type AS description, CASE WHEN event_id % 2 = 0 THEN 'Stay in' ELSE '' END AS instructions, 'Weather' AS hazard_type,
'Zone ' || CAST(user_id AS VARCHAR) AS raw_location, {CAP_TITLE} || chr(10) || chr(10) || 'Story ' || event_type || chr(10) || chr(10) || 'Instructions: ' || CASE WHEN event_id % 2 = 0 THEN 'Stay in' ELSE '' END AS raw_text FROM events WHERE {CAP_OK}""")
def _(spark, d):
    return S.read_cap(cap_docs(spark, d)).select("event_id", "source_alert_id", "title", "description", "instructions", "hazard_type", "raw_location", "raw_text")


@query("s2_cap_to_alerts", f"""SELECT event_id, {O.ts(f"CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '{EVENT_AS_OF}' ELSE date_trunc('second', ts) - INTERVAL 5 HOUR END")} AS issued_at, 'Story ' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'Instructions: Stay in' ELSE '' END AS description, 'pending' AS status
FROM events WHERE {CAP_OK} AND (event_id % 7 = 0 OR event_id % 17 <> 0)""")
def _(spark, d):
    good, _bad = S.cap_to_alerts(S.read_cap(cap_docs(spark, d)), EVENT_AS_OF)
    return text_times(good, "issued_at").select("event_id", "issued_at", "description", "status")


@query("s2_rejected", f"SELECT event_id FROM events WHERE {CAP_OK} AND event_id % 7 <> 0 AND event_id % 17 = 0")
def _(spark, d):
    return S.cap_to_alerts(S.read_cap(cap_docs(spark, d)), EVENT_AS_OF)[1].select("event_id")


MAG = "CAST(CAST(floor(value / 6) AS BIGINT) AS DOUBLE) / 10"
QUAKE = f"""SELECT event_id AS doc_id, 'https://quake.example' AS url, '<html><!-- <table><tr><td>x</td></tr></table> --><table class="t"><tr><th>Date</th></tr><tr><td>' || CASE WHEN event_id % 19 = 0 THEN 'soon' ELSE date_format(ts, 'dd/MM/yyyy') END || '</td><td> ' || date_format(ts, 'HH:mm:ss') ||
'</td><td>' || CAST(20 + event_id % 25 AS STRING) || '.5 N</td><td>' || CAST(55 + event_id % 40 AS STRING) || '.25 W</td><td><b>' || CAST({MAG} AS STRING) || '</b></td><td>10</td><td>Hindu Kush &amp; ' || event_type || '</td></tr><tr><td>short</td></tr></table><table><tr><td>a</td></tr></table></html>' AS content FROM events"""
QUAKE_OK = f"event_id % 19 <> 0 AND {MAG} >= 2.9"


def quake_docs(spark, d):
    return spark.sql(QUAKE.replace("FROM events", "FROM {t}"), t=spread(view(spark, d, "events")))


@query("s3_read_quake_table", f"SELECT event_id AS doc_id, {O.ts('ts')} AS issued_at, 20.5::DOUBLE + event_id % 25 AS latitude, 55.25::DOUBLE + event_id % 40 AS longitude, {MAG} AS magnitude, '10' AS depth, 'Hindu Kush & ' || event_type AS region FROM events WHERE {QUAKE_OK}")
def _(spark, d):
    return text_times(S.read_quake_table(quake_docs(spark, d)), "issued_at").select("doc_id", "issued_at", "latitude", "longitude", "magnitude", "depth", "region")


@query("s4_quake_to_alerts", f"""SELECT event_id AS doc_id, 'EQ-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || (20 + event_id % 25) || '.5N-' || (55 + event_id % 40) || '.25W' AS source_alert_id, 'M' || CAST({MAG} AS VARCHAR) || ' Earthquake - Hindu Kush & ' || event_type AS title,
CASE WHEN {MAG} >= 7 THEN 'critical' WHEN {MAG} >= 5 THEN 'high' WHEN {MAG} >= 4 THEN 'medium' ELSE 'low' END AS normalized_severity,
CASE WHEN (20.5 + event_id % 25 <= 42 AND 55.25 + event_id % 40 <= 85 AND {MAG} >= 4) OR {MAG} >= 5 THEN 'active' ELSE 'pending' END AS status FROM events WHERE {QUAKE_OK}""")
def _(spark, d):
    return S.run_feed("PMDEarthquakeScraper", quake_docs(spark, d)).select("doc_id", "source_alert_id", "title", "normalized_severity", "status")


LINK_PAGES = r"""SELECT page_id, regexp_replace(html, 'href="/(\\w+)"', 'href="//files/$1.pdf"') AS html FROM pages"""


@query("s5_extract_links", r"""SELECT page_id, link_no, link FROM (SELECT page_id, unnest(l) AS link, unnest(range(0, len(l))) AS link_no FROM (SELECT page_id, list_transform(list_distinct_ordered, lambda u: 'https://base.example/files/' || u || '.pdf') AS l FROM (
SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a [^>]*?href="/(\w+)"', 1) AS a FROM pages) p) q) r) s""")
def _(spark, d):
    pages = spark.sql(LINK_PAGES.replace("FROM pages", "FROM {t}"), t=view(spark, d, "pages"))
    return S.extract_links(pages, "https://base.example", [".pdf", "/download"])


@query("s9_seed_sources", "SELECT CAST(id AS BIGINT) AS id, name FROM source_status UNION ALL SELECT id, name FROM sources WHERE name NOT IN (SELECT name FROM source_status)")
def _(spark, d):
    existing = view(spark, d, "source_status").select("id", "name")
    return S.seed_sources(S.configured_sources(spark), existing)


# ---- gazetteer files ------------------------------------------------------------------
TSV = """SELECT concat_ws(chr(9), CAST(numeric_id AS STRING), CASE entity_type WHEN 'DISTRICT' THEN canonical_name || ' District' ELSE canonical_name END, canonical_name || ' asc', 'Alpha ' || CAST(numeric_id AS STRING) || ',,Beta',
coalesce(CAST(latitude AS STRING), ''), coalesce(CAST(longitude AS STRING), ''), CASE WHEN entity_type IN ('PROVINCE', 'DISTRICT', 'TEHSIL') THEN 'A' ELSE 'P' END,
CASE entity_type WHEN 'PROVINCE' THEN 'ADM1' WHEN 'DISTRICT' THEN 'ADM2' WHEN 'TEHSIL' THEN 'ADM3' WHEN 'CITY' THEN 'PPLA' ELSE 'PPL' END, CASE WHEN numeric_id % 37 = 0 THEN 'IN' ELSE 'PK' END, '', 'c1', CAST(coalesce(district_id, 0) AS STRING), '', '',
CAST(CASE entity_type WHEN 'TOWN' THEN 20000 ELSE 0 END AS STRING), '', '', 'Asia/Karachi', '2024-01-01') AS value FROM gazetteer"""


def geonames(spark, d):
    folder = new_folder(spark, "geonames-tsv")
    spark.sql(TSV.replace("FROM gazetteer", "FROM {t}"), t=view(spark, d, "gazetteer")).write.text(folder)
    return GF.read_geonames(spark, folder)


@query("s10_read_geonames", """SELECT 'geonames_' || CAST(numeric_id AS VARCHAR) AS id, canonical_name, entity_type, CASE WHEN latitude BETWEEN 22 AND 38.8 AND longitude BETWEEN 60 AND 78.8 THEN latitude END AS latitude,
CASE entity_type WHEN 'DISTRICT' THEN canonical_name || ' District|' ELSE '' END || canonical_name || ' asc|Alpha ' || CAST(numeric_id AS VARCHAR) || '|Beta' AS aliases, CASE WHEN latitude IS NOT NULL AND NOT (latitude BETWEEN 22 AND 38.8 AND longitude BETWEEN 60 AND 78.8) THEN 'coordinate failed the plausibility check' END AS review_notes
FROM gazetteer WHERE numeric_id % 37 <> 0""")
def _(spark, d):
    return geonames(spark, d).select("id", "canonical_name", "entity_type", "latitude", F.array_join("aliases", "|").alias("aliases"), "review_notes")


RECORDS = "numeric_id bigint, location_id string, canonical_name string, entity_type string, province_id bigint, district_id bigint, latitude double, longitude double"


@query("s11_read_gazetteer_records", "SELECT numeric_id, location_id, canonical_name, entity_type, province_id FROM gazetteer")
def _(spark, d):
    folder = new_folder(spark, "gazetteer")
    GF.write_gazetteer(view(spark, d, "gazetteer"), folder)
    return GF.read_gazetteer_records(spark, folder, RECORDS).select("numeric_id", "location_id", "canonical_name", "entity_type", "province_id")


@query("s12_write_gazetteer", "SELECT CASE WHEN entity_type = 'VILLAGE' THEN 'villages_' || coalesce(CAST(province_id AS VARCHAR), 'unresolved') ELSE 'administrative_places_features' END AS \"group\", count(*) AS record_count FROM gazetteer GROUP BY 1")
def _(spark, d):
    return GF.write_gazetteer(view(spark, d, "gazetteer"), new_folder(spark, "gazetteer"))


READ_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROW_DIGEST = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
              "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "labels": "doc_id"}


@query("s13_read_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n, CAST(sum({ROW_DIGEST.get(t, '0')}) AS BIGINT) AS keys FROM {t}" for t in READ_TABLES))
def _(spark, d):
    tables = S.read_tables(spark, d, READ_TABLES)
    counts = [
        tables[t].agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(ROW_DIGEST.get(t, "0"))).cast("long").alias("keys")).select(F.lit(t).alias("name"), "n", "keys")
        for t in READ_TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("y1_registered_feed", "SELECT doc_id, upper(source) AS title FROM documents")
def _(spark, d):
    S.register_feed("ExampleFeed", lambda docs: docs, lambda items: items.select("doc_id", F.upper("source").alias("title")))
    return S.run_feed("ExampleFeed", view(spark, d, "documents"))


@query("y2_fold_unicode", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")
def _(spark, d):
    from alertloom.functions import text
    return view(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))
