"""Hand-made cases and brute-force comparisons."""

import datetime as dt
import ipaddress
import math
import random
import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from alertloom import constants as K, session
from alertloom.functions import geo, ip, text, timeops
from alertloom.operators import bulletins as B, chunked, gazetteer as G, identity as I, ingest as ING, joins as J, mentions as M, quality as Q, reports, resolve as R, topk as T
from alertloom.sources import feeds
from alertloom.streaming import jobs as ST


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- scalar rules -----------------------------------------------------------------
@pytest.mark.parametrize("raw,want", [("District Kasur", "kasur"), ("Kasur District", "kasur"), ("  Dera-Ghazi Khan ", "dera ghazi khan"),
                                      ("D.G. Khan", "dera ghazi khan"), ("Straße / ＡＢ", "strasse ab")])
def test_location_name(spark, raw, want):
    assert one(spark, text.location_name(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Flash flood in hills", "flood"), ("tropical storm", "thunderstorm"), ("heavy_rain", "unknown"), ("Heavy rain", "heavy_rain")])
def test_hazard_order(spark, raw, want):
    assert one(spark, text.hazard(F.lit(raw))) == want


@pytest.mark.parametrize("lat,lng,want", [("33.7", "73.1", True), ("24.8", "67.0", True), ("0", "0", False), ("51.5", "-0.1", False), (None, None, False), ("abc", "70", False)])
def test_country_box(spark, lat, lng, want):
    assert one(spark, geo.valid_country(F.lit(lat).cast("string"), F.lit(lng).cast("string"))) is want


def test_haversine(spark):
    km = one(spark, geo.haversine_km(F.lit(31.5204), F.lit(74.3587), F.lit(24.8607), F.lit(67.0011)))
    assert 1010 < km < 1040
    assert one(spark, geo.haversine_km(F.lit(31.0), F.lit(74.0), F.lit(31.0), F.lit(74.0))) == 0


def test_window_label(spark):
    start, end = timeops.window_bounds("2026-08-02 11:00:00")
    label = one(spark, timeops.window_label(start, timeops.as_of_column("2026-08-02 11:00:00")))
    assert label == "26 Jul 2026, 04:00 PM to 2 Aug 2026, 04:00 PM PKT"


def test_file_name(spark):
    name = one(spark, text.report_filename(F.lit("2026-07-21 14:30:00").cast("timestamp"), F.lit("PMD Weather!"), F.lit("heavy_rain"), F.lit("Lahore & Kasur")))
    assert name == "2026-07-21_19-30-00_PMD_WEATHE_HEAVY_RAIN_LAHORE_KASUR.txt"


def test_wrap_against_textwrap(spark):
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.wrap(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r.w == textwrap.fill(r.t, 78)


def test_public_addresses(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(32) for _ in range(3000)]
    for block in K.NON_GLOBAL_BLOCKS + K.GLOBAL_EXCEPTIONS:
        n = ipaddress.ip_network(block)
        values += [max(int(n.network_address) - 1, 0), int(n.network_address), int(n.broadcast_address), min(int(n.broadcast_address) + 1, 2**32 - 1)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", ip.is_public(F.col("v")).alias("p")).collect()
    for r in rows:
        assert r.p == ipaddress.ip_address(r.v).is_global, ipaddress.ip_address(r.v)


def test_client_ip_rules(spark):
    def run(peer, cf=None, xff=None, real=None, trust=True, local=None):
        s = lambda v: F.lit(v).cast("string")
        r = one(spark, ip.client_ip(s(peer), s(cf), s(xff), s(real), ["10.0.0.0/8"], trust, local))
        return (str(ipaddress.ip_address(r.address)) if r.address is not None else None, r.source, r.invalid_input)
    assert run("10.0.0.1", cf="8.8.8.8") == ("8.8.8.8", "cf_connecting_ip", False)
    assert run("10.0.0.1", xff="1.1.1.1, 9.9.9.9, 10.1.1.1") == ("9.9.9.9", "x_forwarded_for", False)
    assert run("10.0.0.1", xff="1.1.1.1, junk") == ("10.0.0.1", "request_client", True)
    assert run("10.0.0.1", real="::ffff:9.8.7.6") == ("9.8.7.6", "x_real_ip", False)
    assert run("8.8.4.4", cf="1.1.1.1") == ("8.8.4.4", "request_client", False)
    assert run("127.0.0.1", local="8.8.8.8") == ("8.8.8.8", "local_development", False)
    assert run(None) == (None, "unavailable", True)


# ---- chunked helpers ----------------------------------------------------------------
def test_chunked_matches_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", i, rng.choice([None, 1, 2, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    out = chunked.carry_forward(df, ["k"], ["seq"], F.floor(F.col("seq") / 37), {"prev": F.col("v")})
    out = chunked.number_rows(out, ["k"], ["seq"], F.floor(F.col("seq") / 37), "n").orderBy("seq").collect()
    last, count = {}, {}
    for r in out:
        assert r.prev == last.get(r.k)
        count[r.k] = count.get(r.k, 0) + 1
        assert r.n == count[r.k]
        if r.v is not None:
            last[r.k] = r.v


def test_radius_join_matches_brute_force(spark):
    rng = random.Random(2)
    spot = lambda: (rng.uniform(-89.9, 89.9), rng.uniform(-180, 180))
    viewers = [(i, *spot()) for i in range(120)] + [(900, 0.0, 179.99), (901, 89.9, 10.0), (902, -89.8, 0.0)]
    points = [(i, *spot()) for i in range(300)] + [(900, 0.1, -179.99), (901, 89.9, -170.0), (902, -89.7, 180.0)]
    v = spark.createDataFrame(viewers, "viewer_id int, lat double, lng double")
    p = spark.createDataFrame(points, "pid int, latitude double, longitude double")
    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * K.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))
    for radius in (60.0, 900.0):
        got = {(r.viewer_id, r.pid) for r in J.within_radius(v, p, radius).collect()}
        want = {(i, j) for i, a, b in viewers for j, c, d in points if km(a, b, c, d) <= radius}
        assert got == want


# ---- upsert -------------------------------------------------------------------------
ALERT = ("seq long, source_id int, source_alert_id string, title string, issued_at timestamp, description string, normalized_severity string, "
         "expires_at timestamp, status string, content_hash string, cache_key string, structured_advisory string")
T0 = dt.datetime(2024, 1, 1)


def version(seq, sid, description, severity, h, title="t", status="pending"):
    return (seq, 1, sid, title, T0, description, severity, None, status, h, "v1", None)


def empty(spark):
    return spark.createDataFrame([], ALERT.replace("seq long", "id long"))


def test_upsert_created_ignored_updated(spark):
    batch = spark.createDataFrame([
        version(0, "a", "x", "medium", "h1"), version(1, "a", "x!", "medium", "h1"), version(2, "a", "x!", "high", "h2"),
        version(3, "a", "x", "medium", "h1"), version(4, None, "y", "low", "h5", "other"), version(5, None, "y", "low", "h5", "other")], ALERT)
    got = {r.seq: r for r in I.classify(batch, empty(spark), chunk_rows=2).collect()}
    assert [got[i].action for i in range(6)] == ["created", "ignored", "updated", "updated", "created", "ignored"]
    assert got[2].changed_fields == ["description", "severity"] and got[3].changed_fields == ["description", "severity"]
    assert len({got[i].alert_id for i in range(4)}) == 1 and got[4].alert_id == got[5].alert_id != got[0].alert_id
    snap = I.apply_upsert(empty(spark), batch, I.classify(batch, empty(spark))).collect()
    assert sorted((r.description, r.normalized_severity) for r in snap) == [("x", "medium"), ("y", "low")]
    again = I.classify(batch.filter("seq IN (3, 5)"), I.apply_upsert(empty(spark), batch, I.classify(batch, empty(spark))))
    assert [r.action for r in again.collect()] == ["ignored", "ignored"]


def test_row_without_id_matches_stored_alert_with_id(spark):
    stored = spark.createDataFrame([(7, 1, "a", "t", T0, "d", "low", None, "pending", "h1", "v1", None)], ALERT.replace("seq long", "id long"))
    batch = spark.createDataFrame([version(0, None, "d2", "low", "h2"), version(1, "zz", "d", "low", "h3")], ALERT)
    got = {r.seq: (r.action, r.alert_id) for r in I.classify(batch, stored).collect()}
    assert got[0] == ("updated", 7) and got[1][0] == "created" and got[1][1] > 7


def test_streamed_upsert_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [version(i, f"k{rng.randint(0, 4)}", f"d{rng.randint(0, 2)}", "low", f"h{rng.randint(0, 3)}") for i in range(80)]
    df = spark.createDataFrame(rows, ALERT)
    for n in range(4):
        df.filter(f"seq >= {n * 20} AND seq < {n * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = {r.seq: (r.action, r.alert_id) for r in I.classify(df, empty(spark)).collect()}
    stream = ST.stream_documents(spark, str(tmp_path / "in"), df.schema, max_files=1)
    job = ST.stream_upsert(stream, empty(spark))
    assert {r.seq: (r.action, r.alert_id) for r in job.table("actions").collect()} == whole
    assert job.last_batch == 3 and job.store.versions() == [3, 4]


def test_killed_upsert_goes_on(spark, tmp_path):
    rows = [version(i, f"k{i % 3}", f"d{i % 2}", "low", f"h{i % 4}") for i in range(24)]
    df = spark.createDataFrame(rows, ALERT)
    land = lambda lo, hi: df.filter(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ST.stream_documents(spark, str(tmp_path / "in"), df.schema, max_files=1)
    folder = str(tmp_path / "job")

    class Killed(ST.UpsertJob):
        def __call__(self, batch, batch_id):
            super().__call__(batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("killed after its output, before its commit")

    land(0, 8)
    land(8, 16)
    broken = Killed(spark, empty(spark), folder)
    with pytest.raises(Exception, match="killed"):
        ST.run_available(stream(), broken, checkpoint=broken.checkpoint)
    assert ST.UpsertJob(spark, empty(spark), folder).snapshot().count() == 3  # seen before the next batch
    land(16, 24)
    again = ST.stream_upsert(stream(), empty(spark), folder)
    whole = I.classify(df, empty(spark))
    seen = lambda t: sorted((r.seq, r.action, r.alert_id) for r in t.collect())
    assert seen(again.table("actions")) == seen(whole)
    key = lambda t: sorted((r.id, r.content_hash) for r in t.collect())
    assert key(again.snapshot()) == key(I.apply_upsert(empty(spark), df, whole))


# ---- gazetteer, mentions, resolver ----------------------------------------------------
GAZ = ("numeric_id long, location_id string, canonical_name string, entity_type string, province_id long, district_id long, tehsil_id long, "
       "division_id long, parent_id long, latitude double, longitude double, population long")
PLACES = [
    (1, "p", "Punjab", "PROVINCE", None, None, 30.0, 72.0, None), (2, "kp", "Khyber Pakhtunkhwa", "PROVINCE", None, None, 34.0, 72.0, None),
    (10, "dl", "Lahore", "DISTRICT", 1, None, 31.5, 74.3, None), (11, "dk", "Kasur", "DISTRICT", 1, None, 31.1, 74.4, None),
    (12, "dm", "Mianwali", "DISTRICT", 1, None, 32.6, 71.5, None), (13, "dg", "Gujranwala", "DISTRICT", 1, None, 32.2, 74.2, None),
    (14, "ds", "Swat", "DISTRICT", 2, None, 35.2, 72.4, None), (15, "dh", "Haripur", "DISTRICT", 2, None, 34.0, 72.9, None),
    (20, "cl", "Lahore", "CITY", 1, 10, 31.55, 74.34, 11000), (21, "cp", "Pattoki", "CITY", 1, 11, 31.02, 73.85, 90), (22, "cm", "Mingora", "CITY", 2, 14, 34.77, 72.36, 330),
    (23, "cmi", "Mianwali", "CITY", 1, 12, 32.58, 71.54, 120), (24, "ch", "Haripur", "TOWN", 2, 15, 34.0, 72.93, 80), (25, "v", "Tan", "VILLAGE", 1, 11, None, None, None),
    (30, "c", "Pakistan", "COUNTRY", None, None, None, None, None), (31, "g", "NDMA", "GOVERNMENT_AGENCY", None, None, None, None, None),
    (32, "r", "Indus", "RIVER", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def ix(spark):
    rows = [(i, lid, n, t, p, d, None, None, d or p, la, ln, pop) for i, lid, n, t, p, d, la, ln, pop in PLACES]
    gaz = spark.createDataFrame(rows, GAZ)
    aliases = spark.createDataFrame([(20, "LHR"), (21, "Patoki")], "numeric_id long, alias string")
    return R.Index.build(gaz, aliases).compiled()


def test_scan_matches_brute_force(spark, ix):
    rng = random.Random(4)
    vocab = ["Lahore", "Kasur", "district", "Mianwali", "rain", "NDMA,", "Swat-valley", "khyber", "pakhtunkhwa", "(Indus)", "tan", "pattoki", "المطر"]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 40, 300])))) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {(r.id, r.start, r.end, r.matched_text) for r in M.scan(df, ix.words, ["id"]).collect()}
    patterns = [r.pattern for r in ix.words.collect()]
    folded = {r.id: r.f for r in df.select("id", text.fold(F.col("text")).alias("f")).collect()}
    want = set()
    for i, f in folded.items():
        for p in patterns:
            for m in re.finditer(re.escape(p), f):
                edge = (m.start() == 0 or not f[m.start() - 1].isalnum()) and (m.end() == len(f) or not f[m.end()].isalnum())
                if edge and len(p) >= 3 and p != "tan":
                    want.add((i, m.start(), m.end(), p))
    assert got == want


def test_fragments_give_no_hit(spark, ix):
    df = spark.createDataFrame([(1, "bad weather may contain tan dust")], "id int, text string")
    assert M.scan(df, ix.words, ["id"]).count() == 0


STRUCT = "id int, pos int, raw_location string, city string, district string, province string, latitude double, longitude double"
COND = "id int, cond_pos int, river string, station string, level string"


def resolve(spark, ix, title="", description="", raw=None, places=(), conditions=()):
    alerts = spark.createDataFrame([(1, title, description, raw)], "id int, title string, description string, raw_text string")
    st = spark.createDataFrame([(1, i, n, None, None, None, la, ln) for i, (n, la, ln) in enumerate(places)], STRUCT)
    co = spark.createDataFrame([(1, i, *c) for i, c in enumerate(conditions)], COND)
    return R.primary_location(alerts, st, co, ix).first()


def test_resolver_priorities(spark, ix):
    r = resolve(spark, ix, "Weather for Lahore", "Rain in Mingora", places=[("Kasur", None, None)])
    assert (r.district, r.city, r.source, r.is_inferred) == ("Kasur", "Pattoki", "STRUCTURED", False)
    r = resolve(spark, ix, "Flood warning for Mingora", "Rain in Lahore")
    assert (r.city, r.district, r.source) == ("Mingora", "Swat", "TITLE_EXTRACTION")
    r = resolve(spark, ix, "Rain in Mianwali District")
    assert (r.district, r.city, r.method) == ("Mianwali", "Mianwali", "TITLE_EXPLICIT_DISTRICT")


def test_resolver_ties(spark, ix):
    r = resolve(spark, ix, "Update", "Kasur District, Mianwali District. Downpour in Pattoki.")
    assert (r.district, r.city, r.source) == ("Kasur", "Pattoki", "DESCRIPTION_EXTRACTION")
    r = resolve(spark, ix, "Report", "Flows affect Mianwali District and Gujranwala District.",
                conditions=[("Indus", "Chashma", "Low"), ("Chenab", "Khanki", "High")])
    assert r.district == "Gujranwala"
    r = resolve(spark, ix, "Note", "Swat District. Swat roads. Showers in Kasur District.")
    assert r.district == "Swat"


def test_resolver_river_and_nothing(spark, ix):
    r = resolve(spark, ix, "Bulletin", "Level update.", conditions=[("Indus", "Tarbela", "Medium")])
    assert (r.district, r.source, r.confidence) == ("Haripur", "RIVER_MAPPING", "MEDIUM")
    r = resolve(spark, ix, "National note", "General advice.")
    assert (r.district, r.city, r.latitude, r.source, r.confidence) == (None, None, None, "UNRESOLVED", "LOW")
    r = resolve(spark, ix, "M5 quake", "x", places=[("Hindu Kush", 34.0, 71.0)])
    assert (r.latitude, r.method) == (34.0, "STRUCTURED_SCRAPER_EXPLICIT_COORDS")


def test_match_location(spark, ix):
    names = spark.createDataFrame([(1, "Atlantis"), (2, "LHR"), (3, "Kasur"), (4, "Pakistan")], "id int, raw_location string")
    got = {r.id: (r.match_confidence, r.canonical_name) for r in M.match_location(names, ix.words, ix.gaz).collect()}
    assert got[1][0] == "manual" and got[2] == ("alias", "Lahore") and got[3] == ("exact", "Kasur") and got[4][0] == "manual"


# ---- bulletins ------------------------------------------------------------------------
def test_bulletin_without_sections_and_unrelated_text(spark):
    df = spark.createDataFrame([(1, "FLOOD FORECASTING DIVISION damaged text"), (2, "Unrelated weather advisory")], "id int, raw_text string").withColumn("source_url", F.lit("u"))
    got = {r.id: r.advisory for r in B.structure_bulletins(df).collect()}
    assert got[2] is None
    assert got[1].validation_status == "partial" and got[1].river_conditions == [] and got[1].warning is None
    assert got[1].bulletin == {"issuing_department": "Flood Forecasting Division"} and got[1].highest_reported_level is None


def test_levels_come_from_conditions_not_from_the_scale(spark):
    raw = ("DAILY FLOOD BULLETIN 23-JUL-2026 Rivers at a glance INDUS Low (Tarbela & Chashma) CHENAB High (Khanki) Flood severity scale "
           "Below Low Low Medium High Very High Exceptionally High I: HYDROLOGICAL SITUATION River Indus at Tarbela and Chashma, river Kabul at "
           "Nowshera are in Low flood level. WARNING: Flows may rise upto 25th July.")
    df = spark.createDataFrame([(1, raw)], "id int, raw_text string").withColumn("source_url", F.lit("u"))
    a = B.structure_bulletins(df).first().advisory
    assert a.highest_reported_level == "High"
    assert ("Kabul", "Nowshera", "Low") in {(r.river, r.station, r.level) for r in a.river_conditions}
    assert a.warning.expected_timing == ["upto 25th July"]


# ---- quality and reports ------------------------------------------------------------------
def test_health_state_over_batches(spark):
    polls = [(1, i, ok) for i, ok in enumerate([True, False, False, False, True, False])]
    df = spark.createDataFrame([(s, T0 + dt.timedelta(hours=i), i, ok) for s, i, ok in polls], "source_id long, checked_at timestamp, event_id long, ok boolean")
    held = spark.createDataFrame([], ST.POLLS)
    seen = []
    for lo, hi in ((0, 3), (3, 4), (4, 6)):
        held = ST.open_polls(held, df.filter(f"event_id >= {lo} AND event_id < {hi}"))
        row = Q.source_health(held).first()
        seen.append((row.consecutive_failures, row.health_status))
    assert seen == [(2, "healthy"), (3, "unhealthy"), (1, "healthy")]


def test_late_polls_do_not_clear_newer_failures(spark):
    polls = lambda rows: spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), h, ok) for h, ok in rows], ST.POLLS)
    held = ST.open_polls(spark.createDataFrame([], ST.POLLS), polls([(10, False), (11, False), (12, False)]))
    held = ST.open_polls(held, polls([(5, True), (4, False)]))  # both late
    row = Q.source_health(held).first()
    assert (row.consecutive_failures, row.health_status) == (3, "unhealthy")
    held = ST.open_polls(held, polls([(11, True)]).withColumn("event_id", F.lit(100).cast("bigint")))
    assert Q.source_health(held).first().consecutive_failures == 1


def test_report_text_is_ascii_and_ordered(spark):
    alert = spark.createDataFrame([(5, 1, "S5", "Río “flood”", "Line one", "flood", None, "high", "active", T0, None, None, T0, None, "u", None, None, "hash")],
        "id long, source_id int, source_alert_id string, title string, description string, hazard_type string, official_severity string, normalized_severity string, "
        "status string, issued_at timestamp, starts_at timestamp, expires_at timestamp, created_at timestamp, updated_at timestamp, source_url string, raw_text string, "
        "validation_errors string, content_hash string")
    loc = spark.createDataFrame([(5, "a", "CITY", "Punjab", "Lahore", "Lahore", "Lahore", 31.5, 74.25, "TITLE")],
        "alert_id long, loc_id string, entity_type string, province string, district string, city string, raw_location string, latitude double, longitude double, text_source string")
    src = spark.createDataFrame([(1, "FFD Bulletins", "http://f")], "id int, name string, scrape_url string")
    docs = spark.createDataFrame([], "source_id int, url string, content_type string, content_hash string, http_status int, retrieved_at timestamp")
    revs = spark.createDataFrame([], "alert_id long, previous_content_hash string, new_content_hash string, changed_fields array<string>, created_at timestamp")
    counts = spark.createDataFrame([], "id long, revision_count long")
    body = reports.report_text(reports.report_sections(alert, loc, src, docs, revs, counts)).first().report
    assert body.isascii() and 'Rio "flood"' in body and "Parser             : FFDBulletinScraper" in body
    assert "[1]\nEntity Type        : CITY" in body and "Coordinates        : 31.5000, 74.2500" in body
    heads = ["ALERT SUMMARY", "TITLE", "DESCRIPTION", "AFFECTED LOCATIONS", "TIMING", "SAFETY INSTRUCTIONS", "SOURCE INFORMATION",
             "PROCESSING INFORMATION", "VALIDATION NOTES", "CHANGE HISTORY", "RAW EXTRACTED TEXT", "END OF ALERT RECORD"]
    at = [body.index(h) for h in heads]
    assert at == sorted(at)


# ---- scale ------------------------------------------------------------------------------
def timed(df):
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def test_scan_time_grows_with_the_text(spark, ix):
    phrase = "heavy rain in Lahore and Kasur district with wind over the plain today "
    text_of = lambda n: spark.createDataFrame([(1, phrase * (n // 13))], "id int, text string")
    timed(M.scan(text_of(2_000), ix.words, ["id"]))
    small, large = (min(timed(M.scan(text_of(n), ix.words, ["id"])) for _ in range(2)) for n in (20_000, 80_000))
    assert large <= 5 * small + 1


def test_span_folding_grows_with_the_spans(spark):
    spans = lambda n: spark.range(n).selectExpr("1 AS id", "int(id * 5) AS start", "int(id * 5 + 7) AS end", "id % 7 AS numeric_id")
    timed(M.remove_contained(spans(1_000), ["id"]))
    small, large = (min(timed(M.remove_contained(spans(n), ["id"])) for _ in range(2)) for n in (8_000, 32_000))
    assert large <= 5 * small + 1


def test_scan_across_block_borders(spark, ix):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["khyber pakhtunkhwa", "Lahore", "x" * rng.randint(1, 60), "é-Kasur"]) for _ in range(400))) for i in range(6)]
    got = {(r.id, r.start, r.matched_text) for r in M.scan(spark.createDataFrame(texts, "id int, text string"), ix.words, ["id"]).collect()}
    want = set()
    for i, t in texts:
        low = re.sub(r"\s+", " ", t.casefold().replace("-", " ")).strip()
        for p in ("khyber pakhtunkhwa", "lahore", "kasur"):
            want |= {(i, m.start(), p) for m in re.finditer(rf"(?<!\w){p}(?!\w)", low)}
    assert got == want


def test_chunks_of_a_busy_source(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < .9 else rng.randint(2, 5), T0 + dt.timedelta(seconds=rng.randrange(86_400)), i, rng.random() < .3) for i in range(2_000)]
    polls = spark.createDataFrame(rows, "source_id long, checked_at timestamp, event_id long, ok boolean")
    chunk = chunked.time_chunks(polls, "checked_at", 100)
    assert polls.groupBy("source_id", chunk.alias("c")).count().agg({"count": "max"}).first()[0] <= 200
    got = {r.event_id: r.consecutive_failures for r in Q.consecutive_failures(polls, chunk).collect()}
    want, run = {}, {}
    for source, at, event, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        run[source] = 0 if ok else run.get(source, 0) + 1
        want[event] = run[source]
    assert got == want


def test_no_machine_local_data_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


# ---- ingest -----------------------------------------------------------------------------
def arrival(seq, key, title="Flood in Lahore", description="Water rises near Pattoki.", **more):
    row = dict(seq=seq, source_id=1, source_alert_id=key, title=title, description=description, hazard_type="weather", normalized_severity="unknown",
               issued_at=T0, status="pending", source_url="u", raw_text="No more.", created_at=T0)
    return {**row, **more}


def incoming(spark, *rows):
    return spark.createDataFrame([[r.get(f.split()[0]) for f in ING.INCOMING.split(", ")] for r in rows], ING.INCOMING)


def test_ingest_stores_children_and_replaces_them(spark, ix):
    first = ING.ingest(incoming(spark, arrival(1, "a"), arrival(2, "b", title="Note", description="Nothing named.")), ING.empty_store(spark), ix)
    assert first["stats"].first().asDict() == {"created": 2, "updated": 0, "ignored": 0, "incomplete": 1, "rejected": 0}
    ids = {r.source_alert_id: r.id for r in first["alerts"].collect()}
    named = lambda out: {(r.alert_id, r.canonical_name, r.entity_type) for r in out["locations"].collect()}
    assert {n for a, n, _ in named(first) if a == ids["a"]} >= {"Lahore", "Pattoki", "Kasur", "Punjab"} and not [1 for a, _, _ in named(first) if a == ids["b"]]
    alert = {r.id: r for r in first["alerts"].collect()}[ids["a"]]
    assert (alert.hazard_type, alert.status, alert.validation_errors) == ("flood", "pending", None)
    resolution = {r.alert_id: r for r in first["resolutions"].collect()}[ids["a"]]
    assert resolution.city == "Lahore" and resolution.cache_key == alert.cache_key and resolution.dataset_version == K.GAZETTEER_VERSION
    second = ING.ingest(incoming(spark, arrival(3, "a", description="Water rises near Mingora."), arrival(4, "b", title=" note ", description="Nothing named!")),
                        {n: first[n] for n in ING.STORE}, ix)
    assert second["stats"].first().asDict() == {"created": 0, "updated": 1, "ignored": 1, "incomplete": 1, "rejected": 0}
    assert {r.source_alert_id: r.id for r in second["alerts"].collect()} == ids
    assert {n for a, n, _ in named(second) if a == ids["a"]} >= {"Lahore", "Mingora", "Swat"} and "Pattoki" not in {n for _, n, _ in named(second)}
    assert second["revisions"].count() == 1 and second["changes"].count() == 1


def test_streamed_ingest_equals_batch(spark, ix, tmp_path):
    rows = [arrival(i, f"k{i % 3}", description=f"Storm near {['Pattoki', 'Mingora'][i // 3 % 2]}.") for i in range(9)]
    df = incoming(spark, *rows)
    for lo in (0, 3, 6):
        df.filter(f"seq >= {lo} AND seq < {lo + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = ST.stream_ingest(ST.stream_documents(spark, str(tmp_path / "in"), df.schema, max_files=1), ix)
    whole = ING.ingest(df, ING.empty_store(spark), ix)
    for name in ING.STORE:
        assert sorted(map(str, job.snapshot(name).collect())) == sorted(map(str, whole[name].collect())), name


def test_backfill_dry_run_only_counts(spark, ix):
    made = ING.ingest(incoming(spark, arrival(1, "a"), arrival(2, "b")), ING.empty_store(spark), ix)
    store = {n: made[n] for n in ING.STORE}
    assert ING.backfill(store, ix, dry_run=True)["counts"].first().asDict() == {"processed": 0, "skipped": 2}
    store["resolutions"] = store["resolutions"].limit(0)
    out = ING.backfill(store, ix, dry_run=True)
    assert list(out) == ["counts"] and out["counts"].first().processed == 2
    again = ING.backfill(store, ix, named_only=True)
    assert sorted(map(str, again["locations"].collect())) == sorted(map(str, made["locations"].collect()))
    # Without it every stored location comes back as a structured one, with the evidence of that.
    whole = ING.backfill(store, ix)["locations"].collect()
    place = lambda r: (r.alert_id, r.location_id)
    assert sorted(map(place, whole)) == sorted(map(place, made["locations"].collect()))
    assert {(r.text_source, r.evidence_score) for r in whole} == {("STRUCTURED_SCRAPER_FIELD", 100)}


def test_weather_feed_is_normalised(spark):
    cap = "<alert><identifier>X</identifier><sent>2026-07-01T10:00:00+05:00</sent><info><headline>Rain</headline><severity>Severe</severity><instruction>Stay</instruction></info></alert>"
    row = feeds.run_feed("PMDWeatherScraper", spark.createDataFrame([("u", cap)], "url string, content string")).first()
    assert (row.status, row.normalized_severity, row.issued_at) == ("pending", "unknown", dt.datetime(2026, 7, 1, 5)) and row.description.endswith("Instructions: Stay")


def test_trend_flags_are_capitals(spark):
    table = "DAILY FLOOD BULLETIN 4. QUANTITATIVE FLOOD FORECAST INDUS Chashma 10 20 30 f 270 Low CHENAB Trimmu 1 2 3 R 4 High Spatial: x"
    rows = B.sections(spark.createDataFrame([(table,)], "raw_text string")).select(F.explode(B.forecast_rows(F.col("__parts"))).alias("r")).select("r.station", "r.trend")
    assert {tuple(r) for r in rows.collect()} == {("Chashma", None), ("Trimmu", "Increasing")}
