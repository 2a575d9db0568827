"""Viewers and places: nothing exploded is sent through the driver, and a viewer meets few places of a dense region."""

import math
import random

from pyspark.sql import functions as F

from alertloom.operators import joins as J, topk as T


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def spread_points(n, seed):
    rng = random.Random(seed)
    return [(i, 30 + rng.random() * 3, 70 + rng.random() * 3) for i in range(n)]


def test_no_side_of_the_radius_join_is_broadcast(spark):
    viewers = spark.createDataFrame(spread_points(50, 1), "viewer_id long, lat double, lng double")
    points = spark.createDataFrame(spread_points(50, 2), "pid long, latitude double, longitude double")
    pairs = J.within_radius(viewers, points, 100.0)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_reach_keeps_every_pair_up_to_it(spark):
    rows, places = spread_points(60, 3), spread_points(300, 4)
    viewers = spark.createDataFrame([(*r, [400.0, 60.0, 3.0, 0.5][r[0] % 4]) for r in rows], "viewer_id long, lat double, lng double, reach double")
    points = spark.createDataFrame(places, "pid long, latitude double, longitude double")
    got = {(r.viewer_id, r.pid) for r in J.within_radius(viewers, points, 400.0).collect()}
    want = {(v, p) for v, a, b in rows for p, c, d in places if km(a, b, c, d) <= [400.0, 60.0, 3.0, 0.5][v % 4]}
    assert got == want


def test_viewers_meet_few_places_of_a_dense_region(spark):
    """1,000 places with 3 alerts each; a page of 6 needs few of them."""
    places, rows, n = spread_points(1000, 5), spread_points(40, 6), 6
    spots = spark.createDataFrame([(i, a, b, 3 * SHARE, 3) for i, a, b in places], "pid long, latitude double, longitude double, own long, held long")
    viewers = spark.createDataFrame(rows, "viewer_id long, lat double, lng double")
    enough = (F.sum("own") >= n * SHARE) | (F.max("held") >= n)
    pairs = J.within_radius(J.with_reach(viewers, spots, 300.0, enough), spots, 300.0)
    assert pairs.count() < 0.1 * len(rows) * len(places)
    nearest = pairs.groupBy("viewer_id").agg(F.count("*").alias("n")).collect()
    assert len(nearest) == len(rows) and min(r.n for r in nearest) >= 2


SHARE = getattr(T, "SHARE", 1)


def test_page_of_every_viewer_against_brute_force(spark):
    """Alerts at several places, of which some share theirs with others."""
    rng = random.Random(7)
    places, rows = spread_points(200, 8), spread_points(30, 9)
    at = [(alert, *places[rng.randrange(200)][1:]) for alert in range(400) for _ in range(1 + alert % 4)]
    locations = spark.createDataFrame(at, "alert_id long, latitude double, longitude double")
    alerts = spark.range(400).selectExpr(
        "id", "'high' AS normalized_severity", "TIMESTAMP '2020-01-01 00:00:00' AS issued_at", "'active' AS status", "CAST(NULL AS TIMESTAMP) AS expires_at",
        "'flood' AS hazard_type")
    viewers = spark.createDataFrame(rows, "viewer_id long, lat double, lng double")
    page = T.nearby_for_viewers(alerts, locations, viewers, "2020-01-02 00:00:00", 120.0, limit=7, offset=3)
    got = {(r.viewer_id, r.pos): r.id for r in page.collect()}
    want = {}
    for v, a, b in rows:
        best = {}
        for alert, c, d in at:
            far = km(a, b, c, d)
            if far <= 120.0:
                best[alert] = min(far, best.get(alert, 1e9))
        for pos, (_, alert) in enumerate(sorted((f, i) for i, f in best.items())[:10], 1):
            if pos > 3:
                want[v, pos] = alert
    assert got == want
