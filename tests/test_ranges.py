"""Joins of addresses with ranges and of viewers with places, against brute force."""

import random

from pyspark.sql import functions as F

from alertloom.operators import joins as J

RANGES = "ip_start bigint, ip_end bigint, city string, lat double, lng double"
TOP = 2**32 - 1


def random_ranges(rnd, n):
    """Overlapping, nested, equal and touching ranges, some of them very wide."""
    out = [(0, TOP, "all", 1.0, 2.0), (16777216, 16777216, "one", 1.0, 2.0), (TOP, TOP, "last", 1.0, 2.0)]
    for i in range(n):
        lo = rnd.randrange(2**32) if i % 2 else 16777216 + rnd.randrange(600)
        hi = min(TOP, lo + rnd.choice([0, 1, 7, 255, 256, 70_000, 2**24, 2**30]))
        out.append((lo, hi, f"c{i}", float(i % 80), None if i % 9 == 0 else float(i % 170)))
    return out + out[5:8]


def best(ranges, a):
    held = [(hi - lo, -lo, city) for lo, hi, city, *_ in ranges if lo <= a <= hi]
    return min(held)[2] if held else None


def test_addresses_get_the_narrowest_of_overlapping_ranges(spark):
    rnd = random.Random(5)
    for ranges in (random_ranges(rnd, 120), random_ranges(rnd, 60)[1:]):
        edges = {x + d for lo, hi, *_ in ranges for x in (lo, hi) for d in (-1, 0, 1)}
        asked = sorted(a for a in edges | {rnd.randrange(2**32) for _ in range(300)} if 0 <= a <= TOP)
        addresses = spark.createDataFrame([(a,) for a in asked], "pos bigint")
        got = {r.pos: r.city for r in J.locate_addresses(addresses, spark.createDataFrame(ranges, RANGES)).collect()}
        assert got == {a: best(ranges, a) for a in asked}


def test_log_rows_stay_single_whatever_ranges_there_are(spark):
    log = spark.createDataFrame(
        [(1, 134744072, False, False), (2, None, True, False), (3, None, False, False), (4, 167772161, False, True), (5, 167772161, False, False),
         (6, 134744072, False, True), (7, 3405803777, False, False), (7, 134744072, False, False)],
        "n int, address bigint, invalid_input boolean, is_local_development boolean")
    wide, narrow = (134744064, 134744079, "narrow", 31.0, 74.0), (0, TOP, "wide", None, None)
    rows = lambda *rs: sorted((r.n, r.detection_method, r.city) for r in J.geoip_join(log, spark.createDataFrame(list(rs), RANGES)).collect())
    centre = "Pakistan Centre"
    rest = [(2, "invalid_ip_fallback", centre), (3, "default", centre), (4, "local_development", centre), (5, "private_ip_fallback", centre)]
    assert rows(wide, narrow) == sorted(rest + [
        (1, "ip", "narrow"), (6, "local_development", "narrow"), (7, "ip", "narrow"), (7, "private_ip_fallback", centre)])
    assert rows() == sorted(rest + [
        (1, "geoip_not_found_fallback", centre), (6, "geoip_not_found_fallback", centre), (7, "geoip_not_found_fallback", centre), (7, "private_ip_fallback", centre)])


def test_a_wide_range_is_few_blocks(spark):
    whole = spark.createDataFrame([(0, TOP, "a", 1.0, 1.0), (1, TOP - 1, "b", 1.0, 1.0)], RANGES)
    assert J.aligned_blocks(whole).count() == 1 + 62
