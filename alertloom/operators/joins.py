"""Joins of alerts with their dimensions, children, viewers and IP ranges.

No side is broadcast by hint unless its size has a bound; otherwise AQE picks
the strategy from measured sizes and splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom import constants as K
from alertloom.functions import geo, ip, text
from alertloom.session import worked_out, write_and_read


def with_source(alerts: DataFrame, sources: DataFrame) -> DataFrame:
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    return alerts.join(dim, "source_id")


def with_location_match(alerts: DataFrame, matching_locations: DataFrame) -> DataFrame:
    return alerts.join(matching_locations.select(F.col("alert_id").alias("id")), "id", "left_semi")


def with_children(alerts: DataFrame, locations: DataFrame, resolutions: DataFrame, sources: DataFrame) -> DataFrame:
    """Alerts with source, resolution and one row per location.

    Children stay rows: no alert's locations are gathered into one value.
    """
    loc = locations.select(
        F.col("alert_id").alias("id"), "loc_id", "province", "district", "city",
        F.col("latitude").alias("loc_latitude"), F.col("longitude").alias("loc_longitude"))
    res = resolutions.select(
        F.col("alert_id").alias("id"), F.col("district").alias("primary_district"),
        F.col("city").alias("primary_city"), F.col("source").alias("resolution_source"))
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return alerts.join(src, "source_id").join(res, "id", "left").join(loc, "id", "left")


def cross_user(alerts: DataFrame, lat: float, lng: float) -> DataFrame:
    """The one user position next to every alert, as constants."""
    return alerts.withColumns({"user_lat": F.lit(float(lat)), "user_lng": F.lit(float(lng))})


def nearest_location(locations: DataFrame, lat: float, lng: float, radius_km: float | None = None) -> DataFrame:
    """Per alert its location closest to a point; ties by location id.

    A radius adds a latitude band that reaches the scan. Top-1 is an aggregate
    with map-side combine, so an alert with very many locations is harmless.
    """
    rows = locations.filter(geo.valid_world(F.col("latitude"), F.col("longitude")))
    if radius_km is not None:
        reach = radius_km / geo.KM_PER_DEGREE * 1.000001
        rows = rows.filter(F.col("latitude").between(lat - reach, lat + reach))
    km = geo.haversine_km(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude"))
    rows = rows.withColumn("distance", km)
    if radius_km is not None:
        rows = rows.filter(F.col("distance") <= radius_km)
    label = text.location_label(*[F.col(c) for c in ("canonical_name", "city", "district", "province", "raw_location")])
    picked = F.struct(
        "loc_id", "latitude", "longitude", "distance", label.alias("location_name"),
        F.coalesce(text.filled(F.col("entity_type")), F.lit("LOCATION")).alias("location_type"))
    return (
        rows.groupBy("alert_id").agg(F.min_by(picked, F.struct("distance", "loc_id")).alias("near"))
        .select("alert_id", "near.*")
    )


LEVELS = 8   # finer grids for viewers that need not look as far as the radius; cells halve from one to the next
SHARES = 16  # parts of the viewers of a coarsest cell, so that crowded cells are the work of many tasks


def _size(radius_km: float) -> Column:
    return F.lit(float(radius_km)) / F.pow(F.lit(2.0), F.col("level"))


def _cell(rows: DataFrame, lat: str, lng: str, radius_km: float) -> DataFrame:
    """Adds band and cell of the grid of the row's ``level``."""
    rows = worked_out(rows, band=geo.lat_band(F.col(lat), _size(radius_km)))
    rows = worked_out(rows, cells=geo.lng_cells(F.col("band"), _size(radius_km)))
    return worked_out(rows, cell=geo.lng_cell(F.col(lng), F.col("cells"))).drop("cells")


def within_radius(viewers: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """(viewer, point) pairs at most ``radius_km`` apart, by grid cells.

    ``points`` needs latitude/longitude and should be distinct places: callers
    collapse equal coordinates first, so a crowded place is one row here. With a
    column ``reach`` (km, at most the radius) a viewer gets the points up to there
    and meets them in the finest grid whose cells are that wide.

    Points stand in the nine cells around theirs, viewers in their own; distance
    is then tested exactly. Both sides are shuffled: the planner does not count
    the rows that an explode makes, and would send them all through the driver.
    """
    near = "reach" in viewers.columns
    reach = F.col("reach") if near else F.lit(float(radius_km))
    level = F.floor(F.log2(F.lit(float(radius_km)) / (reach * 1.000001))) if near else F.lit(0)
    left = worked_out(viewers, level=F.greatest(F.lit(0), F.least(F.lit(LEVELS), level)).cast("int"))
    left = _cell(left, "lat", "lng", radius_km).withColumn(
        "share", F.when(F.col("level") == 0, F.pmod(F.xxhash64("viewer_id"), F.lit(SHARES))).otherwise(0).cast("int"))
    right = points.filter(geo.valid_world(F.col("latitude"), F.col("longitude")))
    right = right.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS if near else 0))))
    band = geo.lat_band(F.col("latitude"), _size(radius_km))
    right = right.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    right = worked_out(right, cells=geo.lng_cells(F.col("band"), _size(radius_km)))
    mid = geo.lng_cell(F.col("longitude"), F.col("cells"))
    right = right.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(mid + d, F.col("cells")) for d in (-1, 0, 1)])))).drop("cells")
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.when(F.col("level") == 0, SHARES - 1).otherwise(0))))
    key = ["level", "band", "cell", "share"]
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    pairs = left.join(right.hint("merge"), key).filter(F.abs(F.col("latitude") - F.col("lat")) <= reach * (1.000001 / geo.KM_PER_DEGREE))
    return pairs.withColumn("distance", km).filter(F.col("distance") <= reach).drop(*key, "reach")


def with_reach(viewers: DataFrame, places: DataFrame, radius_km: float, enough: Column) -> DataFrame:
    """Adds ``reach``: the distance in which places of the viewer's own cell are
    ``enough`` (an aggregate over places), in the finest grid where they are;
    the radius where they are in none."""
    grids = F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))
    key = ["level", "band", "cell"]
    cells = _cell(places.withColumn("level", grids), "latitude", "longitude", radius_km).groupBy(*key).agg(enough.alias("enough")).filter("enough")
    asked = _cell(viewers.select("viewer_id", "lat", "lng").withColumn("level", grids), "lat", "lng", radius_km)
    finest = asked.join(cells.hint("merge"), key, "left_semi").groupBy("viewer_id").agg(F.max("level").alias("level"))
    reach = F.coalesce(F.least(F.lit(float(radius_km)), geo.cell_span_km(F.col("lat"), _size(radius_km)) * 1.000001), F.lit(float(radius_km)))
    return write_and_read(viewers.join(finest, "viewer_id", "left").withColumn("reach", reach).drop("level"), "viewers-reach")


def needs_resolution(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts whose (id, cache_key) has no stored resolution."""
    return alerts.join(resolutions.select(F.col("alert_id").alias("id"), "cache_key"), ["id", "cache_key"], "left_anti")


def latest_raw_doc(raw_documents: DataFrame) -> DataFrame:
    """Newest raw document per source."""
    doc = F.struct("id", "url", "content_type", "content_hash", "http_status", "retrieved_at")
    return (
        raw_documents.groupBy("source_id").agg(F.max_by(doc, F.struct("retrieved_at", "id")).alias("doc"))
        .select("source_id", "doc.*")
    )


def station_districts(spark) -> DataFrame:
    return spark.createDataFrame(list(K.STATION_DISTRICT.items()), "station string, district string")


def river_districts(spark) -> DataFrame:
    rows = [(r, i, d) for r, names in K.RIVER_DISTRICTS.items() for i, d in enumerate(names)]
    return spark.createDataFrame(rows, "river string, pos int, district string")


def map_conditions(conditions: DataFrame) -> DataFrame:
    """River conditions to districts: by station, else by river in table order."""
    spark = conditions.sparkSession
    keyed = conditions.withColumns({
        "station_key": F.lower(F.trim(F.coalesce("station", F.lit("")))),
        "river_key": F.lower(F.trim(F.coalesce("river", F.lit("")))),
    })
    # Both tables are literals of fixed size: a broadcast is always right.
    st = F.broadcast(station_districts(spark).select(F.col("station").alias("station_key"), F.col("district").alias("st_district")))
    rv = F.broadcast(river_districts(spark).select(F.col("river").alias("river_key"), "pos", F.col("district").alias("rv_district")))
    both = keyed.join(st, "station_key", "left")
    by_station = both.filter("st_district IS NOT NULL").select(
        *conditions.columns, F.col("st_district").alias("district"), F.lit(2).alias("kind"),
        F.lit(0).alias("pos"), F.col("station_key").alias("matched"))
    by_river = both.filter("st_district IS NULL").join(rv, "river_key").select(
        *conditions.columns, F.col("rv_district").alias("district"), F.lit(1).alias("kind"),
        "pos", F.col("river_key").alias("matched"))
    return by_station.unionByName(by_river)


ADDRESS_BITS = 32
CHUNK_BITS = 16  # addresses meet segments in chunks of 65,536 addresses


def _levels() -> Column:
    return F.sequence(F.lit(0), F.lit(ADDRESS_BITS))


def _shifted(value: Column, k: Column) -> Column:
    return F.call_function("shiftright", value, k)


def aligned_blocks(ranges: DataFrame) -> DataFrame:
    """(k, prefix, place, rank): ranges as aligned blocks of 2^k addresses, two per
    k at most, one for a plain prefix. Of equal blocks that of the best range stays:
    the narrowest, then the later start.
    """
    one = F.lit(1).cast("bigint")

    def level(k):
        size = F.call_function("shiftleft", one, k)
        lo, hi = _shifted(F.col("ip_start") + size - 1, k), _shifted(F.col("ip_end") + 1, k)
        block = lambda odd, prefix: F.when((lo < hi) & (odd % 2 == 1), F.struct(k.alias("k"), prefix.alias("prefix")))
        return F.array(block(lo, lo), block(hi, hi - 1))

    rank = F.struct((F.col("ip_end") - F.col("ip_start")).alias("width"), (-F.col("ip_start")).alias("start"), "city", "lat", "lng")
    rows = ranges.filter("ip_start <= ip_end").select(
        F.explode(F.array_compact(F.flatten(F.transform(_levels(), level)))).alias("b"), F.struct("city", "lat", "lng").alias("place"), rank.alias("rank"))
    return rows.groupBy("b.k", "b.prefix").agg(F.min_by("place", "rank").alias("place"), F.min("rank").alias("rank"))


def ip_segments(ranges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(pos, place): the address space cut where the answer may change.

    From ``pos`` to the next one every address has the place of the narrowest
    range that holds it, or null where none does; ranges may overlap or nest. A cut is looked
    up once in each block size, so the work is 33 narrow rows a cut and does not
    depend on how wide ranges are. ``starts``: further positions to cut at.
    """
    blocks = aligned_blocks(ranges)
    ends = F.array(F.col("prefix"), F.col("prefix") + 1)
    cuts = blocks.select(F.explode(F.transform(ends, lambda p: F.call_function("shiftleft", p, F.col("k")))).alias("pos"))
    if starts is not None:
        cuts = cuts.unionByName(starts.select("pos"))
    cuts = cuts.distinct()
    around = cuts.select("pos", F.explode(F.transform(_levels(), lambda k: F.struct(k.alias("k"), _shifted(F.col("pos"), k).alias("prefix")))).alias("b"))
    held = around.select("pos", "b.*").join(blocks, ["k", "prefix"]).select("pos", "place", "rank")
    return held.unionByName(cuts, allowMissingColumns=True).groupBy("pos").agg(F.min_by("place", "rank").alias("place"))


def locate_addresses(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(pos, city, lat, lng) of distinct addresses ``pos``: an as-of merge with the
    segments, chunk by chunk. Every chunk that holds an address starts with a cut
    of its own, so nothing is carried from one chunk to the next."""
    chunk = lambda c: _shifted(c, F.lit(CHUNK_BITS))
    starts = addresses.select(F.call_function("shiftleft", chunk(F.col("pos")), F.lit(CHUNK_BITS)).alias("pos")).distinct()
    cuts = ip_segments(ranges, starts).select("pos", F.struct("place").alias("cut"))
    merged = cuts.unionByName(addresses.select("pos", F.lit(True).alias("asked")), allowMissingColumns=True)
    so_far = Window.partitionBy(chunk(F.col("pos"))).orderBy("pos", F.col("asked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("cut", F.last("cut", ignorenulls=True).over(so_far)).filter("asked").select("pos", "cut.place.*")


def geoip_join(log: DataFrame, ranges: DataFrame, address: str = "address") -> DataFrame:
    """Places of a log's addresses from (ip_start, ip_end, city, lat, lng).

    Each address gets the narrowest range that holds it, so a log row stays one
    row. Distinct public addresses are located once; misses fall back by method.
    Rows without such an address are spread by their content, so that no task
    gets all of them.
    """
    asked = F.when(F.coalesce(ip.is_public(F.col(address)), F.lit(False)), F.col(address)).cast("bigint")
    addresses = log.select(asked.alias("pos")).distinct().filter("pos IS NOT NULL")
    hashable = [F.col(c) for c, kind in log.dtypes if "map<" not in kind and kind != "variant"]
    aside = -1 - F.pmod(F.xxhash64(*hashable), F.lit(1 << 20))
    places = locate_addresses(addresses, ranges).withColumnRenamed("pos", "__pos")
    located = log.withColumn("__pos", F.coalesce(asked, aside)).join(places, "__pos", "left")
    found, private = geo.valid_world(F.col("lat"), F.col("lng")), F.col("__pos") < 0
    a = F.col(address)
    method = (
        F.when(a.isNull() & F.col("invalid_input"), "invalid_ip_fallback")
        .when(a.isNull(), "default")
        .when(private & F.col("is_local_development"), "local_development")
        .when(private, "private_ip_fallback")
        .when(~found, "geoip_not_found_fallback")
        .when(F.col("is_local_development"), "local_development")
        .otherwise("ip")
    )
    d = K.DEFAULT_LOCATION
    return located.withColumn("detection_method", method).withColumns({
        "is_fallback": ~found,
        "city": F.when(found, F.col("city")).otherwise(d["city"]),
        "lat": F.when(found, F.col("lat")).otherwise(d["lat"]),
        "lng": F.when(found, F.col("lng")).otherwise(d["lng"]),
    }).drop("__pos")


def find_city(wanted: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (name, district, province; the last two optional) with
    the first city whose name or alias is equal.

    ``cities``: pos, city_id, name, alias (one row per alias), district, province.
    """
    named = cities.select(F.lower("name").alias("key"), "pos", "city_id", "district", "province").unionByName(
        cities.filter("alias IS NOT NULL").select(F.lower("alias").alias("key"), "pos", "city_id", "district", "province"))
    q = wanted.select(F.col("query_id"), F.lower(F.trim("name")).alias("key"),
                      F.col("district").alias("want_district"), F.col("province").alias("want_province"))
    ok = lambda want, have: F.coalesce(F.col(want) == "", F.lit(True)) | (F.col(want) == F.col(have))
    return (
        q.join(named, "key").filter(ok("want_district", "district") & ok("want_province", "province"))
        .groupBy("query_id").agg(F.min_by("city_id", "pos").alias("city_id"))
    )
