"""Coordinate tests, distances and grid keys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from alertloom import constants as K


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _inside(lat: Column, lng: Column, box) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lng.between(box[2], box[3]), F.lit(False))


def valid_country(lat: Column, lng: Column) -> Column:
    return _inside(_number(lat), _number(lng), K.COUNTRY_BOX)


def valid_world(lat: Column, lng: Column) -> Column:
    return _inside(_number(lat), _number(lng), (-90, 90, -180, 180))


def near_region(lat: Column, lng: Column) -> Column:
    return _inside(lat, lng, K.REGION_BOX)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lng = (a2 - a1) / 2, (F.radians(lng2) - F.radians(lng1)) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(a1) * F.cos(a2) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def round_km(km: Column) -> Column:
    return F.round(km, 2)


def thousands(population: Column) -> Column:
    return F.floor(population / 1000 + 0.5)


def checked_pair(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """The first pair inside the country box, or nulls."""
    pair = lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lng"))
    nothing = F.lit(None).cast("double")
    return (
        F.when(valid_country(lat, lng), pair(lat, lng))
        .when(valid_country(lat2, lng2), pair(lat2, lng2))
        .otherwise(pair(nothing, nothing))
    )


def magnitude_severity(m: Column) -> Column:
    return F.when(m >= 7, "critical").when(m >= 5, "high").when(m >= 4, "medium").otherwise("low")


def magnitude_status(m: Column, lat: Column, lng: Column) -> Column:
    return F.when((near_region(lat, lng) & (m >= 4)) | (m >= 5), "active").otherwise("pending")


# ---- grid cells for distance joins ------------------------------------------
KM_PER_DEGREE = math.pi * K.EARTH_RADIUS_KM / 180.0


def lat_band(lat: Column, radius_km: float) -> Column:
    return F.floor((lat + 90) * (KM_PER_DEGREE / radius_km)).cast("int")


def lng_cells(band: Column, radius_km: float) -> Column:
    """How many longitude cells a latitude band has: each at least one radius
    wide at the poleward edge of the band and its two neighbours."""
    height = radius_km / KM_PER_DEGREE
    edge = F.least(
        F.greatest(F.abs((band - 1) * height - 90), F.abs((band + 2) * height - 90)), F.lit(90.0)
    )
    # The widest longitude difference two points within the radius can have.
    reach = F.degrees(F.asin(F.least(
        F.lit(1.0), F.sin(F.lit(radius_km / (2 * K.EARTH_RADIUS_KM))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
    ))) * 2
    return F.greatest(F.lit(1), F.floor(360.0 / F.greatest(reach * 1.0000001, F.lit(1e-9)))).cast("int")


def lng_cell(lng: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lng + 180) / 360 * cells).cast("int"), cells)


def cell_span_km(lat: Column, radius_km) -> Column:
    """How far apart two points of a latitude's grid cell can be, at most: by the
    haversine formula with the cell's height, its width and its equatorward edge."""
    band, height = lat_band(lat, radius_km), F.lit(radius_km / KM_PER_DEGREE)
    low = band * height - 90
    edge = F.when(low * (low + height) <= 0, 0.0).otherwise(F.least(F.abs(low), F.abs(low + height)))
    width = F.least(360.0 / lng_cells(band, radius_km), F.lit(180.0))
    half = lambda degrees: F.sin(F.radians(degrees) / 2)
    h = half(height) * half(height) + F.pow(F.cos(F.radians(edge)) * half(width), F.lit(2))
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# ---- map tiles -----------------------------------------------------------------
def mercator_cell(lat: Column, lng: Column, zoom: int, pixels: int = K.CLUSTER_RADIUS_PX) -> tuple[Column, Column]:
    size = 256.0 * 2**zoom
    s = F.sin(F.radians(lat))
    x = (lng + 180.0) / 360.0
    y = 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    return F.floor(x * size / pixels), F.floor(y * size / pixels)
