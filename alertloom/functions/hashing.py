"""Content hashes. Location sets enter as a mergeable multiset digest, so no
alert's locations are ever gathered into one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def location_key(province: Column, district: Column, city: Column, raw: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit("None"))
    return F.trim(F.lower(F.concat_ws("-", none(province), none(district), none(city), none(raw))))


def digest_aggregates(key: Column) -> list[Column]:
    """Order-free digest parts of a multiset of keys: size, two 64-bit xors and
    a sum, all with map-side combine."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit("second"), key)
    return [
        F.count(key).alias("n"),
        F.bit_xor(h1).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("third"), key, h2)).alias("x2"),
        F.sum(h2.cast("decimal(20,0)")).alias("s"),
    ]


def digest_text(prefix: str = "") -> Column:
    c = lambda n: F.coalesce(F.col(prefix + n).cast("string"), F.lit("0"))
    return F.concat_ws(":", c("n"), c("x1"), c("x2"), c("s"))


def location_digest(locations: DataFrame, alert_key: str = "alert_id") -> DataFrame:
    """(alert key, location_digest)."""
    key = location_key(F.col("province"), F.col("district"), F.col("city"), F.col("raw_location"))
    return (
        locations.groupBy(alert_key).agg(*digest_aggregates(key))
        .select(alert_key, digest_text().alias("location_digest"))
    )


def content_hash(location_digest: Column, source_id="source_id", source_alert_id="source_alert_id",
                 hazard="hazard_type", title="title", description="description",
                 severity="normalized_severity") -> Column:
    """SHA-256 over the fields whose change matters; white space, case and
    punctuation of the description do not."""
    instant = lambda name: F.unix_micros(F.col(name)).alias(name)
    return F.sha2(F.to_json(F.struct(
        F.col(source_id).alias("source_id"),
        F.col(source_alert_id).alias("source_alert_id"),
        F.col(hazard).alias("hazard"),
        F.lower(F.trim(F.col(title))).alias("title"),
        F.coalesce(location_digest, F.lit("0:0:0:0")).alias("locations"),
        instant("issued_at"), instant("starts_at"), instant("expires_at"),
        F.col(severity).alias("severity"),
        F.lower(F.regexp_replace(F.coalesce(F.col(description), F.lit("")), r"(?U)\W+", "")).alias("description"),
    )), 256)


def cache_key(content: Column, dataset_version: str, algorithm_version: str) -> Column:
    return F.sha2(F.concat_ws(":", content, F.lit(dataset_version), F.lit(algorithm_version)), 256)


def document_hash(text: Column) -> Column:
    return F.sha2(text, 256)
