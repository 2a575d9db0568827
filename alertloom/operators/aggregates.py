"""Counts and summaries. All use map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import geo, text


def ingest_stats(actions: DataFrame) -> DataFrame:
    """``action`` created/updated/ignored/rejected and ``status``; an incomplete
    alert counts as incomplete and as its action."""
    act = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(
        act("created"), act("updated"), act("ignored"),
        F.count_if((F.col("status") == "incomplete") & (F.col("action") != "rejected")).alias("incomplete"),
        act("rejected"))


def _healthy() -> Column:
    return (F.col("consecutive_failures") == 0) & (F.col("health_status") != "unhealthy")


def _unhealthy() -> Column:
    return (F.col("consecutive_failures") > 0) | (F.col("health_status") == "unhealthy")


def alert_counts(alerts: DataFrame, *keys: str) -> DataFrame:
    """Alerts held, active and critical ones and the newest time, per key or over all."""
    active = F.col("status") == "active"
    return alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alerts_in_store"), F.count_if(active).alias("active_alerts_count"),
        F.count_if(active & (F.col("normalized_severity") == "critical")).alias("critical_alerts_count"),
        F.max(F.coalesce("updated_at", "issued_at")).alias("alerts_updated"))


def districts_of(locations: DataFrame, ids: DataFrame) -> DataFrame:
    """The districts of the locations of some alerts (``alert_id``)."""
    held = locations.join(ids, "alert_id", "left_semi")
    return held.select(text.filled(F.col("district")).alias("district")).filter("district IS NOT NULL").distinct()


def summary_row(counts: DataFrame, districts: DataFrame, sources: DataFrame) -> DataFrame:
    """The summary out of alert counts (any number of rows), affected districts and source states."""
    total = counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("alerts_in_store", "active_alerts_count", "critical_alerts_count")],
        F.max("alerts_updated").alias("alerts_updated"))
    health = sources.agg(F.struct(
        F.count_if(_healthy()).alias("ok"), F.count_if(_unhealthy()).alias("bad"),
        F.max("last_checked_at").alias("checked")).alias("h")).scalar()
    return total.select(
        "alerts_in_store", "active_alerts_count", "critical_alerts_count",
        districts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("affected_districts_count"),
        health["ok"].alias("healthy_sources_count"), health["bad"].alias("unhealthy_sources_count"),
        F.coalesce(health["checked"], "alerts_updated").alias("latest_update_time"))


def summary_metrics(alerts: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: alert counts, affected districts, source health, last update."""
    ids = alerts.select(F.col("id").alias("alert_id"))
    return summary_row(alert_counts(alerts), districts_of(locations, ids), sources).drop("alerts_in_store")


def map_summary(map_alerts: DataFrame, locations: DataFrame) -> DataFrame:
    districts = locations.join(map_alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi").agg(
        F.countDistinct(text.filled(F.col("district"))).alias("n"))
    return map_alerts.agg(
        F.count("*").alias("total_map_alerts"),
        F.count_if(F.col("normalized_severity") == "critical").alias("critical_map_alerts"),
    ).withColumn("affected_districts_count", districts.scalar())


def type_counts(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.groupBy("entity_type").agg(F.count("*").alias("n"))


def ambiguous_aliases(names: DataFrame, first: int | None = None) -> DataFrame:
    """(normalised name, how many records, one row per record id) for the names
    that more than one record carries; ``first`` keeps so many, in name order."""
    pairs = names.filter("name <> ''").select("name", "location_id").distinct()
    counts = pairs.groupBy("name").agg(F.count("*").alias("n_records")).filter("n_records > 1")
    kept = counts if first is None else counts.orderBy("name").limit(first)
    return pairs.join(kept, "name")


def source_health_counts(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count_if(F.col("consecutive_failures") == 0).alias("operational"),
        F.count_if(F.col("consecutive_failures") > 0).alias("delayed"),
        F.count("*").alias("source_count"))


def source_state(failures: Column, health: Column) -> Column:
    return (
        F.when((health == "unhealthy") | (failures >= K.UNHEALTHY_AFTER), "UNAVAILABLE")
        .when(failures > 0, "RETRYING").otherwise("OPERATIONAL"))


def revision_count(alerts: DataFrame, revisions: DataFrame) -> DataFrame:
    n = revisions.groupBy(F.col("alert_id").alias("id")).agg(F.count("*").alias("n"))
    return alerts.select("id").join(n, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("revision_count"))


def location_groups(locations: DataFrame) -> DataFrame:
    """Distinct places per alert with the display order of their type."""
    kind = F.coalesce(text.filled(F.col("entity_type")), F.lit("UNKNOWN"))
    name = F.coalesce(text.filled(F.col("canonical_name")), text.filled(F.col("raw_location")))
    order = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(K.GROUP_ORDER)], F.lit(99))
    return (
        locations.select("alert_id", "loc_id", kind.alias("type"), name.alias("name")).filter("name IS NOT NULL")
        .groupBy("alert_id", F.lower("type").alias("type_key"), F.lower("name").alias("name_key"))
        .agg(F.min_by(F.struct("type", "name", "loc_id"), "loc_id").alias("m"))
        .select("alert_id", "m.*").withColumn("type_order", order)
    )


def tile_clusters(points: DataFrame, zoom: int) -> DataFrame:
    """Points per grid cell of a zoom level. Above ``CLUSTER_MAX_ZOOM`` nothing
    is clustered: every point is a row of its own, count 1."""
    x, y = geo.mercator_cell(F.col("latitude"), F.col("longitude"), zoom)
    if zoom > K.CLUSTER_MAX_ZOOM:
        return points.filter(geo.valid_country(F.col("latitude"), F.col("longitude"))).select(
            x.alias("cell_x"), y.alias("cell_y"), F.lit(1).cast("bigint").alias("point_count"), F.col("latitude").alias("lat"),
            F.col("longitude").alias("lng"), F.lit("small").alias("size_class"))
    low, high = K.CLUSTER_CLASSES
    n = F.col("point_count")
    return (
        points.filter(geo.valid_country(F.col("latitude"), F.col("longitude")))
        .groupBy(x.alias("cell_x"), y.alias("cell_y"))
        .agg(F.count("*").alias("point_count"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"))
        .withColumn("size_class", F.when(n < low, "small").when(n < high, "medium").otherwise("large"))
    )


def children_by_parent(gazetteer: DataFrame) -> DataFrame:
    """province → district and district → populated place edges."""
    typed = lambda types: F.col("entity_type").isin(types)
    edge = lambda kind, parent: F.struct(F.lit(kind).alias("kind"), F.col(parent).alias("parent_id"))
    link = (
        F.when(typed(["DISTRICT"]), edge("province_district", "province_id"))
        .when(typed(K.POPULATED_TYPES), edge("district_place", "district_id")))
    return (
        gazetteer.select(link.alias("l"), F.col("numeric_id").alias("child_id"))
        .select("l.*", "child_id").filter("parent_id IS NOT NULL"))


def page_header(page: DataFrame, start: Column, end: Column, label: Column) -> DataFrame:
    return page.agg(F.count("*").alias("total_count")).select(
        "total_count", start.alias("window_start"), end.alias("window_end"), label.alias("window_label"))
