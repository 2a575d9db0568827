"""Row filters and projections on the alert table (all pushed to the scan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import timeops


def effective(df: DataFrame) -> Column:
    return timeops.effective_ts(*[F.col(c) for c in ("effective_event_at", "issued_at", "starts_at", "created_at")])


def status_in(df: DataFrame, statuses: list[str]) -> DataFrame:
    return df.filter(F.col("status").isin(statuses))


def exclude_status(df: DataFrame, show_cancelled: bool = False) -> DataFrame:
    hidden = K.HIDDEN_STATUSES + ([] if show_cancelled else ["cancelled"])
    return df.filter(~F.col("status").isin(hidden))


def unexpired(df: DataFrame, as_of) -> DataFrame:
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > timeops.as_of_column(as_of)))


def in_window(df: DataFrame, as_of, days: float = K.WINDOW_DAYS, hours: float | None = None,
              skew_minutes: int = K.SKEW_MINUTES) -> DataFrame:
    start, end = timeops.window_bounds(as_of, days, hours, skew_minutes)
    return df.filter(effective(df).between(start, end))


def search(df: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive substring over title or description; % and _ are wildcards."""
    if not term:
        return df
    pattern = f"%{term.strip()}%"
    return df.filter(F.col("title").ilike(pattern) | F.col("description").ilike(pattern))


def eq_filters(df: DataFrame, hazard: str | None = None, severity: str | None = None,
               status: str | None = None) -> DataFrame:
    for column, value in (("hazard_type", hazard), ("normalized_severity", severity), ("status", status)):
        if value:
            df = df.filter(F.col(column) == value)
    return df


def ci_filters(df: DataFrame, as_of, severity=None, hazard=None, status=None, source=None) -> DataFrame:
    """Nearby-query filters; a given status replaces the status and expiry defaults.
    ``source`` needs a ``source_name`` column."""
    if status:
        df = df.filter(F.lower("status") == status.lower())
    else:
        df = unexpired(status_in(df, K.NEARBY_STATUSES), as_of)
    for column, value in (("normalized_severity", severity), ("hazard_type", hazard), ("source_name", source)):
        if value:
            df = df.filter(F.lower(column) == value.lower())
    return df


def admin_match(locations: DataFrame, province=None, district=None, city=None, substring: bool = False) -> DataFrame:
    """Location rows on which every given name holds."""
    for column, value in (("province", province), ("district", district), ("city", city)):
        if value:
            hit = F.col(column).ilike(f"%{value}%") if substring else F.col(column) == value
            locations = locations.filter(hit)
    return locations


def admin_filter(df: DataFrame, locations: DataFrame, province=None, district=None, city=None,
                 substring: bool = False) -> DataFrame:
    if not (province or district or city):
        return df
    hits = admin_match(locations, province, district, city, substring).select(F.col("alert_id").alias("id"))
    return df.join(hits, "id", "left_semi")


def source_filter(df: DataFrame, sources: DataFrame, text: str) -> DataFrame:
    pattern = f"%{text}%"
    hits = sources.filter(F.col("name").ilike(pattern) | F.col("source_type").ilike(pattern))
    return df.join(hits.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def prune_payload(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_text", F.lit(None).cast("string"))


def raw_text_of(df: DataFrame, alert_id: int) -> DataFrame:
    return df.filter(F.col("id") == alert_id).select(F.col("id").alias("alert_id"), "raw_text")


def get_alert(df: DataFrame, alert_id: int) -> DataFrame:
    return df.filter(F.col("id") == alert_id)


def set_status(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (id, decision) rows: approve → active, reject → rejected."""
    new = F.when(F.col("decision") == "approve", "active").when(F.col("decision") == "reject", "rejected")
    return (
        df.join(decisions.select("id", new.alias("new_status")), "id", "left")
        .withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    )


def unknown_decisions(df: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(df.select("id"), "id", "left_anti")


def recent_or(df: DataFrame, cutoff) -> DataFrame:
    at = timeops.as_of_column(cutoff)
    return df.filter((F.col("effective_event_at") >= at) | (F.col("issued_at") >= at))


def history_expired(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "expired")


def split_river_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a current level, forecast-only rows)."""
    current = F.col("level").isNotNull()
    return rows.filter(current), rows.filter(~current)
