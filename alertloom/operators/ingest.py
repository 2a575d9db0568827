"""Documents in, stored alerts out: the whole ingest as one DataFrame job.

The same function serves a batch and, through ``IngestJob``, every micro-batch
of a stream. Nothing is collected: an alert's children stay rows. What is written
on the way is joined by measured sizes; returned tables are best written so too
(``measured_broadcasts``): they are read from compressed files of many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import hashing, text, timeops
from alertloom.operators import aggregates as A, bulletins as B, identity as I, joins as J, mentions as M, quality as Q, resolve as R
from alertloom.operators.reports import change_feed
from alertloom.session import measured_broadcasts, write_and_read

INCOMING = (
    "seq bigint, source_id int, source_alert_id string, title string, description string, hazard_type string, official_severity string, "
    "normalized_severity string, issued_at timestamp, starts_at timestamp, expires_at timestamp, status string, source_url string, raw_text string, "
    "created_at timestamp, raw_location string, latitude double, longitude double")
ALERTS = (
    "id bigint, source_id int, source_alert_id string, source_url string, created_at timestamp, title string, description string, hazard_type string, "
    "official_severity string, normalized_severity string, issued_at timestamp, starts_at timestamp, expires_at timestamp, effective_event_at timestamp, "
    "status string, raw_text string, content_hash string, validation_errors string, structured_advisory string, cache_key string")
LOCATIONS = (
    "alert_id bigint, location_id string, entity_type string, canonical_name string, province string, district string, tehsil string, city string, "
    "raw_location string, matched_text string, latitude double, longitude double, match_confidence string, text_source string, match_method string, "
    "start_offset int, end_offset int, evidence_score int")
MENTIONS = (
    "alert_id bigint, location_id string, canonical_name string, entity_type string, matched_text string, text_source string, match_method string, "
    "start_offset int, end_offset int, evidence_score int, confidence double, ignored boolean")
RESOLUTIONS = (
    "alert_id bigint, district string, city string, province string, latitude double, longitude double, source string, confidence string, "
    "is_inferred boolean, label string, method string, cache_key string, algorithm_version string, dataset_version string")
STORE = {"locations": LOCATIONS, "mentions": MENTIONS, "resolutions": RESOLUTIONS, "alerts": ALERTS}


def empty_store(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STORE.items()}


def _as(df: DataFrame, schema: str) -> DataFrame:
    """Columns in the order and types of a stored table; what is absent is null."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def children(alerts: DataFrame, structured: DataFrame, conditions: DataFrame, ix: R.Index, safety=None) -> dict[str, DataFrame]:
    """Location, mention and resolution rows of alerts (``id`` as ``alert_id``).

    ``alerts``: id, title, description, raw_text, cache_key.
    """
    found = M.extract(alerts, structured, ix.words, ix.gaz, safety, ix.probe)
    named = found["mentions"].select(
        F.col("id").alias("alert_id"), "location_id", "canonical_name", "entity_type", "matched_text", "text_source", "match_method",
        F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "evidence_score", "confidence")
    ignored = found["ignored"].select(F.col("id").alias("alert_id"), "location_id")
    primary = R.primary_location(alerts, structured, conditions, ix).join(alerts.select("id", "cache_key"), "id").withColumnRenamed("id", "alert_id")
    versions = {"algorithm_version": F.lit(K.EXTRACTION_VERSION), "dataset_version": F.lit(K.GAZETTEER_VERSION)}
    return {
        "locations": _as(M.location_rows(found["locations"]), LOCATIONS), "mentions": _as(I.stored_mentions(named, ignored), MENTIONS),
        "resolutions": _as(primary.withColumns(versions), RESOLUTIONS)}


def prepare(incoming: DataFrame, ix: R.Index) -> dict[str, DataFrame]:
    """Normalised, structured, placed, validated and hashed alerts with their
    children; ``seq`` is the alert key of all tables."""
    with measured_broadcasts(incoming.sparkSession):
        rows = B.structure_bulletins(text.normalize_alert(incoming))
        rows = write_and_read(rows.withColumn("id", F.col("seq")), "ingest")  # read by every step below
        structured = rows.filter("raw_location IS NOT NULL OR latitude IS NOT NULL").selectExpr(
            "id", "1 AS pos", "raw_location", "CAST(NULL AS STRING) AS city", "CAST(NULL AS STRING) AS district", "CAST(NULL AS STRING) AS province",
            "latitude", "longitude")
        conditions = B.river_conditions(rows, "id").withColumnRenamed("pos", "cond_pos")
        made = children(rows.withColumn("cache_key", F.lit("")), structured, conditions, ix)
        made = {name: write_and_read(df.withColumnRenamed("alert_id", "seq"), f"ingest-{name}") for name, df in made.items()}
        placed = made["locations"].select("seq").distinct().withColumn("has_location", F.lit(True))
        digest = hashing.location_digest(made["locations"], "seq")
        checked = Q.validate_alerts(rows.join(placed, "seq", "left").join(digest, "seq", "left").withColumn("has_location", F.coalesce("has_location", F.lit(False))))
        alerts = checked.withColumn("content_hash", hashing.content_hash(F.col("location_digest"))).withColumns({
            "cache_key": hashing.cache_key(F.col("content_hash"), K.GAZETTEER_VERSION, K.EXTRACTION_VERSION),
            "structured_advisory": F.to_json("advisory"),
            "effective_event_at": timeops.effective_ts(F.col("issued_at"), F.col("starts_at"), F.col("created_at"))})
        made["alerts"] = write_and_read(_as(alerts, "seq bigint, " + ALERTS.split(", ", 1)[1]), "ingest-alerts")
        keys = made["alerts"].select("seq", "cache_key")
        made["resolutions"] = made["resolutions"].drop("cache_key").join(keys, "seq")
        return made


def ingest(incoming: DataFrame, store: dict[str, DataFrame], ix: R.Index, rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Next version of the stored tables, with actions, revisions, changes and stats.

    ``incoming`` has the columns of ``INCOMING``; ``seq`` orders arrivals.
    ``rejected`` are rows that a feed could not read: they are counted, and the
    others go on.
    """
    return merge(prepare(incoming, ix), store, rejected)


def merge(made: dict[str, DataFrame], store: dict[str, DataFrame], rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Prepared arrivals into the stored tables, or into those parts of them that
    hold every alert the arrivals match. An alert's children are those of its last
    accepted arrival; ignored arrivals change nothing.
    """
    with measured_broadcasts(made["alerts"].sparkSession):
        batch = made["alerts"]
        marks = write_and_read(I.classify(batch, store["alerts"]), "ingest-actions")
        last = I.change_set(marks).groupBy("alert_id").agg(F.max("seq").alias("seq"))
        out = {"alerts": _as(I.apply_upsert(store["alerts"], batch, marks), ALERTS)}
        for name in ("locations", "mentions", "resolutions"):
            new = made[name].join(last, "seq").drop("seq").select(*store[name].columns)
            out[name] = I.replace_children(store[name], new, last)
        lost = rejected.count() if rejected is not None else 0
        stats = A.ingest_stats(marks.join(batch.select("seq", "status"), "seq")).withColumn("rejected", F.col("rejected") + lost)
        return out | {"actions": marks, "revisions": I.revisions(marks), "changes": change_feed(marks, batch), "stats": stats}


def backfill(store: dict[str, DataFrame], ix: R.Index, dry_run: bool = False, named_only: bool = False) -> dict[str, DataFrame]:
    """Extracts again the alerts whose resolution is missing or stale.

    All stored locations take the part of the structured field, so a place that
    was read from a text is structured from then on; with ``named_only`` just
    those that a structured field gave, and the result is that of the first
    extraction. Title, description and raw text are read again. Returns the stored
    tables with those alerts' children replaced, and ``counts`` (processed,
    skipped). ``dry_run`` counts only.
    """
    with measured_broadcasts(store["alerts"].sparkSession):
        keyed = store["alerts"].withColumn("cache_key", hashing.cache_key(F.col("content_hash"), K.GAZETTEER_VERSION, K.EXTRACTION_VERSION))
        stale = write_and_read(J.needs_resolution(keyed, store["resolutions"]), "backfill")
        counts = I.backfill_counts(keyed, stale)
        if dry_run:
            return {"counts": counts}
        place = F.struct("city", "district", "province", "latitude", "longitude")
        structured = store["locations"].withColumnRenamed("alert_id", "id").join(stale.select("id"), "id", "left_semi").filter("raw_location IS NOT NULL")
        if named_only:
            structured = structured.filter("text_source = 'STRUCTURED_SCRAPER_FIELD'")
        structured = structured.groupBy("id", "raw_location").agg(F.min_by(place, "location_id").alias("r"), (-F.max("evidence_score")).alias("pos")).select(
            "id", "pos", "raw_location", "r.*")  # strongest evidence first
        conditions = B.river_conditions(B.structure_bulletins(stale.select("id", "raw_text", "source_url")), "id").withColumnRenamed("pos", "cond_pos")
        made = children(stale, structured, conditions, ix)
        touched = stale.select(F.col("id").alias("alert_id"))
        return {name: I.replace_children(store[name], made[name].select(*store[name].columns), touched) for name in made} | {"counts": counts}
